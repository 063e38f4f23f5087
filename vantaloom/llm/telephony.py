"""Telephony audio columns: mu-law, A-law and ADPCM in WAV form, expanded to resampled PCM.

A payload (bytes) is stored as the coded data of a WAV file with one of three codecs,
so nothing is lost: mu-law and A-law keep one byte a sample, ADPCM blocks of 64 bytes
keep a 4-byte header and 120 four-bit codes. Reading parses the RIFF chunks, expands
mu-law and A-law by 256-entry tables, and decodes ADPCM for all blocks of a batch at
once: 120 steps of numpy, each over every block. The samples are resampled to the
target rate by linear interpolation and stored; features come from the stored PCM. PCM
is stored without loss as two planes: every second sample, and the rest as differences
from the mean of their neighbours, which compress better than the samples in turn.

The codec follows from the payload's checksum, so equal payloads have equal files.

Cases: a null text is empty; its payload is 64 zero bytes. Text of any length is one
file: a string of Spark has at most 2 GB, and a WAV file holds ``4 GB - 1`` (``write_wav``
raises ValueError beyond that).
Rows that repeat give rows that repeat. An empty table gives an empty result. Columns
other than the id and the text are not carried along.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vantaloom.sources import runtime
from vantaloom.sources.runtime import arrow_batches, ship_package

RATE, TARGET_RATE, ALIGN, BATCH, PAGE = 8000, 16_000, 64, 1000, 8 << 20
MULAW, ALAW, ADPCM = 7, 6, 0x11  # fixed values: WAV format tags
NAMES = {MULAW: "mulaw", ALAW: "alaw", ADPCM: "adpcm"}
CODECS = (MULAW, ALAW, ADPCM)
EVEN = {tag: f"even_{name}" for tag, name in NAMES.items()}  # sounds of a codec have samples in common, so each has a column of its own
SAMPLES = 2 * (ALIGN - 4) + 1  # of an ADPCM block

# The index steps of IMA ADPCM codes.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8, -1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)
# The step sizes of IMA ADPCM.
STEP = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    dtype=np.int32,
)

STORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
FACTS = T.StructType([T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType())])
PCM = T.StructType([*STORED.fields, *FACTS.fields, T.StructField("codec", T.StringType()), T.StructField("pcm", T.BinaryType())])
FEATURES = T.StructType([*STORED.fields[:2], *FACTS.fields, T.StructField("feature", T.StringType())])


def _mulaw_table() -> np.ndarray:
    """G.711 mu-law: inverted bits, 3 of exponent and 4 of mantissa, bias 132."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    """G.711 A-law: every other bit inverted, linear in the lowest segment."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    segment, low = (code >> 4) & 7, (code & 15) << 4
    size = np.where(segment == 0, low + 8, low + 0x108 << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {MULAW: _mulaw_table(), ALAW: _alaw_table()}


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8, padded with zeros to a positive multiple of the alignment; and its length before."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % ALIGN or ALIGN * (not raw)), len(raw)


def write_wav(payload: bytes) -> bytes:
    """A WAV file with the payload as its coded data."""
    tag = CODECS[zlib.crc32(payload) % len(CODECS)]
    if tag == ADPCM:
        fmt = struct.pack("<HHIIHHHH", tag, 1, RATE, RATE * ALIGN // SAMPLES, ALIGN, 4, 2, SAMPLES)
        n_samples = len(payload) // ALIGN * SAMPLES
    else:
        fmt = struct.pack("<HHIIHHH", tag, 1, RATE, RATE, 1, 8, 0)
        n_samples = len(payload)
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(fmt)) + fmt + struct.pack("<4sII", b"fact", 4, n_samples) + struct.pack("<4sI", b"data", len(payload)) + payload
    if len(body) >= 1 << 32:
        raise ValueError("too long for a WAV file")
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, bytes]:
    """Format tag, block size and coded data of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag, align, data = 12, 0, 1, None
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            tag, align = struct.unpack_from("<H", media, at + 8)[0], struct.unpack_from("<H", media, at + 20)[0]
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
            if len(data) < size:
                raise ValueError("a WAV file that is cut off")
        at += 8 + size + size % 2
    if data is None or tag not in NAMES:
        raise ValueError("no data that can be decoded")
    return tag, align, data


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples (blocks x 121) of IMA ADPCM blocks (blocks x 64 bytes); a step index out of range is clamped."""
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2").reshape(-1).astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEP) - 1).astype(np.int32)
    out = np.empty((SAMPLES, len(blocks)), dtype=np.int16)
    out[0] = value = head
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(SAMPLES - 1):
        code = codes[k >> 1] >> 4 if k & 1 else codes[k >> 1] & 15
        step = STEP[index]
        diff = step >> 3
        diff += (step >> 2) * (code & 1)
        diff += (step >> 1) * (code >> 1 & 1)
        diff += step * (code >> 2 & 1)
        value = np.clip(np.where(code & 8, value - diff, value + diff), -32768, 32767)
        out[k + 1] = value
        index = np.clip(index + INDEX_STEP[code], 0, len(STEP) - 1)
    return np.ascontiguousarray(out.T)


def resample(pcm: np.ndarray, rate: int = RATE, target: int = TARGET_RATE) -> np.ndarray:
    """Linear interpolation to the target rate; the last sample is held."""
    if target == 2 * rate:
        out = np.empty(2 * len(pcm), dtype=np.int16)
        out[::2] = pcm
        out[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) >> 1
        out[-1:] = pcm[-1:]
        return out
    at = np.arange(len(pcm) * target // rate) * (rate / target)
    return np.rint(np.interp(at, np.arange(len(pcm)), pcm)).astype(np.int16)


def pack_pcm(pcm: np.ndarray) -> tuple[bytes, bytes]:
    """The even samples, and the odd ones less the mean of their neighbours, modulo 2**16; the last sample stands for one that is missing."""
    even, odd = pcm[::2], pcm[1::2]
    return even.tobytes(), (odd - _between(even, len(odd))).tobytes()


def unpack_pcm(even: bytes, rest: bytes) -> np.ndarray:
    """The samples that ``pack_pcm`` took apart."""
    even, rest = np.frombuffer(even, "<i2"), np.frombuffer(rest, "<i2")
    pcm = np.empty(len(even) + len(rest), dtype="<i2")
    pcm[::2] = even
    pcm[1::2] = rest + _between(even, len(rest))
    return pcm


def _between(even: np.ndarray, n: int) -> np.ndarray:
    after = np.append(even[1:], even[-1:])[:n]
    return ((even[:n].astype(np.int32) + after) >> 1).astype("<i2")


def expand(files: list[bytes]) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Tag, coded data and samples of each file; ADPCM blocks of all the files are decoded together."""
    read = [read_wav(m) for m in files]
    coded = [data for tag, _, data in read if tag == ADPCM]
    joined = decode_adpcm(np.frombuffer(b"".join(coded), np.uint8).reshape(-1, ALIGN)) if coded else None
    at = 0
    for tag, _, data in read:
        if tag == ADPCM:
            n = len(data) // ALIGN
            yield tag, data, joined[at : at + n].reshape(-1)
            at += n
        else:
            yield tag, data, TABLES[tag][np.frombuffer(data, np.uint8)]


def _groups(column, most: int = 4_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of a batch's values with at most so many bytes, or one value."""
    first, held, n = 0, [], 0
    for i, value in enumerate(column):
        value = value.as_py()
        if held and n + len(value) > most:
            yield first, held
            first, held, n = i, [], 0
        held.append(value)
        n += len(value)
    if held:
        yield first, held


def _sounds(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The samples of each row of a batch with planes."""
    even = [batch.column(n) for n in EVEN.values()]
    for i, rest in enumerate(batch.column("rest")):
        yield unpack_pcm(next(c[i] for c in even if c[i].is_valid).as_buffer(), rest.as_buffer())


def read_pcm(stored: DataFrame) -> DataFrame:
    """A table with PCM in planes, with its samples as ``pcm`` instead."""
    columns = [f for f in stored.schema.fields if f.name not in (*EVEN.values(), "rest")]
    schema = T.StructType([*columns, T.StructField("pcm", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                own = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([*(own.column(f.name) for f in columns), pa.array([x.tobytes() for x in _sounds(own)], pa.binary())], names=schema.fieldNames())

    return stored.mapInArrow(run, schema)


def stage(df: DataFrame, label: str, **how) -> DataFrame:
    """A staged table, made with few rows at a time. Planes are read back as samples; the table as it is stored stays at ``stored``, for readers that unpack in a pass of their own."""
    with arrow_batches(df.sparkSession, BATCH):
        stored = runtime.stage(df, label, **how)
    out = read_pcm(stored) if "rest" in stored.columns else stored
    out.stored = stored
    return out


def store_media(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Write each text as a telephony WAV file; the staged table with its ``media`` column."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for text in batch.column(1):
                payload, n = payload_of(text.as_py())
                sizes.append(n)
                media.append(write_wav(payload))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=STORED.fieldNames())

    return stage(df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, STORED), "telephony", level=12, page=PAGE)


def decode_media(media: DataFrame, target_rate: int = TARGET_RATE) -> DataFrame:
    """Add hashes of what was read back, the codec's name and ``pcm``: the expanded, resampled samples, 16 bits, little-endian."""
    return _decode(media, target_rate, ("pcm",), lambda tag, pcm: (pcm.tobytes(),))


def _decode(media: DataFrame, target_rate: int, names: tuple[str, ...], form: Callable[[int, np.ndarray], tuple[bytes | None, ...]]) -> DataFrame:
    ship_package(media.sparkSession)
    schema = T.StructType([*PCM.fields[:-1], *(T.StructField(n, T.BinaryType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * len(names))
        for batch in batches:
            for first, files in _groups(batch.column(2)):
                rows = []
                for (tag, data, coded), wav in zip(expand(files), files, strict=True):
                    sound = form(tag, resample(coded, RATE, target_rate).astype("<i2"))
                    rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(wav), hashlib.sha256(wav).hexdigest(), NAMES[tag], *sound))
                own = batch.slice(first, len(files))
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=schema.fieldNames())

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def _planes(tag: int, pcm: np.ndarray) -> tuple[bytes | None, ...]:
    even, rest = pack_pcm(pcm)
    return (*(even if t == tag else None for t in EVEN), rest)


def store_pcm(media: DataFrame) -> DataFrame:
    """Decode the files and write their resampled PCM in planes; the staged table, without the files, with ``pcm``."""
    return stage(_decode(media, TARGET_RATE, (*EVEN.values(), "rest"), _planes).drop("media"), "telephony-pcm", level=12, page=PAGE)


def media_features(media: DataFrame) -> DataFrame:
    """Hashes of what was stored and read back, and features of the resampled sound, which is stored and read back as well.

    The feature string has the codec, the number of samples, the peak, the mean square
    (whole number), the zero crossings and the checksum of the resampled PCM.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = []
            for codec, pcm in zip(batch.column("codec"), _sounds(batch), strict=True):
                wide = pcm.astype(np.float64)
                energy = int(wide @ wide) // len(pcm)
                below = pcm < 0
                crossings = int(np.count_nonzero(below[1:] != below[:-1]))
                peak = max(int(pcm.max()), -int(pcm.min()))
                features.append(f"{codec.as_py()}:{len(pcm)}:{peak}:{energy}:{crossings}:{zlib.crc32(pcm):08x}")
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in FEATURES.fieldNames()[:-1]), pa.array(features, pa.string())], names=FEATURES.fieldNames())

    return stage(store_pcm(media).stored.mapInArrow(run, FEATURES), "telephony-features")
