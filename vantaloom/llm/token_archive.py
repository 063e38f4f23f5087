"""Token-id archive: interleaved range-ANS blocks with shared tables.

Documents are put in ascending id order over range partitions; each partition
writes segments. A segment is one row of bytes, so that a table in any store that
Spark writes to can hold the archive:

    magic, counts | lengths of its documents | frequency table | block index | blocks

All blocks of a segment share its static frequency table (``SCALE`` bits). A block
holds ``BLOCK`` ids dealt in turn to ``LANES`` coder states. The block index is the
segment's list of checkpoints: for each block its place, its lanes' final states and
word counts, and a checksum of its ids, so that any block can be decoded alone, and
all blocks of a segment side by side. Coding is vectorised over blocks and lanes.

The state is 64 bits wide and gives or takes 32 bits at a time. Where x is below
f * 2**(64 - SCALE), coding a symbol of frequency f and base c maps x to
(x // f << SCALE) + x % f + c; decoding finds the symbol from the low SCALE bits.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantaloom.llm.tokens import word_bpe
from vantaloom.sources.runtime import ship_package, stage

MAGIC = b"VTRA"
SCALE, LANES, BLOCK = 18, 16, 32_768
LOW = np.uint64(1 << 32)
HEAD = struct.Struct("<4sBBIIQI")  # magic, scale, lanes, block, documents, ids, bytes of the packed table
ARCHIVE = T.StructType(
    [
        T.StructField("shard", T.LongType()),
        T.StructField("segment", T.LongType()),
        T.StructField("before", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.BinaryType()),
        T.StructField("payload", T.BinaryType()),
    ]
)
INDEX = T.StructType([T.StructField(n, T.LongType()) for n in ("shard", "doc_id", "local_start", "n_tokens", "ids_crc32")])


def quantise(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to 2**scale, at least 1 for each symbol that occurs."""
    total, goal = int(counts.sum()), 1 << scale
    used = np.flatnonzero(counts)
    if len(used) > goal:
        raise ValueError("more symbols than the scale has slots")
    freq = np.zeros(len(counts), dtype=np.int64)
    freq[used] = np.maximum(1, counts[used] * goal // max(total, 1))
    excess = int(freq.sum()) - goal
    if excess < 0:
        freq[np.argmax(freq)] -= excess
    while excess > 0:  # take from the most frequent, in proportion
        big = np.flatnonzero(freq > 1)
        cut = np.minimum(freq[big] - 1, np.maximum(1, freq[big] * excess // int(freq[big].sum())))
        order = np.argsort(-freq[big], kind="stable")
        cut = np.minimum(cut[order], np.maximum(0, excess - np.concatenate([[0], np.cumsum(cut[order])[:-1]])))
        freq[big[order]] -= cut
        excess = int(freq.sum()) - goal
    return freq


def encode_segment(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The bytes of one segment."""
    counts = np.bincount(ids) if len(ids) else np.zeros(1, dtype=np.int64)
    freq = quantise(counts) if len(ids) else counts
    base = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    used = np.flatnonzero(freq)
    packed = zlib.compress(np.diff(used, prepend=0).astype("<u4").tobytes() + freq[used].astype("<u4").tobytes(), 6)
    n_blocks = -(-len(ids) // BLOCK)
    lanes = n_blocks * LANES
    steps = BLOCK // LANES if n_blocks > 1 else -(-len(ids) // LANES)
    grid = np.zeros((n_blocks, steps * LANES), dtype=np.int64)
    grid.reshape(-1)[: len(ids)] = ids
    valid = np.zeros(grid.shape, dtype=bool)
    valid.reshape(-1)[: len(ids)] = True
    grid = np.ascontiguousarray(grid.reshape(n_blocks, steps, LANES).transpose(1, 0, 2)).reshape(steps, lanes)
    valid = np.ascontiguousarray(valid.reshape(n_blocks, steps, LANES).transpose(1, 0, 2)).reshape(steps, lanes)
    state = np.full(lanes, LOW, dtype=np.uint64)
    words = np.zeros((lanes, steps + 1), dtype=np.uint32)
    n_words = np.zeros(lanes, dtype=np.int64)
    wide, up = freq.astype(np.uint64), np.uint64(SCALE)
    for step in range(steps - 1, -1, -1):
        on = valid[step]
        f = wide[grid[step]]
        f[~on] = 1
        full = on & (state >= f << np.uint64(64 - SCALE))
        at = np.flatnonzero(full)
        words[at, n_words[at]] = state[at].astype(np.uint32)
        n_words[at] += 1
        state[at] >>= np.uint64(32)
        q = state // f
        state = np.where(on, (q << up) + (state - q * f) + base[grid[step]], state)
    blocks, index = [], []
    for b in range(n_blocks):
        own = slice(b * LANES, (b + 1) * LANES)
        data = np.concatenate([words[k, : n_words[k]][::-1] for k in range(own.start, own.stop)]).astype("<u4").tobytes()
        check = zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].astype("<u4"))
        index.append(struct.pack("<QI", sum(map(len, blocks)), check) + state[own].astype("<u8").tobytes() + n_words[own].astype("<u4").tobytes())
        blocks.append(data)
    head = HEAD.pack(MAGIC, SCALE, LANES, BLOCK, len(lengths), len(ids), len(packed))
    return head + lengths.astype("<u4").tobytes() + packed + b"".join(index) + b"".join(blocks)


def decode_segment(data: bytes, blocks: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """Document lengths and the ids of the chosen blocks (all by default); a wrong checksum raises ValueError."""
    magic, scale, n_lanes, block, n_docs, n_ids, n_table = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token archive segment")
    at = HEAD.size
    lengths = np.frombuffer(data, "<u4", n_docs, at).astype(np.int64)
    at += 4 * n_docs
    table = np.frombuffer(zlib.decompress(data[at : at + n_table]), "<u4").astype(np.int64)
    at += n_table
    if not n_ids:
        return lengths, np.zeros(0, dtype=np.int64)
    used, f = np.cumsum(table[: len(table) // 2]), table[len(table) // 2 :]
    freq = np.zeros(int(used[-1]) + 1, dtype=np.uint64)
    freq[used] = f
    base = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    symbol_of = np.repeat(used, f)
    n_blocks, size = -(-n_ids // block), 12 + 12 * n_lanes
    body = at + n_blocks * size
    chosen = range(n_blocks)[blocks]
    steps_of = np.array([-(-min(block, n_ids - b * block) // n_lanes) for b in chosen])
    left = np.array([min(block, n_ids - b * block) for b in chosen])
    state, words, place, checks = [], [], [], []
    for b in chosen:
        where, check = struct.unpack_from("<QI", data, at + b * size)
        state.append(np.frombuffer(data, "<u8", n_lanes, at + b * size + 12))
        n_words = np.frombuffer(data, "<u4", n_lanes, at + b * size + 12 + 8 * n_lanes).astype(np.int64)
        place.append(np.concatenate([[0], np.cumsum(n_words)[:-1]]) + sum(map(len, words)))
        words.append(np.frombuffer(data, "<u4", int(n_words.sum()), body + where))
        checks.append(check)
    state, place = np.concatenate(state).astype(np.uint64), np.concatenate(place)
    words = np.append(np.concatenate(words), 0).astype(np.uint64)
    steps = int(steps_of.max())
    out = np.zeros((steps, len(state)), dtype=np.int64)
    low_bits, up = np.uint64((1 << scale) - 1), np.uint64(scale)
    lane, left = np.tile(np.arange(n_lanes), len(chosen)), np.repeat(left, n_lanes)
    for step in range(steps):
        on = step * n_lanes + lane < left
        slot = state & low_bits
        s = symbol_of[slot.astype(np.int64)]
        out[step] = s
        after = freq[s] * (state >> up) + slot - base[s]
        more = np.flatnonzero(on & (after < LOW))
        after[more] = (after[more] << np.uint64(32)) | words[place[more]]
        place[more] += 1
        state = np.where(on, after, state)
    parts = []
    for k, b in enumerate(chosen):
        own = out[:, k * n_lanes : (k + 1) * n_lanes].reshape(-1)[: min(block, n_ids - b * block)]
        if zlib.crc32(own.astype("<u4")) != checks[k]:
            raise ValueError(f"block {b}: wrong checksum")
        parts.append(own)
    return lengths, np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def write_archive(df: DataFrame, tokenizer: str, text_col: str = "text", id_col: str = "doc_id", end_id: int = 2, segment_ids: int = 2_000_000, task_bytes: int = 256_000_000) -> DataFrame:
    """Tokenize and write the archive; the staged table of its segments.

    Shards follow the ascending id order, segments that order within a shard. A null
    text is empty, so its document is the end id alone. Null ids come first. Rows with
    equal ids are kept, in the order of a hash of their texts, so that they need not meet
    in one task. Extra columns are not read. A segment closes at ``segment_ids`` ids, with
    whole documents: memory follows that, or the longest document.
    """
    spark = df.sparkSession
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = word_bpe(tokenizer).encode, TaskContext.get().partitionId()
        docs, arrays, held, n, before = [], [], 0, 0, 0

        def segment() -> pa.RecordBatch:
            ids = np.concatenate(arrays)
            payload = encode_segment(ids, np.array([len(a) for a in arrays]))
            sink = pa.BufferOutputStream()
            column = pa.RecordBatch.from_arrays([pa.array(docs, pa.int64())], names=["doc_id"])
            with pa.ipc.new_stream(sink, column.schema) as w:
                w.write_batch(column)
            longs = [pa.array([x], pa.int64()) for x in (shard, n, before, len(ids))]
            return pa.RecordBatch.from_arrays(longs + [pa.array([x], pa.binary()) for x in (sink.getvalue().to_pybytes(), payload)], names=ARCHIVE.fieldNames())

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs.append(doc_id)
                arrays.append(np.append(encode(text.as_py() or ""), end_id))
                held += len(arrays[-1])
                if held >= segment_ids:
                    yield segment()
                    docs, arrays, held, n, before = [], [], 0, n + 1, before + held
        if docs:
            yield segment()

    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    # Each task sorts about ``task_bytes`` of text, whatever the corpus's size; rows that share an id are told apart by a hash.
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // task_bytes))
    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    return stage(ordered.mapInArrow(run, ARCHIVE), "token-archive", "none")


def read_archive(archive: DataFrame) -> DataFrame:
    """Per document, from the files: shard, place in the shard, ids and their checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths, ids = decode_segment(row["payload"])
                docs = pa.ipc.open_stream(row["doc_ids"]).read_next_batch().column(0)
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
                shard = np.full(len(lengths), row["shard"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard, pa.int64()), docs, pa.array(ends - lengths + row["before"], pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                    names=INDEX.fieldNames(),
                )

    return archive.mapInArrow(run, INDEX)


def global_starts(documents: DataFrame, archive: DataFrame) -> DataFrame:
    """Add ``start``: the ids of all documents before, from the totals of the shards (one row each)."""
    totals = archive.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("shard_start"))
    return documents.join(offsets, "shard").select("doc_id", (F.col("shard_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
