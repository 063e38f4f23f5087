"""Legacy archive converter: ARC records of version 1 and 2 to WARC records.

An ARC file starts with a ``filedesc`` record, whose body names the version; each
record is a header line of space-separated fields, then as many bytes as its last
field declares, then a line feed. Version 1 lines have 5 fields, version 2 lines 10.
The converter reads those lines from the right, so that odd urls do not shift fields,
checks the declared lengths, and makes WARC records: an identifier that carries the
page's id and part of the payload's digest, a timestamp from the 14-digit archive date, the type, and SHA-1 digests of
block and payload.

Of records with equal payloads of at least ``min_revisit`` bytes, the one with the
largest page id is a response and the others are revisits that refer to it; smaller
payloads are all responses. The winners are found by an aggregation that combines
before its shuffle, and joined back on the digest, which Spark splits where a
payload is frequent.

Archives are rows of bytes (one WARC file each, every record its own gzip member) in
a staged table, so that any store Spark writes to can hold them.

Cases: a null html is an empty payload; a null url is stored as ``about:blank``, and
white space in a url is percent-encoded. A null page id is kept as null and never
referred to; its record's identifier comes from the archive's name and the place in it.
Rows that repeat are records of their own; of equal page ids with equal payloads all are
responses, and as captures of one page with one content they share an identifier. An empty table gives an empty result. Extra columns are
not carried.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantaloom.sources.runtime import ship_package, stage

# The field names of both versions of the header line.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
WITH_PAGE, WITHOUT_PAGE = 0x76, 0x6E  # the first byte of the identifiers made here
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"  # a fixed value of the WARC standard
FILES = T.StructType([T.StructField("archive", T.StringType()), T.StructField("n_records", T.LongType()), T.StructField("warc", T.BinaryType())])
FOUND = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType())])


@dataclass
class ArcRecord:
    fields: dict[str, str]
    content: bytes


def record_id(page_id: int | None, digest: bytes) -> str:
    """A version-8 UUID: a mark, 48 bits of the payload's digest and the page id; without a page id, 112 bits of the digest.

    So a page's captures with different payloads have different identifiers, and a
    revisit knows that of the record it refers to, as both payloads have one digest.
    """
    if page_id is None:
        high, low = WITHOUT_PAGE << 48 | int.from_bytes(digest[:6]), int.from_bytes(digest[6:14])
    else:
        high, low = WITH_PAGE << 48 | int.from_bytes(digest[:6]), page_id & (1 << 64) - 1
    bits = (high >> 8) << 80 | 8 << 76 | (high & 255) << 68 | (low >> 62) << 64 | 2 << 62 | (low & (1 << 62) - 1)
    x = f"{bits:032x}"
    return f"<urn:uuid:{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}>"


def page_of(identifier: str) -> int | None:
    """The page id that ``record_id`` put into an identifier."""
    bits = int(identifier.removeprefix("<urn:uuid:").rstrip(">").replace("-", ""), 16)
    if bits >> 120 != WITH_PAGE:
        return None
    low = (bits >> 64 & 3) << 62 | bits & (1 << 62) - 1
    return low - (1 << 64) if low >> 63 else low


def write_arc(records: list[tuple[str, str, int | None, bytes]], version: int, name: str) -> bytes:
    """A legacy archive of (url, 14-digit date, page id, payload)."""
    line = " ".join(FIELDS[version])
    about = f"{version} 0 vantaloom\n{line}\n".encode()
    rest = ["text/plain", *(["200", "-", "-", "0", name] if version == 2 else []), str(len(about))]
    out = [f"filedesc://{name} 0.0.0.0 20240101000000 {' '.join(rest)}\n".encode(), about, b"\n"]
    at = sum(map(len, out))
    for url, date, page_id, payload in records:
        own = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
        content = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + own + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
        rest = ["text/html", *(["200", hashlib.md5(payload).hexdigest(), "-", str(at), name] if version == 2 else []), str(len(content))]
        part = [f"{url} 0.0.0.0 {date} {' '.join(rest)}\n".encode(), content, b"\n"]
        at += sum(map(len, part))
        out += part
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of a legacy archive; a line or length that does not fit raises ValueError."""
    at, names = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("a header line without an end")
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        if names is None:
            if not line.startswith("filedesc://"):
                raise ValueError("an archive starts with a filedesc record")
            n = int(line.rsplit(" ", 1)[1])
            body = data[end + 1 : end + 1 + n].decode("utf-8", "replace").splitlines()
            version = int(body[0].split()[0])
            if version not in FIELDS:
                raise ValueError(f"version {version} is not known")
            names = FIELDS[version]
            at = end + 1 + n
            continue
        parts = line.rsplit(" ", len(names) - 1)
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError("a header line that does not fit its version")
        n = int(parts[-1])
        if end + 1 + n > len(data):
            raise ValueError("a declared length beyond the archive's end")
        yield ArcRecord(dict(zip(names, parts, strict=True)), data[end + 1 : end + 1 + n])
        at = end + 1 + n


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def to_warc(record: ArcRecord, page_id: int | None, refers_to: int | None, place: str = "") -> bytes:
    """One WARC record; with ``refers_to`` a revisit, which keeps the HTTP header alone. ``place`` tells records without a page id apart."""
    head, gap, payload = record.content.partition(b"\r\n\r\n")
    sha1 = hashlib.sha1(payload).digest()
    own = sha1 if page_id is not None else hashlib.sha1(place.encode() + b"\n" + record.content).digest()
    date = record.fields["Archive-date"].ljust(14, "0")
    block = head + gap if refers_to is not None else record.content
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, own)}",
        f"WARC-Date: {date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z",
        f"WARC-Target-URI: {record.fields['URL']}",
        f"WARC-IP-Address: {record.fields['IP-address']}",
        f"WARC-Payload-Digest: {_digest(payload)}",
        f"WARC-Block-Digest: {_digest(block)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[2:2] = [f"WARC-Refers-To: {record_id(refers_to, sha1)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of a WARC file of gzip members."""
    while data:
        member = zlib.decompressobj(31)
        raw = member.decompress(data)
        data = member.unused_data
        head, _, rest = raw.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(fields["content-length"])
        block = rest[:n]
        if len(block) < n or _digest(block) != fields["warc-block-digest"]:
            raise ValueError("a record that is cut off or has changed")
        yield fields, block


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def convert(arc: bytes, referrals: list[int | None], name: str = "") -> list[bytes]:
    """The records of an ARC file as gzip members of a WARC file; ``referrals`` go with the records."""
    out = []
    for i, (record, refers_to) in enumerate(zip(read_arc(arc), referrals, strict=True)):
        found = re.search(rb"(?m)^X-Page-Id: (-?\d+)\r$", record.content.partition(b"\r\n\r\n")[0] + b"\r\n")
        out.append(_gzip(to_warc(record, int(found[1]) if found else None, refers_to, f"{name}:{i}")))
    return out


def with_referrals(pages: DataFrame, min_revisit: int) -> DataFrame:
    """Page id, url, html, and for revisits the page id they refer to."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = base.where(F.octet_length("html") >= min_revisit)
    winners = large.groupBy("digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).where("n > 1").select(F.substring("digest", 1, 40).alias("digest"), "winner")  # the whole digest, under a partitioning that the planner does not know: the join then shuffles both sides afresh and can split a frequent payload
    own = F.when((F.col("winner") != F.col("page_id")) | F.col("page_id").isNull(), F.col("winner"))
    return base.join(winners, "digest", "left").select("page_id", "url", "html", own.alias("refers_to"))


def write_archives(pages: DataFrame, min_revisit: int = 1000, date: str = "20240101000000", archive_bytes: int = 8_000_000) -> DataFrame:
    """Pages as legacy archives, converted to WARC files; the staged table of the files.

    Archives take the ARC versions in turn. One archive's payloads, at most
    ``archive_bytes`` or one page, are in memory at a time.
    """
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        held, referrals, size = [], [], 0

        def archive() -> pa.RecordBatch:
            name = f"part-{part:06d}-{n:06d}"
            members = convert(write_arc(held, 1 + n % 2, f"{name}.arc"), referrals, name)
            return pa.RecordBatch.from_arrays([pa.array([f"{name}.warc.gz"]), pa.array([len(members)], pa.int64()), pa.array([b"".join(members)], pa.binary())], names=FILES.fieldNames())

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = html.encode()
                if held and size + len(payload) > archive_bytes:
                    yield archive()
                    held, referrals, size, n = [], [], 0, n + 1
                url = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "about:blank")
                held.append((url, date, page_id, payload))
                referrals.append(refers_to)
                size += len(payload)
        if held:
            yield archive()

    return stage(with_referrals(pages, min_revisit).mapInArrow(run, FILES), "warc", "none")


def read_archives(files: DataFrame) -> DataFrame:
    """Per record of the WARC files: page, payload size and digest, type, and the page it refers to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for fields, block in read_warc(data.as_py()):
                    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
                    size = int(fields["x-payload-length"])
                    if fields["warc-type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if len(payload) != size or hashlib.sha1(payload).digest() != digest:
                            raise ValueError("a payload that does not fit its digest")
                    refers_to = fields.get("warc-refers-to")
                    rows.append((page_of(fields["warc-record-id"]), size, digest.hex(), fields["warc-type"], page_of(refers_to) if refers_to else None))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=FOUND.fieldNames())

    return files.select("warc").mapInArrow(run, FOUND)
