"""Packing by minimum bin slack: documents into token sequences with no padding.

A document's ids are cut into whole sequences of ``capacity`` ids and a remainder.
The remainders of a partition wait in a pool, as counts by length. Each sequence
starts with the longest one; a subset-sum over the other lengths (a bitset of
reachable sums, one shift for each copy of a length, longest first) finds the
multiset that fills the rest closest to capacity, and walking the shifts back gives
how many of each length it takes. A sequence that no multiset fills gets a cut from
a longer remainder, whose rest goes back into the pool. What is left at the end of
a partition, less than one sequence, is cut into sequences of powers of two, which
need no padding.

Tokenizing and packing are one pass over the input's own partitions: no shuffle, and
memory bounded by ``pool`` remainders, whatever the size of a partition, of a
source or of a group of copies. A lost task gives the same rows when it runs again,
as a partition's rows come in the same order.

Cases: a null or empty text is a document of the end id alone. Rows that repeat are
documents of their own; with equal ids they are told apart by sequence and offset. A
null id stays null. An empty table gives an empty result. Other columns of the input
are not carried along.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vantaloom.llm.tokens import byte_bpe
from vantaloom.sources.runtime import ship_package

PIECE = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
)
WITH_IDS = T.StructType([*PIECE.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
EMIT = 20_000


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take so that their sum is as near to ``room`` as can be, not over it."""
    mask, goal = (1 << (room + 1)) - 1, 1 << room
    reach, steps = 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        for _ in range(min(counts[length], room // length)):
            wider = (reach | reach << length) & mask
            if wider == reach:
                break
            steps.append((length, reach))
            reach = wider
            if reach & goal:
                break
        if reach & goal:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + 1
            at -= length
    return taken


class SlackPacker:
    """Packs one partition's documents; ``pieces`` holds (document, start, ids, sequence, offset)."""

    def __init__(self, capacity: int, pool: int):
        self.capacity, self.pool = capacity, pool
        self.waiting: dict[int, deque] = {}
        self.counts: dict[int, int] = {}
        self.n_waiting = self.n_sequences = 0
        self.pieces: list[tuple] = []

    def _put(self, doc, start: int, ids: np.ndarray) -> None:
        n = len(ids)
        self.waiting.setdefault(n, deque()).append((doc, start, ids))
        self.counts[n] = self.counts.get(n, 0) + 1
        self.n_waiting += 1

    def _take(self, length: int) -> tuple:
        item = self.waiting[length].popleft()
        self.n_waiting -= 1
        if self.counts[length] == 1:
            del self.counts[length], self.waiting[length]
        else:
            self.counts[length] -= 1
        return item

    def _lay(self, items: list[tuple]) -> None:
        offset = 0
        for doc, start, ids in items:
            self.pieces.append((doc, start, ids, self.n_sequences, offset))
            offset += len(ids)
        self.n_sequences += 1

    def add(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.capacity
        for start in range(0, whole, self.capacity):
            self._lay([(doc, start, ids[start : start + self.capacity])])
        if whole < len(ids):
            self._put(doc, whole, ids[whole:])
        if self.n_waiting >= self.pool:
            while self.n_waiting > self.pool // 2:
                self._sequence()

    def _sequence(self) -> None:
        """Fill one sequence to capacity, or lay out what is left."""
        longest = max(self.counts)
        items = [self._take(longest)]
        for length, n in fill(self.counts, self.capacity - longest).items():
            items += [self._take(length) for _ in range(n)]
        slack = self.capacity - sum(len(i[2]) for i in items)
        if slack and self.counts:  # what waits is longer than the slack: shorter lengths would have been taken
            doc, start, ids = self._take(min(self.counts))
            items.append((doc, start, ids[:slack]))
            self._put(doc, start + slack, ids[slack:])
            slack = 0
        if not slack:
            self._lay(items)
            return
        left = self.capacity - slack
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            row = []
            while size:
                doc, start, ids = items[0]
                row.append((doc, start, ids[:size]))
                if len(ids) > size:
                    items[0] = (doc, start + size, ids[size:])
                    size = 0
                else:
                    items.pop(0)
                    size -= len(ids)
            self._lay(row)

    def finish(self) -> None:
        while self.n_waiting:
            self._sequence()

    def drain(self) -> list[tuple]:
        out, self.pieces = self.pieces, []
        return out


def pack(df: DataFrame, tokenizer: str, text_col: str = "text", id_col: str = "doc_id", capacity: int = 1024, end_id: int = 0, pool: int = 8192, with_ids: bool = True) -> DataFrame:
    """One row for each piece of a document: where it lies in the document and in its sequence.

    ``tokenizer`` is the path of a byte-level BPE file of the ``tokenizers`` library.
    ``capacity`` must be a power of two. ``with_ids`` adds the piece's ids.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    ship_package(df.sparkSession)
    schema = WITH_IDS if with_ids else PIECE

    def batch_of(pieces: list[tuple], first: int) -> pa.RecordBatch:
        columns = [
            pa.array([p[0][0] for p in pieces], pa.int64()),
            pa.array([p[1] for p in pieces], pa.int64()),
            pa.array([len(p[2]) for p in pieces], pa.int64()),
            pa.array([zlib.crc32(p[2]) for p in pieces], pa.int64()),
            pa.array([p[0][1] for p in pieces], pa.int64()),
            pa.array([first + p[3] for p in pieces], pa.int64()),
            pa.array([p[4] for p in pieces], pa.int64()),
        ]
        if with_ids:
            columns.append(pa.array([p[2].astype(np.int32) for p in pieces], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(tokenizer).encode
        first = TaskContext.get().partitionId() << 40
        packer = SlackPacker(capacity, pool)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                ids.append(end_id)
                packer.add((doc_id, len(ids)), np.array(ids, dtype="<u4"))
                if len(packer.pieces) >= EMIT:
                    yield batch_of(packer.drain(), first)
        packer.finish()
        yield batch_of(packer.drain(), first)

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, schema)
