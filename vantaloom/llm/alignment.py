"""Alignment of two tokenizers' tokens by a sweep over their end events.

A text, with a space before it, is encoded by A (a byte-level BPE file) and B (a sentencepiece
model). Each token ends at a byte offset; where an A and a B token end together, a
group closes. Tokens of one group are linked, all A with all B. The end events of both sides
are two tables: a row holds the events of one side in one slice of ``SLICE`` bytes. They are
put together by union, repartitioned by document and sorted by slice within
partitions; a state machine then reads them in order and holds only the tokens of the open
group, beside the sums of one document and its distinct linked id pairs. How many documents hold a pair is summed
over the corpus; the most frequent pairs, at most ``HOT`` of them, are then known to every task,
and the links of all others are joined with their counts, so no frequent pair meets in one task.

Cases: null and empty texts, and texts whose tokens' bytes do not spell them out, have no tokens: zeros and
an empty digest. Special tokens' strings in a text are plain text. A document is a row, told
from others by its id and a hash of its text; rows that repeat in both are as many documents,
with equal results. Ties for the highest count all count as best. Texts of any length are encoded whole,
one at a time; what is held of one text is its tokens while they are encoded, and its distinct pairs in the
sweep. A group may hold many tokens of both sides; its pairs are made from its distinct ids. An empty table gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantaloom.llm.tokens import _bytes_of_chars, byte_bpe, model
from vantaloom.sources.runtime import arrow_batches, ship_package, stage

SLICE = 1 << 15  # bytes of text whose events are one row
HOT = 1 << 20  # pairs that every task may know: 17 bytes each
HELD = 1 << 21  # counted pairs that a task holds before it hands them on
ROWS = 500  # rows that Python takes at a time
_EVENTS = "doc_id long, text_key string, slice long, side int, ids binary"


class SideA:
    """Ids of a byte-level BPE file, and each id's bytes; special tokens' strings are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec, chars = model(path), _bytes_of_chars()
        if spec["normalizer"] or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("a tokenizer file whose rules are not known")
        own = byte_bpe(path)
        self.special, self.fast = list(own.special), own.encode
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.plain.no_truncation()
        self.plain.no_padding()
        self.table = [b""] * own.n_vocab
        for token, i in spec["model"]["vocab"].items():
            self.table[i] = bytes(map(chars.__getitem__, token)) if token not in self.special else token.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.plain.encode(t, add_special_tokens=False).ids if any(s in t for s in self.special) else self.fast(t) for t in (" " + t for t in texts)]


class SideB:
    """Ids of a sentencepiece model, which puts the space before a text itself, and each id's bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.own = SentencePieceProcessor(model_file=path)
        self.table = [bytes([int(p[1:-1], 16)]) if self.own.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.own.get_piece_size()) for p in [self.own.id_to_piece(i)]]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.own.encode(texts, num_threads=1)


@lru_cache(maxsize=4)
def _side(kind: type, path: str) -> tuple:
    """A side, its ids' bytes and sizes, and the type that holds its ids."""
    side = kind(path)
    return side, side.table, np.array([len(b) for b in side.table], dtype=np.int64), np.uint16 if len(side.table) <= 1 << 16 else np.uint32


def events(docs: DataFrame, kind: type, number: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """End events of one side: the ids of the tokens that end in each slice. A text that its tokens do not spell out has one row, of slice -1."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side, table, sizes, width = _side(kind, path)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            out = []
            for n, (text, found) in enumerate(zip(texts, side.encode(texts), strict=True)):
                if b"".join(map(table.__getitem__, found)) != b" " + text.encode():
                    out.append((n, -1, b""))
                    continue
                ids = np.array(found, dtype=width)
                place = np.cumsum(sizes[ids]) // SLICE
                cuts = [0, *(np.flatnonzero(np.diff(place)) + 1), len(ids)]
                out.extend((n, int(place[lo]), ids[lo:hi].tobytes()) for lo, hi in zip(cuts, cuts[1:], strict=False))
            rows, slices, packed = zip(*out, strict=True) if out else ([], [], [])
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(slices, pa.int64()), pa.array([number] * len(rows), pa.int32()), pa.array(packed, pa.binary())], names=["doc_id", "text_key", "slice", "side", "ids"])

    known = docs.where(F.length(text_col) > 0).select(F.col(id_col).cast("long").alias("doc_id"), F.md5(F.col(text_col).cast("binary")).alias("text_key"), F.col(text_col).alias("text"))
    return known.mapInArrow(run, _EVENTS)


@lru_cache(maxsize=4)
def _digits(n: int) -> np.ndarray:
    """Decimal digits of 0..n-1, left-aligned, and a place for a mark, as bytes; 0 is no byte of a number."""
    width = len(str(n))
    out = np.zeros((n, width + 1), dtype=np.uint8)
    for i in range(n):
        s = str(i).encode()
        out[i, : len(s)] = np.frombuffer(s, np.uint8)
    return out


class Sweep:
    """The state machine of one document: the open group's tokens, sums, the digest, and distinct pairs."""

    def __init__(self, n_b: int, digits: tuple[np.ndarray, np.ndarray]):
        self.n_b, self.digits = n_b, digits
        self.ids, self.ends, self.at, self.counts = [np.zeros(0, np.int64)] * 2, [np.zeros(0, np.int64)] * 2, [0, 0], [0, 0]
        self.groups = self.links = 0
        self.sha = hashlib.sha256()
        self.pairs, self.times = [], []

    def take(self, sides: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """The tokens of both sides that end in the next slice; groups that close within are emitted."""
        for s, (ids, sizes) in enumerate(sides):
            ends = self.at[s] + np.cumsum(sizes)
            if len(ends):
                self.at[s] = int(ends[-1])
            self.counts[s] += len(ids)
            self.ids[s], self.ends[s] = np.concatenate([self.ids[s], ids]), np.concatenate([self.ends[s], ends])
        cuts = np.intersect1d(*self.ends, assume_unique=True)
        if not len(cuts):
            return
        n = [int(np.searchsorted(e, cuts[-1], "right")) for e in self.ends]
        (a, b), (ends_a, ends_b) = (i[:k] for i, k in zip(self.ids, n, strict=True)), (e[:k] for e, k in zip(self.ends, n, strict=True))
        self.ids, self.ends = [i[k:] for i, k in zip(self.ids, n, strict=True)], [e[k:] for e, k in zip(self.ends, n, strict=True)]
        self.emit(a, b, np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b), len(cuts))

    def emit(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, groups: int) -> None:
        n_a, n_b = np.bincount(of_a, minlength=groups), np.bincount(of_b, minlength=groups)
        size = n_a * n_b
        start_a, start_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        # The digest's text: tokens in the order of their group, side and place, each with the mark that follows it.
        width = max(d.shape[1] for d in self.digits)
        line = np.zeros((len(a) + len(b), width), dtype=np.uint8)
        at_a, at_b = np.arange(len(a)) + start_b[of_a], np.arange(len(b)) + (start_a + n_a)[of_b]
        for ids, at, digits, more, end in ((a, at_a, self.digits[0], b",", b"|"), (b, at_b, self.digits[1], b",", b";")):
            line[at, : digits.shape[1]] = digits[ids]
            line[at, -1] = more[0]
            line[at[np.flatnonzero(np.diff(of_a if end == b"|" else of_b, append=groups))], -1] = end[0]
        text = line[line > 0].tobytes()[:-1]
        self.sha.update(b";" + text if self.groups else text)
        self.groups += groups
        self.links += int(size.sum())
        single = size == 1
        self.note(a[start_a[single]] * self.n_b + b[start_b[single]], None)
        small = np.flatnonzero(~single & (size <= 4096))
        if len(small):
            k = size[small]
            within = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            g = np.repeat(small, k)
            self.note(a[start_a[g] + within // n_b[g]] * self.n_b + b[start_b[g] + within % n_b[g]], None)
        for g in np.flatnonzero(size > 4096):
            (x, nx), (y, ny) = (np.unique(v[s[g] : s[g] + k[g]], return_counts=True) for v, s, k in ((a, start_a, n_a), (b, start_b, n_b)))
            for i, times in zip(x, nx, strict=True):
                self.note(i * self.n_b + y, ny * times)

    def note(self, pairs: np.ndarray, times: np.ndarray | None) -> None:
        if len(pairs):
            self.pairs.append(pairs)
            self.times.append(np.ones(len(pairs), np.int64) if times is None else times)
            if sum(map(len, self.pairs)) > HELD:
                self.pairs, self.times = ([v] for v in self.distinct())

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return _summed(np.concatenate(self.pairs), np.concatenate(self.times))


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(n, first) if len(first) else n


_SWEPT = "doc_id long, text_key string, copies int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def sweep(both: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Groups and links of each document from the events of both sides; ``pairs`` and ``times`` are its distinct linked pairs (A's id times B's vocabulary, plus B's id) and how often."""
    ship_package(both.sparkSession)
    n = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = both.repartition(n, "doc_id", "text_key").sortWithinPartitions("doc_id", "text_key", "slice", "side")
    kinds = [pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary()]
    names = [c.split()[0] for c in _SWEPT.split(", ")]

    def swept(stream: Iterator[tuple]) -> Iterator[tuple]:
        sides = _side(SideA, a_path), _side(SideB, b_path)
        n_b = len(sides[1][1])
        digits = _digits(len(sides[0][1])), _digits(n_b)
        nothing = [(np.zeros(0, np.int64),) * 2] * 2
        for key, own in groupby(stream, key=itemgetter(0, 1)):
            flow, held, first, last, copies = Sweep(n_b, digits), list(nothing), None, None, 0
            for _, _, place, side, raw in own:
                if first is None:
                    first = place, side
                # A row of documents that repeats sends its events again: they come side by side.
                copies += (place, side) == first
                if place < 0 or first[0] < 0 or (place, side) == last:
                    continue
                if last is not None and place != last[0]:
                    flow.take(held)
                    held = list(nothing)
                last = place, side
                ids = np.frombuffer(raw, sides[side][3]).astype(np.int64)
                held[side] = ids, sides[side][2][ids]
            if first[0] < 0:
                yield *key, copies, 0, 0, 0, 0, "", b"", b""
                continue
            flow.take(held)
            pairs, times = flow.distinct()
            yield *key, copies, *flow.counts, flow.groups, flow.links, flow.sha.hexdigest(), pairs.tobytes(), times.astype(np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        found = swept(stream)
        while out := list(islice(found, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return rows.mapInArrow(run, _SWEPT)


def pair_counts(swept: DataFrame) -> DataFrame:
    """(pair, n): in how many documents each pair is linked; summed within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            own = [np.frombuffer(p, np.int64) for p in batch.column(0).to_pylist()]
            times = np.repeat(batch.column(1).to_numpy().astype(np.int64), [len(p) for p in own])
            held = _summed(np.concatenate([held[0], *own]), np.concatenate([held[1], times]))
            if len(held[0]) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in held], names=["pair", "n"])
                held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in held], names=["pair", "n"])

    return swept.select("pairs", "copies").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def weigh(swept: DataFrame, counts: DataFrame, n_b: int, most: int = HOT) -> DataFrame:
    """``swept`` (without its pairs) with n_best and count_sum; ``counts`` is a staged table.

    The most frequent pairs, by steps of their count, are looked up in the tasks as far as ``most`` of them; links of
    rarer pairs are joined with their counts.
    """
    spark = swept.sparkSession
    step = F.floor(F.log2("n") * 4).cast("int")
    sizes = counts.groupBy(step.alias("step")).count().collect()  # at most 256 rows
    least, known = max((r["step"] for r in sizes), default=0) + 1, 0
    for r in sorted(sizes, key=lambda r: -r["step"]):
        if known + r["count"] > most:
            break
        least, known = r["step"], known + r["count"]
    highest = counts.groupBy(F.floor(F.col("pair") / n_b).alias("a")).agg(F.max("n").alias("highest"))
    # As many rows as A has ids, at most.
    marked = stage(counts.join(F.broadcast(highest), F.floor(F.col("pair") / n_b) == F.col("a")).select("pair", "n", (F.col("n") == F.col("highest")).alias("best")), "marked")
    hot = marked.where(step >= least).toArrow().sort_by("pair")
    held = spark.sparkContext.broadcast(tuple(hot.column(c).to_numpy() for c in ("pair", "n", "best")))
    kept = [c.split()[0] for c in _SWEPT.split(", ")[:-2]]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = held.value
        for batch in batches:
            own = [np.frombuffer(p, np.int64) for p in batch.column(len(kept)).to_pylist()]
            times = np.concatenate([np.frombuffer(t, np.uint32) for t in batch.column(len(kept) + 1).to_pylist()] or [np.zeros(0, np.uint32)]).astype(np.int64)
            pairs, of = np.concatenate(own or [np.zeros(0, np.int64)]), np.repeat(np.arange(len(own)), [len(p) for p in own])
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            is_hot = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            total, top = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            np.add.at(total, of[is_hot], times[is_hot] * n[at[is_hot]])
            np.add.at(top, of[is_hot], times[is_hot] * best[at[is_hot]])
            ends = np.concatenate([[0], np.cumsum(np.bincount(of[~is_hot], minlength=len(own)))]).astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v[~is_hot])) for v in (pairs, times)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(top), pa.array(total), *rest], names=[*kept, "n_best", "count_sum", "rest", "rest_times"])

    with arrow_batches(spark, ROWS):
        seen = stage(swept.mapInArrow(look_up, ", ".join(_SWEPT.split(", ")[:-2]) + ", n_best long, count_sum long, rest array<long>, rest_times array<long>"), "seen")
    rare = seen.select("doc_id", "text_key", F.explode(F.arrays_zip("rest", "rest_times")).alias("r")).select("doc_id", "text_key", F.col("r.rest").alias("pair"), F.col("r.rest_times").alias("times"))
    more = rare.join(marked.where(step < least), "pair").groupBy("doc_id", "text_key").agg(F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    both = seen.drop("rest", "rest_times").alias("s").join(more.alias("m"), F.col("s.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("s.text_key") == F.col("m.text_key")), "left")
    plus = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0))).alias(c)
    return both.select(*[f"s.{c}" for c in kept], plus("n_best", "more_best"), plus("count_sum", "more"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Per document: n_a, n_b, n_groups, n_links, n_best, count_sum and the digest of its groups."""
    spark = docs.sparkSession
    with arrow_batches(spark, ROWS):
        both = events(docs, SideA, 0, a_path, id_col, text_col).unionByName(events(docs, SideB, 1, b_path, id_col, text_col))
        swept = stage(sweep(both, a_path, b_path), "swept")
        counts = stage(pair_counts(swept), "pair-counts")
    from sentencepiece import SentencePieceProcessor

    n_b = SentencePieceProcessor(model_file=b_path).get_piece_size()
    known = weigh(swept, counts, n_b, hot).withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    zero = F.lit(0).cast("long")
    columns = [*_COUNTS, "n_best", "count_sum"]
    bare = docs.where(F.col(text_col).isNull() | (F.length(text_col) == 0)).select(F.col(id_col).cast("long").alias("doc_id"), *[zero.alias(c) for c in columns], F.lit("").alias("groups_sha256"))
    return known.select("doc_id", *columns, "groups_sha256").unionByName(bare)
