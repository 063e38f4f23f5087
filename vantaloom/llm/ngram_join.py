"""N-gram Jaccard join as a blocked sparse product of documents by n-grams.

Rows of the incidence matrix are distinct shingle sets (documents with equal sets are
one row), columns are shingles, ordered from rare to frequent by a count sketch of the
whole corpus. Sets of sizes x <= y with Jaccard similarity t or more need an overlap of
ceil(t (x + y) / (1 + t)), hence x >= t y, and a shared column among the first
x - ceil(t x) + 1 of either row: only that prefix of each row enters the first product.

1. One pass over the texts: each row's fingerprint and size, and the count sketch.
2. Columns of the prefixes that several rows share: first by short keys, sorted and packed, which
   tell most columns apart, then by a count of the rest. Rows whose id stands for no set stay out.
3. Columns shared by at most ``light`` rows: their pairs, with the overlap so far and
   the last shared places, summed by pair; pairs whose bound
   overlap + least of what is left stays below the need are dropped.
4. Columns shared by more: each row's pair with the column's least row, its leader, joins
   the pairs of 3. All that is left of those pairs accumulates its overlap over the
   remaining columns, in blocks of columns, and is dropped as soon as what is left can't
   reach the need. Rows that are linked by now need no more comparing with each other.
5. Columns of 4 whose rows are not all tied together yet: the rows that such columns
   connect, by classes of sizes that can reach the need at all, are dealt over cells of
   chunks, whatever the group's size; first by their signatures, which tell the rows that may
   have a partner in a cell they are not tied to. Of these, each cell is one blocked product
   over all its columns.
6. Links leave as pairs between sets; components of sets by star rounds, named by their least id.

A group of near copies thus costs a comparison a row; the product over cells remains for
rows that share frequent shingles and whose signatures are not far enough apart. A signature
has about a bit a shingle, the parities of the set's shingles by their last bits, and tells
most pairs that don't reach their need; it never rules out one that does. So sets, 64
times as large, move for few rows beside those that are linked.

The orders and filters only save work: any order of columns gives the same links. The
texts are read again in steps 2, 3, 4 and 5 rather than their sets stored, since hashing
them is cheaper than moving sets. The sketch grows with the input's partitions up to 2**22
counters (16 MB) and the filters with their keys up to 2**26 bits (8 MB): beyond that
the order tells only the most frequent shingles apart, and more rows pass the filters to
the exact joins behind them.

Cases: null or empty texts, and texts of spaces, have no shingle and link with nothing;
fewer than five words are one shingle. Repeated rows have equal sets and are linked.
Rows with a null id are kept and their component is null unless they have a partner.
Texts of any length are taken whole. An empty table gives an empty result. Extra
columns are not carried along.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantaloom.llm.blocks import Forest, to_cells
from vantaloom.llm.components import again, connected_components
from vantaloom.llm.shingles import mix, shingle_sets
from vantaloom.sources.runtime import arrow_batches, ship_package, stage

SKETCH_BITS, MOST_SKETCH_BITS, SKETCH_ROWS = 20, 22, 256
FILTER_BITS, MOST_FILTER_BITS = 20, 26
LIGHT, CHUNK, COLUMNS = 24, 384, 8192
LEAST_SIGN, SIGN_CHUNK, SIGN_BYTES, SIGN_BLOCK = 256, 4096, 4096, 64  # bits of the shortest signature; rows of a chunk whose signatures have up to so many bytes; rows compared at a time
KEY_BITS, BUCKET_BITS, KEYS = 42, 10, 1 << 20  # of a shingle in the first count, of these its bucket, and how many a task sorts at a time


def need(x, y, percent: int):
    """Overlap that sizes x and y need: the least i with 100 i >= percent (x + y - i)."""
    return -(-percent * (x + y) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def fingerprint(own: np.ndarray) -> int:
    """A 64-bit name of a shingle set."""
    with np.errstate(over="ignore"):
        return int(mix(mix(own + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own))).view(np.int64)[0])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sign_bits(n: int) -> int:
    """Bits of the signature of a set of ``n`` shingles: a power of two from n on."""
    return max(LEAST_SIGN, 1 << (max(n, 1) - 1).bit_length())


def signature(own: np.ndarray) -> bytes:
    """For each value of the shingles' last bits, whether an odd number of them has it.

    Two signatures of one length differ in no more bits than their sets in shingles. A
    signature folded in halves, by exclusive or, is that of half the length.
    """
    bits = sign_bits(len(own))
    return np.packbits((np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _folded(signs: list[bytes]) -> np.ndarray:
    """A row of words for each signature, all folded to the shortest one's length."""
    least = min(map(len, signs))
    out = np.empty((len(signs), least // 8), dtype=np.uint64)
    for i, sign in enumerate(signs):
        words = np.frombuffer(sign, np.uint64)
        while len(words) > out.shape[1]:
            words = words[: len(words) // 2] ^ words[len(words) // 2 :]
        out[i] = words
    return out


def most_apart(x, y, percent: int):
    """Shingles that sizes x and y may hold without the other set's holding them, where the pair reaches its need; -1 where none does."""
    least = need(x, y, percent)
    return np.where(least <= np.minimum(x, y), x + y - 2 * least, -1)


def _possible(left: np.ndarray, right: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether rows ``left`` with sizes x may reach their need with rows ``right`` with sizes y; by blocks of rows."""
    out = np.empty((len(left), len(right)), dtype=bool)
    columns = np.ascontiguousarray(right.T)
    for a in range(0, len(left), SIGN_BLOCK):
        most = most_apart(x[a : a + SIGN_BLOCK, None], y[None, :], percent)
        apart = np.zeros(most.shape, dtype=np.int32)
        for k in range(len(columns)):
            apart += np.bitwise_count(left[a : a + SIGN_BLOCK, k, None] ^ columns[k][None, :])
            if k % 16 == 15 and not (apart <= most).any():
                break
        out[a : a + SIGN_BLOCK] = apart <= most
    return out


class _Filter:
    """Membership of 64-bit keys in a bit table; members are never missed."""

    def __init__(self, words: np.ndarray):
        self.words, self.shift = words, np.uint64(64 - 6 - (len(words).bit_length() - 1))

    def has(self, keys: np.ndarray) -> np.ndarray:
        bit = mix(keys.view(np.uint64)) >> self.shift
        return (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0


def _filter_of(keys: DataFrame) -> bytes:
    """A filter of one long column, about 16 bits a key up to its bound: bits are set in tasks and combined before they meet."""
    size = max(FILTER_BITS, min(MOST_FILTER_BITS, (16 * keys.count()).bit_length()))
    n_words, shift = 1 << (size - 6), np.uint64(64 - size)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(n_words, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for batch in batches:
                bit = mix(batch.column(0).to_numpy().view(np.uint64)) >> shift
                np.bitwise_or.at(words, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(words[at].view(np.int64))], names=["word", "bits"])

    table = keys.mapInArrow(bits, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(n_words, dtype=np.uint64)
    words[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return words.tobytes()


def _sketch_bits(texts: DataFrame) -> int:
    """More counters for more than 1024 partitions of the input, up to a bound."""
    return max(SKETCH_BITS, min(MOST_SKETCH_BITS, SKETCH_BITS + (texts.rdd.getNumPartitions() >> 10).bit_length()))


def _first_pass(texts: DataFrame, bits: int) -> DataFrame:
    """Staged: a row for each document (doc_id, n, set name, hash), and each task's part of the count sketch of 2**bits counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "name", "hash", "part", "counts"]
        sketch = np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            sizes, sets, keys = [], [], []
            for own in shingle_sets(batch.column(1)):
                sizes.append(len(own))
                sets.append(fingerprint(own) if len(own) else 0)
                keys.append(own >> np.uint64(64 - bits))
                if len(keys) == 500:
                    sketch += np.bincount(np.concatenate(keys).astype(np.int64), minlength=len(sketch))
                    keys = []
            if keys:
                sketch += np.bincount(np.concatenate(keys).astype(np.int64), minlength=len(sketch))
            nothing = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sets, pa.int64()), batch.column(2), pa.nulls(nothing, pa.int32()), pa.nulls(nothing, pa.binary())], names=names)
        parts = [x.astype("<u4").tobytes() for x in np.minimum(sketch, 0xFFFFFFFF).reshape(SKETCH_ROWS, -1)]
        own = [(i, p) for i, p in enumerate(parts) if any(p)]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(own), pa.int64())] * 4 + [pa.array([i for i, _ in own], pa.int32()), pa.array([p for _, p in own], pa.binary())], names=names)

    return stage(texts.mapInArrow(run, "doc_id long, n long, name long, hash long, part int, counts binary"), "ngram-rows")


def _sketch(first: DataFrame, bits: int) -> np.ndarray:
    """The whole corpus's counts, 2**bits numbers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(counts.as_py(), "<u4").astype(np.uint64)
                sums[part] = sums[part] + own if part in sums else own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(x, 0xFFFFFFFF).astype("<u4").tobytes() for x in sums.values()], pa.binary())], names=["part", "counts"])

    rows = first.where("part is not null").select("part", "counts").repartition("part").mapInArrow(add, "part int, counts binary").collect()
    out = np.zeros((SKETCH_ROWS, (1 << bits) // SKETCH_ROWS), dtype=np.uint32)
    for r in rows:
        out[r["part"]] = np.frombuffer(r["counts"], "<u4")
    return out.reshape(-1)


def _prefixes(texts: DataFrame, sketch, percent: int, reps, only=None) -> DataFrame:
    """(shingle, set name, size, place) of each row's prefix, and of a row with any a further one with its signature alone; each set once a task.

    ``reps``: a filter of the ids that stand for their set; ``only``: one of shingles' first ``KEY_BITS`` bits. Without
    it the rows are (bucket, keys): these bits alone, sorted, a key that several sets have at least twice.
    """
    drop, low = np.uint64(64 - KEY_BITS), np.uint64(KEY_BITS - BUCKET_BITS)

    def packed(keys: list[np.ndarray]) -> pa.RecordBatch:
        every = np.sort(np.concatenate(keys).view(np.uint64) >> drop) if keys else np.zeros(0, np.uint64)
        twice = np.concatenate([every[:2], every[2:][every[2:] != every[:-2]]])  # no key more than twice
        bucket = (twice >> low).astype(np.int32)
        at = np.flatnonzero(np.diff(bucket, prepend=-1))
        parts = np.split((twice & np.uint64((1 << int(low)) - 1)).astype("<u4"), at[1:]) if len(at) else []
        return pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["bucket", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(sketch.value, np.uint32)
        shift = np.uint64(64 - (len(counts).bit_length() - 1))
        wanted = _Filter(np.frombuffer(only.value, np.uint64)) if only is not None else None
        standing = _Filter(np.frombuffer(reps.value, np.uint64))
        seen: set[int] = set()
        loose, n_loose = [], 0
        with np.errstate(over="ignore"):
            for batch in batches:
                batch = _standing(batch, standing)
                keys, names, sizes, places, signs = [], [], [], [], []

                def flush() -> pa.RecordBatch:
                    at = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
                    own = [np.array(names, dtype=np.int64), np.array(sizes, dtype=np.int32)]
                    each = [np.concatenate([np.repeat(c, [len(k) for k in keys]), c]) for c in own]
                    n, nothing = sum(map(len, keys)), len(names)
                    first, last = (pa.concat_arrays([pa.array(c), pa.nulls(nothing, t)]) for c, t in ((at(keys, np.int64), pa.int64()), (at(places, np.int32), pa.int32())))
                    return pa.RecordBatch.from_arrays([first, pa.array(each[0]), pa.array(each[1]), last, pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(signs, pa.binary())])], names=["shingle", "name", "n", "place", "sign"])

                held = 0
                for own in shingle_sets(batch.column(1)):
                    if not len(own):
                        continue
                    name = fingerprint(own)
                    if name in seen:
                        continue
                    seen.add(name)
                    k = prefix_length(len(own), percent)
                    rank = counts[(own >> shift).astype(np.int64)]
                    first = np.lexsort((own, rank))[:k]
                    place = np.arange(k, dtype=np.int32)
                    key = own[first]
                    if wanted is None:
                        loose.append(key)
                        n_loose += len(key)
                        if n_loose >= KEYS:
                            yield packed(loose)
                            loose, n_loose = [], 0
                        continue
                    keep = wanted.has(key >> drop)
                    key, place = key[keep], place[keep]
                    if not len(key):
                        continue
                    keys.append(_signed(key))
                    names.append(name)
                    sizes.append(len(own))
                    places.append(place)
                    signs.append(signature(own))
                    held += len(key)
                    if held > 200_000:
                        yield flush()
                        keys, names, sizes, places, signs, held = [], [], [], [], [], 0
                if wanted is not None:
                    yield flush()
            if wanted is None:
                yield packed(loose)

    return texts.mapInArrow(run, "shingle long, name long, n int, place int, sign binary" if only is not None else "bucket int, keys binary")


def _standing(batch: pa.RecordBatch, reps: _Filter) -> pa.RecordBatch:
    """The rows of a batch whose id may stand for a set, and those without an id."""
    ids = batch.column(0)
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    return batch.filter(pa.array(~known | reps.has(ids.fill_null(0).to_numpy())))


def _shared_keys(packed: DataFrame) -> DataFrame:
    """(key): the shingles' first bits that are there twice or more, of (bucket, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def several() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint32)
            keys = np.unique(keys[1:][keys[1:] == keys[:-1]]).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(keys + ((at or 0) << (KEY_BITS - BUCKET_BITS)), pa.int64())], names=["key"])

        for batch in batches:
            for bucket, keys in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != at:
                    yield several()
                    held, at = [], bucket
                held.append(np.frombuffer(keys.as_py(), "<u4"))
        yield several()

    parts = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "key long")


def _sets(texts: DataFrame, wanted, reps) -> DataFrame:
    """(name, set as bytes) of the sets a filter asks for, each once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, seen = _Filter(np.frombuffer(wanted.value, np.uint64)), set()
        standing = _Filter(np.frombuffer(reps.value, np.uint64))
        with np.errstate(over="ignore"):
            for batch in batches:
                batch = _standing(batch, standing)
                own = [(fingerprint(s), s) for s in shingle_sets(batch.column(1)) if len(s)]
                hit = asked.has(np.array([n for n, _ in own], dtype=np.int64)) if own else []
                names, sets = [], []
                for (name, s), yes in zip(own, hit, strict=True):
                    if yes and name not in seen:
                        seen.add(name)
                        names.append(name)
                        sets.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], names=["name", "grams"])

    return texts.mapInArrow(run, "name long, grams binary")


def _light_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of rows that share light columns, where overlap and what is left reach the need of their sizes."""
    x = members.groupBy("shingle").agg(F.array_sort(F.collect_set(F.struct("name", "n", "place"))).alias("m"))  # at most LIGHT rows each
    pairs = x.select(F.posexplode("m").alias("i", "a"), "m").select("a", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("b"))
    sized = pairs.where((F.col("a.name") != F.col("b.name")) & (100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")))
    summed = sized.select(F.col("a.name").alias("a"), F.col("b.name").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb"), F.col("a.place").alias("pa"), F.col("b.place").alias("pb"))
    summed = summed.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("overlap"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    bound = F.col("overlap") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) - 1
    return summed.where(bound >= F.ceil(percent * (F.col("na") + F.col("nb")) / F.lit(100.0 + percent))).select("a", "b")


def _product(indptr: np.ndarray, grams: np.ndarray, n: int, cut: int) -> np.ndarray:
    """Overlaps of rows before ``cut`` with rows from ``cut`` on (with all where cut is n), by blocks of columns."""
    rows = np.repeat(np.arange(n), np.diff(indptr))
    order = np.argsort(grams, kind="stable")
    keys, rows = grams[order], rows[order]
    fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
    column = np.cumsum(fresh) - 1
    common = np.bincount(column)[column] > 1
    column = np.cumsum(np.concatenate([[False], (column[common][1:] != column[common][:-1])])) if common.any() else column[:0]
    rows = rows[common]
    left, right = (slice(0, n), slice(0, n)) if cut >= n else (slice(0, cut), slice(cut, n))
    total = np.zeros((left.stop - left.start, right.stop - right.start), dtype=np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + COLUMNS])
        block = np.zeros((n, min(COLUMNS, int(column[hi - 1]) - a + 1)), dtype=np.float32)
        block[rows[lo:hi], column[lo:hi] - a] = 1
        total += block[left] @ block[right].T
    return total


def _cell_links(rows: list[tuple], percent: int, same: bool) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links in one cell."""
    names, sets, sides = [], [], []
    for side, name, grams in rows:
        names.append(name)
        sides.append(side)
        sets.append(np.frombuffer(grams, np.uint64))
    n, sizes = len(names), np.array([len(s) for s in sets])
    cut = n if same else int(np.searchsorted(np.array(sides), 1))
    if n < 2 or cut == 0 or (not same and cut == n):
        return
    overlap = _product(np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(sets), n, cut)
    left, right = np.arange(cut), np.arange(n) if same else np.arange(cut, n)
    linked = 100 * overlap.astype(np.int64) >= percent * (sizes[left][:, None] + sizes[right][None, :] - overlap.astype(np.int64))
    if same:
        np.fill_diagonal(linked, False)
    forest = Forest(n)
    forest.join_matrix(linked, left, right)
    for a, b in forest.links:
        yield names[a], names[b]


def _grouped(rows: DataFrame, n_key: int, work: Callable, schema: str, names: list[str]) -> DataFrame:
    """Apply ``work`` to each run of rows with equal first columns; rows come sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, out = [], None, []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * len(names))], names=names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:n_key] != key:
                    if held:
                        out.extend(work(key, held))
                    held, key = [], row[:n_key]
                held.append(row[n_key:])
            if len(out) > 20_000:
                yield flush()
                out = []
        if held:
            out.extend(work(key, held))
        yield flush()

    return rows.mapInArrow(run, schema)


def _may_reach(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose signatures don't rule out that they reach their need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = most_apart(*(batch.column(c).to_numpy().astype(np.int64) for c in ("na", "nb")), percent)
            apart = [int(np.bitwise_count(np.bitwise_xor(*_folded([a.as_py(), b.as_py()]))).sum()) for a, b in zip(batch.column("sa"), batch.column("sb"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(np.array(apart, dtype=np.int64) <= most, pa.bool_()))

    # As in _verify, a leader's join comes last.
    with_b = pairs.join(signs.select(F.col("name").alias("b"), F.col("n").alias("nb"), F.col("sign").alias("sb")), "b")
    return with_b.join(signs.select(F.col("name").alias("a"), F.col("n").alias("na"), F.col("sign").alias("sa")), "a").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _cell_partners(key: tuple, rows: list[tuple], percent: int) -> Iterator[tuple]:
    """The rows of a cell of signatures that may have a link, in cells of at most ``CHUNK`` rows a side.

    Rows (side, name, n, tied, sign); those of one ``tied`` need no comparing. The new cells'
    numbers follow from the old ones, so that equal ones still stand for a chunk with itself.
    """
    names, sizes, tied = (np.array([r[i] for r in rows], dtype=np.int64) for i in (1, 2, 3))
    same, signs = key[2] == key[3], _folded([r[4] for r in rows])
    cut = sum(not r[0] for r in rows)
    left, right = (np.arange(len(rows)),) * 2 if same else (np.arange(cut), np.arange(cut, len(rows)))
    may = _possible(signs[left], signs[right], sizes[left], sizes[right], percent)
    for a in range(0, len(left), SIGN_BLOCK):
        may[a : a + SIGN_BLOCK] &= tied[left[a : a + SIGN_BLOCK], None] != tied[right][None, :]
    in_left, in_right = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
    cells = SIGN_CHUNK
    for i, a in enumerate(range(0, len(in_left), CHUNK)):
        for j, b in enumerate(range(0, len(in_right), CHUNK)):
            if same and j < i:
                continue
            own_left, own_right = in_left[a : a + CHUNK], in_right[b : b + CHUNK]
            block = may[np.ix_(own_left, own_right)]
            at = (*key[:2], key[2] * cells + i, key[3] * cells + j)
            yield from ((*at, 0, int(names[left[r]])) for r in own_left[block.any(1)])
            if not (same and i == j):
                yield from ((*at, 1, int(names[right[r]])) for r in own_right[block.any(0)])


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that reach their need over all columns; overlaps add up by blocks of columns."""
    edges = np.array([1 << 62, 2 << 62, 3 << 62], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("ga"), batch.column("gb"), strict=True):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                least, overlap = need(len(x), len(y), percent), 0
                cx, cy = ([0, *np.searchsorted(s, edges).tolist(), len(s)] for s in (x, y))
                for k in range(4):
                    overlap += len(np.intersect1d(x[cx[k] : cx[k + 1]], y[cy[k] : cy[k + 1]], assume_unique=True))
                    if overlap + min(len(x) - cx[k + 1], len(y) - cy[k + 1]) < least:
                        break
                keep.append(overlap >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # A leader is the first of many pairs, so its join comes last, where Spark can split it.
    with_b = pairs.join(sets.select(F.col("name").alias("b"), F.col("grams").alias("gb")), "b")
    return with_b.join(sets.select(F.col("name").alias("a"), F.col("grams").alias("ga")), "a").select("a", "b", "ga", "gb").mapInArrow(run, "a long, b long")


def _links(docs: DataFrame, text_col: str, id_col: str, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (doc_id, n, set name, hash of the text), sets (name, least doc_id) and the links between sets; all jobs that see texts or sets end here."""
    spark = docs.sparkSession
    context = spark.sparkContext
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    bits = _sketch_bits(texts)
    first = _first_pass(texts.withColumn("hash", F.xxhash64("text")), bits)
    rows = first.where("part is null").select("doc_id", "n", "name", "hash")
    classes = rows.where("n > 0").groupBy("name").agg(F.min("doc_id").alias("rep"))
    sketch = context.broadcast(_sketch(first, bits).tobytes())

    reps = context.broadcast(_filter_of(classes.where("rep is not null").select("rep")))
    # What several sets share is told from short keys first; few shingles are left to move with their sets.
    columns = context.broadcast(_filter_of(stage(_shared_keys(_prefixes(texts, sketch, percent, reps)), "ngram-keys")))
    found = stage(_prefixes(texts, sketch, percent, reps, columns), "ngram-prefixes")
    counted = found.where("shingle is not null").groupBy("shingle").agg(F.count("*").alias("rows"), F.min("name").alias("low"), F.max("name").alias("high"))
    signs = found.where("sign is not null").select("name", "n", "sign").dropDuplicates(["name"])
    members = stage(found.join(counted.where("low <> high").select(again("shingle"), "rows", "low"), "shingle").select("shingle", "name", "n", "place", "rows", "low"), "ngram-members")

    light = _light_pairs(members.where(F.col("rows") <= LIGHT), percent)
    heavy = members.where(F.col("rows") > LIGHT)
    pairs = stage(_may_reach(light.union(_leader_pairs(heavy, percent)).distinct(), signs, percent), "ngram-pairs")

    def sets_of(names: DataFrame) -> DataFrame:
        return _sets(texts, context.broadcast(_filter_of(names)), reps).dropDuplicates(["name"])

    # Sets are dealt by name once, and joined as they lie.
    near = stage(_verify(pairs, sets_of(pairs.select("a").union(pairs.select("b"))), percent), "ngram-near")
    tied = stage(connected_components(near), "ngram-tied")
    left = stage(_untied(heavy, tied), "ngram-untied")
    if not left.limit(1).count():
        return rows, classes, tied

    # A row is in the class of its size and the next one; sizes that reach the need share a class.
    own = F.floor(F.log(F.col("n").cast("double")) / math.log(1.0001 * 100 / percent)).cast("int")
    placed = connected_components(left.select("low", "name")).join(left.select(F.col("name").alias("node"), "n").distinct(), "node")
    placed = placed.select("node", "component", "n", F.explode(F.array(own, own + 1)).alias("class"))
    groups = placed.groupBy("component", "class").agg(F.count("*").alias("size"), F.max("n").alias("most")).where("size > 1").select(again("component"), again("class"), "size", "most")
    keys = ["component", "class", "cell_i", "cell_j"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def dealt(cells: DataFrame, *columns: str) -> DataFrame:
        return cells.select(*keys, "side", "name", *columns).repartition(parts, *keys).sortWithinPartitions(*keys, "side", "name")

    # Signatures go over large cells first; sets follow for those rows that they leave a partner.
    weight = F.greatest(F.lit(1.0), F.col("most") / F.lit(8.0 * SIGN_BYTES))
    signed = to_cells(placed.join(groups, ["component", "class"]), ["component", "class"], "node", F.col("size") * weight, SIGN_CHUNK).select(*keys, "side", F.col("node").alias("name"))
    signed = signed.join(signs, "name").join(tied.select(F.col("node").alias("name"), F.col("component").alias("tied")), "name", "left").withColumn("tied", F.coalesce("tied", "name"))
    cells = stage(_grouped(dealt(signed, "n", "tied", "sign"), 4, lambda key, held: _cell_partners(key, held, percent), "component long, class long, cell_i long, cell_j long, side long, name long", [*keys, "side", "name"]), "ngram-cells")
    with_sets = dealt(cells.join(sets_of(cells.select("name").distinct()), "name"), "grams")
    in_cells = _grouped(with_sets, 4, lambda key, held: _cell_links(held, percent, key[2] == key[3]), "a long, b long", ["a", "b"])
    return rows, classes, stage(tied.union(in_cells), "ngram-links")


def _leader_pairs(heavy: DataFrame, percent: int) -> DataFrame:
    """(a, b): each row of a column with the column's least row, where their sizes can reach the need."""
    leaders = heavy.where("name = low").select(F.col("low").alias("a"), F.col("n").alias("na")).distinct()
    pairs = heavy.where("name <> low").select(F.col("low").alias("a"), F.col("name").alias("b"), F.col("n").alias("nb")).distinct()
    return pairs.join(leaders.select(again("a"), "na"), "a").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b")


def _untied(heavy: DataFrame, tied: DataFrame) -> DataFrame:
    """The rows of those columns whose rows are not of one component yet."""
    marked = heavy.select("shingle", "name", "n", "low").join(tied.select(F.col("node").alias("name"), "component"), "name", "left").withColumn("component", F.coalesce("component", "name"))
    several = marked.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select(again("shingle"))
    return marked.join(several, "shingle").select("name", "n", "low").distinct()


def _components(docs: DataFrame, text_col: str, id_col: str, percent: int) -> DataFrame:
    """Per document: doc_id, n, hash of the text, component of its set (null without shingles) and the least doc_id in it."""
    spark = docs.sparkSession
    ship_package(spark)
    with arrow_batches(spark, 1000):
        rows, classes, links = _links(docs, text_col, id_col, percent)
    # On set names, so that a set whose rows have no id still ties its neighbours together.
    tied = connected_components(links)
    named = classes.join(tied, classes["name"] == tied["node"], "left").select("name", "rep", F.coalesce("component", "name").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id")).select(again("component"), "component_id")
    per_class = named.join(least, "component").select("name", "component", "component_id")
    return rows.join(per_class, "name", "left")


def jaccard_components(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least doc_id that links reach)."""
    out = _components(docs, text_col, id_col, percent)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", percent: int = 80) -> DataFrame:
    """One row of each component, the first by id (nulls last), then by the text's hash. Columns stay.

    Rows are told apart by id and text, so other texts under an id stay. Rows without
    shingles stay; those that repeat an id and a text stay once.
    """
    found = stage(_components(docs, text_col, id_col, percent).select("doc_id", "hash", "n", "component"), "ngram-components")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("hash"))
    first = found.where("n > 0").groupBy("component").agg(F.min(place).alias("first")).select(again("component"), "first")
    gone = found.where("n > 0").join(first, "component").where(~place.eqNullSafe(F.col("first"))).select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash")).distinct()
    kept = docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone["__id"]) & (F.xxhash64(docs[text_col]) == gone["__hash"]), "left_anti")
    repeated = found.where("n > 0 or doc_id is not null").groupBy("doc_id", "hash").count().where("count > 1")
    if not repeated.limit(1).count():
        return kept
    loose = F.col(id_col).isNull() & ~F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return kept.where(~loose).dropDuplicates([id_col, text_col]).unionByName(kept.where(loose))
