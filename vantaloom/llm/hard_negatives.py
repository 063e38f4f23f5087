"""Hard negatives by a pivot table over augmented vectors.

A row x gets one more component, sqrt(M^2 - |x|^2) with M the largest norm, and an anchor q
a zero: then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so a larger inner product is a smaller
Euclidean distance. Distances of all rows to a few pivots are stored with the
rows, and the triangle inequality turns them into brackets: a row's distance to an anchor
lies between max |d(q,p) - d(x,p)| and min (d(q,p) + d(x,p)). What a bracket rules out
is never multiplied; survivors are scored exactly.

Rows are sorted by label, nearest pivot and distance to it, and cut into blocks of at most
``BLOCK`` rows that carry the box of their pivot distances; anchors likewise. Blocks meet in
``slabs``: an anchor block goes to every slab, a row block to one, so what moves is rows once
and anchors once a slab, and neither side is held whole anywhere. A pair of blocks whose boxes
cannot reach the anchors' bounds is dropped before its vectors leave the join; in a task, rows
are then left out by their own distances. Three rounds: exact scores of rows close to the
pivots bound each anchor's k-th best score from below; the positives are searched above that
bound; the negatives within the windows that the positives' scores open.

Cases: rows with a null id, label or vector, or a null or non-finite component take no part. Vectors
of different lengths have no score; an empty vector scores 0 with empty ones. Rows that repeat
in id, label and vector are one row; rows that share an id only are different rows, but none is a
result of an anchor with its id, and anchors that share an id give equal results once. Ties go by the smaller id. Scores are sums of
integer products in double precision, exact below 2**53; beyond the range of a long they are cut to it. An
empty table gives an empty result. Columns other than these three are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vantaloom.sources.runtime import arrow_batches, ship_package, stage

PIVOTS, SAMPLE, BLOCK, ANCHOR_BLOCK = 16, 2048, 1024, 256
SEEDS = 8  # rows near each pivot, of each label, that give the first bounds
BATCH = 8  # pairs of blocks that a task takes at a time
KEPT = 200_000  # results that a task merges before it hands them on
_BOX = "lo array<double>, hi array<double>"
_ASKED = ("ids", "labels", "vectors", "dists", "low", "high", "first")
_BLOCK = f"dim int, first_label long, last_label long, n int, {_BOX}, ids binary, labels binary, vectors binary, dists binary"


def prepare(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(id, label, v) of the rows that take part; components are floor(256 x)."""
    v = F.col(vector_col)
    sound = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull()
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * 256).cast("double"))
    return vectors.where(sound).where(finite).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole.alias("v")).dropDuplicates()


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _augmented(x: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(top - np.einsum("ij,ij->i", x, x), 0.0))[:, None]])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    gap = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", pivots, pivots)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(gap, 0.0))


def fit(rows: DataFrame, n_pivots: int = PIVOTS, sample: int = SAMPLE) -> dict[int, tuple[float, np.ndarray]]:
    """By vector length: the largest squared norm of all rows, and pivots of a bounded sample, each far from those before."""
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    tops = {r["dim"]: r["top"] for r in rows.groupBy(F.size("v").alias("dim")).agg(F.max(norm).alias("top"), F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(64).collect()}
    # Rows of any further lengths have no pivots, and nothing is ruled out for them.
    drawn = _least_hashes(rows, sample).orderBy(F.xxhash64("id", "v")).limit(sample).select("v").collect()
    out = {}
    for dim, top in tops.items():
        own = [r[0] for r in drawn if len(r[0]) == dim]
        x = _augmented(np.array(own, dtype=np.float64).reshape(len(own), dim), top)
        chosen = [0] if len(x) else []
        while chosen and len(chosen) < min(n_pivots, len(x)):
            nearest = _distances(x, x[chosen]).min(1)
            chosen.append(int(nearest.argmax()))
        out[dim] = (top, x[chosen] if chosen else np.zeros((1, dim + 1)))
    return out


def _least_hashes(rows: DataFrame, sample: int) -> DataFrame:
    """About 4 * ``sample`` rows of least hashes, all where they are fewer: a sorted limit sends the driver ``sample`` rows from every task, however many tasks there are."""
    share = 4 * sample / max(rows.count(), 1)
    return rows if share >= 1 else rows.where(F.xxhash64("id", "v") < F.lit(int(share * 2**64) - 2**63))


def _pivoted(rows: DataFrame, model: dict, anchors: bool) -> DataFrame:
    """Rows with their distances to the pivots, the nearest pivot and its distance; anchors have a zero for the further component."""
    ship_package(rows.sparkSession)
    held = rows.sparkSession.sparkContext.broadcast(model)  # at most 64 lengths x PIVOTS vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                x = _matrix(part.column(2), int(dim))
                top, pivots = held.value.get(int(dim), (0.0, np.zeros((1, dim + 1))))
                d = _distances(np.hstack([x, np.zeros((len(x), 1))]) if anchors else _augmented(x, top), pivots)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(np.full(len(x), dim, np.int32)), pa.array(list(d), pa.list_(pa.float64())), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(x)), near])],
                    names=["id", "label", "v", "dim", "d", "near", "at"],
                )

    return rows.select("id", "label", "v").mapInArrow(run, "id long, label long, v array<double>, dim int, d array<double>, near int, at double")


def blocks(pivoted: DataFrame, most: int) -> DataFrame:
    """Blocks of rows alike in label and place: their box, and ids, labels, vectors and pivot distances as bytes."""
    layout = pa.schema([("dim", pa.int32()), ("first_label", pa.int64()), ("last_label", pa.int64()), ("n", pa.int32()), *[(c, pa.list_(pa.float64())) for c in ("lo", "hi")], *[(c, pa.binary()) for c in _ASKED[:4]]])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            cuts = np.flatnonzero(np.diff(dims)) + 1
            out = []
            for lo, hi in zip([0, *cuts], [*cuts, len(dims)], strict=True):
                for at in range(lo, hi, most):
                    part = batch.slice(at, min(most, hi - at))
                    labels, d = part.column(1).to_numpy(), np.stack(part.column(4).to_numpy(zero_copy_only=False))
                    row = {"dim": int(dims[lo]), "first_label": int(labels.min()), "last_label": int(labels.max()), "n": part.num_rows, "lo": d.min(0).tolist(), "hi": d.max(0).tolist()}
                    out.append(row | {"ids": part.column(0).to_numpy().tobytes(), "labels": labels.tobytes(), "vectors": _matrix(part.column(2), int(dims[lo])).tobytes(), "dists": d.tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=layout)

    order = ["dim", "label", "near", "at", "id"]
    n = int(pivoted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with arrow_batches(pivoted.sparkSession, most):
        return stage(pivoted.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(pack, _BLOCK), "blocks")


def _seed_bounds(anchors: DataFrame, pivoted: DataFrame, k: int) -> DataFrame:
    """(id, label, v, floor): the k-th best exact score among rows of the anchor's label that lie close to a pivot."""
    near = Window.partitionBy("dim", "label", "near").orderBy("at", "id")
    seeds = pivoted.withColumn("__n", F.row_number().over(near)).where(F.col("__n") <= SEEDS).select("dim", "label", F.col("id").alias("seed"), F.col("v").alias("w"))
    seeds = stage(seeds, "seeds")
    dot = F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    same = anchors.select("id", "label", "dim", F.xxhash64("v").alias("hash"), "v").join(seeds, ["dim", "label"]).where(F.col("id") != F.col("seed"))
    best = Window.partitionBy("id", "label", "hash").orderBy(F.desc("score"), "seed")
    scored = same.select("id", "label", "hash", "seed", dot.alias("score")).withColumn("place", F.row_number().over(best))
    return scored.where(F.col("place") == k).select("id", "label", "hash", F.col("score").alias("floor"))


def _meet(anchor_blocks: DataFrame, row_blocks: DataFrame, slabs: int, condition) -> DataFrame:
    """Pairs of blocks that can hold a result: equal lengths, boxes within reach, and ``condition``."""
    a = anchor_blocks.select(*[F.col(c).alias(f"a_{c}") for c in anchor_blocks.columns]).withColumn("a_slab", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))))
    r = row_blocks.withColumn("slab", F.pmod(F.xxhash64("ids", "labels"), F.lit(slabs)).cast("int"))
    # The gap between the boxes in each pivot's distance is a lower bound on every distance of the pair of blocks.
    gaps = F.zip_with(F.zip_with("a_lo", "hi", lambda x, y: x - y), F.zip_with("lo", "a_hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y))
    reach = F.array_max(gaps) <= F.col("a_reach")
    # Merged, since either side, if it were broadcast, would pass the driver with its vectors.
    pairs = a.repartition(slabs, "a_slab").hint("merge").join(r.repartition(slabs, "slab"), F.col("a_slab") == F.col("slab"))
    return pairs.where((F.col("a_dim") == F.col("dim")) & reach & condition)


def _reach(q: np.ndarray, top: float, floor: np.ndarray) -> np.ndarray:
    """The distance beyond which scores are under ``floor``; a little more, for rounding."""
    square = np.einsum("ij,ij->i", q, q) + top - 2 * floor
    return np.sqrt(np.maximum(square, 0.0)) * (1 + 1e-9) + 1e-6 + 1e-7 * np.sqrt(np.abs(top))


def _within(q: np.ndarray, top: float, ceiling: np.ndarray) -> np.ndarray:
    """The distance under which scores are over ``ceiling``; a little less, for rounding."""
    square = np.einsum("ij,ij->i", q, q) + top - 2 * ceiling
    return np.sqrt(np.maximum(square, 0.0)) * (1 - 1e-9) - 1e-6 - 1e-7 * np.sqrt(np.abs(top))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, by score and then id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _search(pairs: DataFrame, model: dict, k: int, negatives: bool) -> DataFrame:
    """The k best of each pair of blocks for each anchor (and window, for negatives), merged within a task."""
    ship_package(pairs.sparkSession)
    held = pairs.sparkSession.sparkContext.broadcast({dim: top for dim, (top, _) in model.items()})
    names = ["a_dim", "a_ids", "a_labels", "a_vectors", "a_dists", "a_low", "a_high", "a_first", "ids", "labels", "vectors", "dists"]

    def found(row: dict) -> Iterator[tuple[np.ndarray, ...]]:
        dim, top = row["a_dim"], held.value.get(row["a_dim"])
        aid, alabel, low, high, first = (np.frombuffer(row[c], t) for c, t in (("a_ids", np.int64), ("a_labels", np.int64), ("a_low", np.float64), ("a_high", np.float64), ("a_first", np.int64)))
        q, ad = np.frombuffer(row["a_vectors"]).reshape(len(aid), dim), np.frombuffer(row["a_dists"]).reshape(len(aid), -1)
        ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        x, d = np.frombuffer(row["vectors"]).reshape(len(ids), dim), np.frombuffer(row["dists"]).reshape(len(ids), -1)
        if top is not None:
            # By the triangle inequality: rows no anchor reaches, then anchors that reach none of the rows left.
            far = _reach(q, top, low)
            stay = np.maximum(ad.min(0) - d, d - ad.max(0)).max(1) <= far.max()
            if negatives:  # rows so close to all anchors that their scores lie over every window
                stay &= (ad.max(0) + d).min(1) >= _within(q, top, high).min()
            ids, labels, x, d = ids[stay], labels[stay], x[stay], d[stay]
            if not len(ids):
                return
            near = np.maximum(ad - d.max(0), d.min(0) - ad).max(1) <= far
        else:
            near = np.ones(len(aid), bool)
        at = np.flatnonzero(near)
        scores = q[at] @ x.T
        for i, s in zip(at, scores, strict=True):
            if negatives:
                fits = np.flatnonzero((labels != alabel[i]) & (ids != aid[i]) & (100 * s >= 80 * high[i]) & (s <= high[i]))
            else:
                fits = np.flatnonzero((labels == alabel[i]) & (s >= low[i]) & (ids != aid[i]))
            if len(fits):
                best = fits[_best(s[fits], ids[fits], k)]
                yield first[i], ids[best], s[best]

    def merge(kept: dict) -> pa.RecordBatch:
        of = np.concatenate([np.full(len(i), key) for key, (i, _) in kept.items()] or [np.zeros(0, np.int64)])
        return pa.RecordBatch.from_arrays(
            [pa.array(of.astype(np.int64)), pa.array(np.concatenate([i for i, _ in kept.values()] or [np.zeros(0, np.int64)])), pa.array(np.concatenate([s for _, s in kept.values()] or [np.zeros(0)]))],
            names=["anchor", "id", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for n in range(batch.num_rows):
                for key, ids, scores in found({c: batch.column(c)[n].as_py() for c in names}):
                    if key in kept:
                        ids, scores = np.concatenate([kept[key][0], ids]), np.concatenate([kept[key][1], scores])
                        best = _best(scores, ids, k)
                        ids, scores = ids[best], scores[best]
                    kept[key] = ids, scores
                if len(kept) * k > KEPT:
                    yield merge(kept)
                    kept = {}
        yield merge(kept)

    with arrow_batches(pairs.sparkSession, BATCH):
        return stage(pairs.select(*names).mapInArrow(run, "anchor long, id long, score double"), "found")


def _asked(anchors: DataFrame, model: dict, most: int) -> DataFrame:
    """Blocks of questions: anchors with ``number``, ``low`` and ``high``; adds their bounds as bytes and the blocks' reach."""
    held = anchors.sparkSession.sparkContext.broadcast({dim: top for dim, (top, _) in model.items()})
    layout = pa.schema([("dim", pa.int32()), ("first_label", pa.int64()), ("last_label", pa.int64()), ("reach", pa.float64()), *[(c, pa.list_(pa.float64())) for c in ("lo", "hi")], *[(c, pa.binary()) for c in _ASKED]])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.to_pandas()
            out = []
            for dim, same in t.groupby("dim", sort=False):
                for at in range(0, len(same), most):
                    p = same.iloc[at : at + most]
                    v, d = np.stack(p["v"].to_numpy()).reshape(len(p), dim), np.stack(p["d"].to_numpy())
                    top = held.value.get(dim)
                    low = p["low"].to_numpy(np.float64)
                    reach = float(_reach(v, top, low).max()) if top is not None else float("inf")
                    row = {"dim": int(dim), "first_label": int(p["label"].min()), "last_label": int(p["label"].max()), "reach": reach, "lo": d.min(0).tolist(), "hi": d.max(0).tolist()}
                    raw = {"ids": p["id"].to_numpy(np.int64), "labels": p["label"].to_numpy(np.int64), "vectors": v, "dists": d, "low": low, "high": p["high"].to_numpy(np.float64), "first": p["number"].to_numpy(np.int64)}
                    out.append(row | {c: np.ascontiguousarray(b).tobytes() for c, b in raw.items()})
            yield pa.RecordBatch.from_pylist(out, schema=layout)

    order = ["dim", "label", "near", "at", "id"]
    n = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = f"dim int, first_label long, last_label long, reach double, {_BOX}, " + ", ".join(f"{c} binary" for c in _ASKED)
    with arrow_batches(anchors.sparkSession, most):
        return stage(anchors.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(pack, schema), "asked")


def mine(rows: DataFrame, is_anchor, n_positives: int = 5, n_negatives: int = 5, n_pivots: int = PIVOTS, block: int = BLOCK, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """Hard negatives of each anchor and positive; ``rows`` is what ``prepare`` gives, ``is_anchor`` a condition on its id.

    Columns: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = rows.sparkSession
    rows = stage(rows, "rows")
    model = fit(rows, n_pivots)
    pivoted = stage(_pivoted(rows, model, False), "pivoted")
    packed = blocks(pivoted, block)
    slabs = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    anchors = _pivoted(rows.where(is_anchor), model, True).withColumn("hash", F.xxhash64("v"))
    # An anchor's number is a hash of the whole row, so that it is the same in every attempt.
    anchors = stage(anchors.withColumn("number", F.xxhash64("id", "label", "v")), "anchors")
    floors = _seed_bounds(anchors, pivoted, n_positives)
    asked = anchors.join(floors, ["id", "label", "hash"], "left").withColumn("low", F.coalesce("floor", F.lit(float("-inf")))).withColumn("high", F.lit(float("inf")))
    mine_label = (F.col("a_first_label") <= F.col("last_label")) & (F.col("first_label") <= F.col("a_last_label"))
    hits = _search(_meet(_asked(asked, model, anchor_block), packed, slabs, mine_label), model, n_positives, False)
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    positives = hits.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n_positives)
    positives = stage(positives.select("anchor", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # A window with an upper end under 0 is empty, as its lower end lies above.
    windows = positives.where("positive_score >= 0").select("anchor", F.col("positive_score").alias("high")).distinct()
    windows = windows.join(anchors, windows["anchor"] == anchors["number"]).drop("anchor")
    windows = windows.withColumn("low", 0.8 * F.col("high") - 1e-6 * F.col("high")).withColumn("of", F.col("number")).withColumn("number", F.xxhash64("number", "high"))
    windows = stage(windows, "windows")
    other_label = ~((F.col("a_first_label") == F.col("a_last_label")) & (F.col("first_label") == F.col("last_label")) & (F.col("a_first_label") == F.col("first_label")))
    wrong = _search(_meet(_asked(windows, model, anchor_block), packed, slabs, other_label), model, n_negatives, True)
    ranked = wrong.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n_negatives).select(F.col("anchor").alias("window"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    ranked = ranked.join(windows.select(F.col("number").alias("window"), F.col("of").alias("anchor"), F.col("high").alias("positive_score")), "window")
    whole = lambda c: F.col(c).cast("long").alias(c)
    named = anchors.select(F.col("number").alias("anchor"), F.col("id").alias("anchor_id"))
    out = positives.join(ranked, ["anchor", "positive_score"]).join(named, "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", whole("positive_score"), whole("negative_score")).distinct()


def of_embeddings(embeddings: DataFrame) -> DataFrame:
    """The query: every seventh id's label moved on by one, every hundredth id an anchor."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(prepare(embeddings.select("vec_id", label.alias("label"), "embedding")), F.col("id") % 100 == 0)


ORACLE = """
    with r as (select distinct vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
        where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
    s as (select a.id as a, a.label as al, b.id as b, b.label as bl, list_dot_product(a.v, b.v)::bigint as score from r a join r b on a.id % 100 = 0 and a.id <> b.id and len(a.v) = len(b.v)),
    p as (select a, al, b, score, row_number() over (partition by a, al order by score desc, b) as n from s where al = bl),
    w as (select p.a, p.b as positive, p.score as ps, s.b as negative, s.score as ns, row_number() over (partition by p.a, p.al, p.b order by s.score desc, s.b) as rank
        from p join s on s.a = p.a and s.al = p.al and s.bl <> s.al and 80 * p.score <= 100 * s.score and s.score <= p.score where p.n <= 5)
    select distinct a as anchor_id, positive as positive_id, rank::int as rank, negative as negative_id, ps as positive_score, ns as negative_score from w where rank <= 5"""
