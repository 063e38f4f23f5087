"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Vectors are normalised, so that cosine c is the distance sqrt(2 - 2c). A table's code
of a vector is the tuple of floor((a . v + b) / width) over its Gaussian projections;
vectors with equal codes share a bucket. Width, projections and tables follow from
the threshold, the number of vectors and the wished recall at the threshold itself
(closer pairs are found more surely). Buckets over ``chunk`` rows are dealt over
cells, so neither memory nor a task grows with a bucket.

Buckets are gone through twice. First a row brings only its vector in 8-bit steps and
the length of what that leaves out: by Cauchy-Schwarz these bound every cosine from
above, and a row without a partner whose bound reaches the threshold leaves the
bucket. Rows leave, never pairs. Then those that stay are joined with their vectors
and compared exactly, in double precision, by blocks of a matrix product. A pair that
meets in several tables counts in the first of them; the codes that tell are made
again from the vectors, and for linked rows alone. Projections are whole numbers, so
that sums are exact and a code comes out alike wherever it is made.

Equal vectors become one row first, with their number, by an aggregation that combines
before its shuffle. Counts and spanning links leave the buckets, never all pairs.

Cases: vectors that are null, zero, or hold null or non-finite components link with
nothing, nor do vectors of different lengths. Rows that repeat an id count each for
itself, linked by their own vectors, equal ones as copies of each other; a null id is
kept out of links and is its own component (null). Vectors of any length are taken whole. An empty table gives an empty result. Extra columns are not carried along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantaloom.llm.blocks import Forest, to_cells
from vantaloom.llm.components import again, connected_components
from vantaloom.sources.runtime import ship_package, stage


def collision(distance: float, width: float) -> float:
    """Chance that one quantised Gaussian projection agrees for two points so far apart."""
    if distance <= 0:
        return 1.0
    t = width / distance
    return math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


@dataclass(frozen=True)
class Plan:
    """Projections in a table, number of tables and width of a quantum."""

    projections: int
    tables: int
    width: float


def plan_for(n: int, threshold: float, recall: float = 0.95, width: float = 1.5, crowd: int = 256) -> Plan:
    """Buckets of about ``crowd`` unrelated vectors whatever the corpus's size, and tables enough for the recall at the threshold.

    Projections grow with log n and tables with about n**0.29 (at threshold 0.9: 14 tables
    for 50,000 vectors, 134 for 100 million), so the work on unrelated vectors is
    n**1.29 instead of n**2.
    """
    near, far = collision(math.sqrt(max(2 - 2 * threshold, 1e-9)), width), collision(math.sqrt(2), width)
    k = max(1, math.ceil(math.log(max(n, 2) / crowd) / -math.log(far))) if n > crowd else 1
    return Plan(k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(near**k, 1 - 1e-12)))), width)


@lru_cache(maxsize=2)
def _projections(dim: int, plan: Plan, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Gaussian projections, offsets and mixing factors as whole numbers, and the steps in a vector's unit.

    Vectors and projections have so few bits that every partial sum of a product stays below 2**53.
    """
    rng = np.random.default_rng(seed)
    steps = 2.0 ** ((49 - math.ceil(math.log2(dim + 1))) // 2)
    a = np.rint(np.clip(rng.standard_normal((dim, plan.tables * plan.projections)), -8, 8) * steps)
    b = np.rint(rng.uniform(0, plan.width, plan.tables * plan.projections) * steps * steps)
    return a, b, rng.integers(1 << 62, size=plan.projections, dtype=np.int64) * 2 + 1, steps


def _codes(unit: np.ndarray, plan: Plan, seed: int, tables: int) -> np.ndarray:
    """Codes in the first ``tables`` tables, rows x tables."""
    a, b, odd, steps = _projections(unit.shape[1], plan, seed)
    used = tables * plan.projections
    cells = np.floor((np.rint(unit * steps) @ a[:, :used] + b[:used]) / (plan.width * steps * steps))
    with np.errstate(over="ignore"):
        return (cells.astype(np.int64).reshape(len(unit), tables, plan.projections) * odd).sum(2).astype("<i4")


def _sketches(unit: np.ndarray) -> np.ndarray:
    """Rows of bytes: 8-bit steps of each component, the size of a step, and (rounded up) the length of what the steps leave out."""
    step = (np.abs(unit).max(1) / 127).astype("<f4")
    rounded = np.rint(unit / step[:, None].astype(np.float64)).astype(np.int8)
    left = np.linalg.norm(unit - rounded * step[:, None].astype(np.float64), axis=1)
    tail = np.column_stack([step, np.nextafter(left.astype("<f4"), np.float32(np.inf))]).astype("<f4")
    return np.concatenate([rounded.view(np.uint8), tail.view(np.uint8)], axis=1)


def _reach(sketches: list[bytes], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs' cosines may reach the threshold: u.v differs from the product of the steps by at most |du| + (1 + |du|) |dv|."""
    raw = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
    tail = np.ascontiguousarray(raw[:, -8:]).view("<f4").astype(np.float64)
    steps, out = raw[:, :-8].view(np.int8) * tail[:, :1], tail[:, 1]
    bound = steps[left] @ steps[right].T + out[left][:, None] + (1 + out[left])[:, None] * out[right][None, :]
    return bound >= threshold - 1e-9  # the slack covers roundings of double precision


def _vectors(df: DataFrame, vector_col: str) -> tuple[Column, str]:
    """The vector column in its own precision (double where it is not float), and numpy's name of it."""
    short = df.schema[vector_col].dataType.simpleString() == "array<float>"
    return (df[vector_col], "<f4") if short else (df[vector_col].cast("array<double>"), "<f8")


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows in double precision, normalised."""
    v = raw.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _clean(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows that may link, one for each distinct vector: its least id, its number of rows, and a number of its own (fixed once it is staged), as ids may repeat."""
    rows = df.select(df[id_col].cast("long").alias("vec_id"), _vectors(df, vector_col)[0].alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("v", lambda x: x != 0)
    return rows.where(finite & some).groupBy("v").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("n_copies")).withColumn("class_id", F.monotonically_increasing_id())


def _sides(side: list[int], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that a cell compares with each other; ``side`` is in order."""
    cut = len(side) if same else int(np.searchsorted(np.array(side), 1))
    left = np.arange(cut)
    return left, left if same else np.arange(cut, len(side))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Cells of two rows or more: the key (place, code, cell_i, cell_j) and the columns after it."""
    held, key = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:4] != key:
                if len(held) > 1:
                    yield key, list(zip(*held, strict=True))
                held, key = [], row[:4]
            held.append(row[4:])
    if len(held) > 1:
        yield key, list(zip(*held, strict=True))


def _dealt(rows: DataFrame, places: DataFrame, chunk: int, *carried: str) -> DataFrame:
    """Rows of buckets of two or more, in cells: a cell is in one partition, in order. ``places`` are the rows' buckets."""
    sizes = places.groupBy("place", "code").agg(F.count("*").alias("size")).where("size > 1").select(again("place"), again("code"), "size")
    cells = to_cells(rows.join(sizes, ["place", "code"]), ["place", "code"], "class_id", F.col("size"), chunk)
    keys = ["place", "code", "cell_i", "cell_j"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.select(*keys, "side", "class_id", *carried).repartition(parts, *keys).sortWithinPartitions(*keys, "side", "class_id")


def _batches(found: Iterator[tuple], schema: pa.Schema, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``most``."""
    out = []
    for row in found:
        out.append(row)
        if len(out) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, recall: float = 0.95, chunk: int = 384, seed: int = 7) -> DataFrame:
    """One row per input row: id, number of vectors linked directly, component, and whether it is kept."""
    spark = df.sparkSession
    ship_package(spark)
    classes = stage(_clean(df, id_col, vector_col), "vectors")
    n = classes.count()
    plan = plan_for(n, threshold, recall)
    column, kind = _vectors(df, vector_col)

    def hash_rows(batches: Iterator[pa.RecordBatch], sketched: bool) -> Iterator[pa.RecordBatch]:
        """A row for each table: class, place (of the table among those of all lengths), code and sketch."""
        for batch in batches:
            ids, arrays = batch.column(0).to_numpy(), batch.column(1)
            if not batch.num_rows:
                continue
            first = arrays.offsets.to_numpy()
            lengths = np.diff(first)
            flat = arrays.flatten().to_numpy(zero_copy_only=False)
            groups = [own[at : at + 1024] for dim in np.unique(lengths) for own in [np.flatnonzero(lengths == dim)] for at in range(0, len(own), 1024)]
            for own in groups:
                dim = int(lengths[own[0]])
                unit = _unit(flat[(first[own] - first[0])[:, None] + np.arange(dim)].astype(kind))
                codes = _codes(unit, plan, seed, plan.tables)
                short = pa.array([x.tobytes() for x in _sketches(unit)], pa.binary()) if sketched else None
                for t in range(plan.tables):
                    columns = [pa.array(ids[own], pa.int64()), pa.array(np.full(len(own), dim * plan.tables + t)), pa.array(codes[:, t])]
                    yield pa.RecordBatch.from_arrays(columns + [short] * sketched, names=["class_id", "place", "code", "sketch"][: 3 + sketched])

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a cell that may have a partner in it."""

        def rows() -> Iterator[tuple[int, int, int]]:
            for (place, code, i, j), (side, ids, sketches) in _cells(batches):
                left, right = _sides(side, i == j)
                near = _reach(sketches, left, right, threshold)
                if i == j:
                    np.fill_diagonal(near, False)
                stay = np.union1d(left[near.any(1)], right[near.any(0)])
                yield from ((ids[x], place, code) for x in stay.tolist())

        yield from _batches(rows(), pa.schema([("class_id", pa.int64()), ("place", pa.int64()), ("code", pa.int32())]))

    slim = classes.select("class_id", "v")
    places = slim.mapInArrow(lambda b: hash_rows(b, False), "class_id long, place long, code int")
    rows = slim.mapInArrow(lambda b: hash_rows(b, True), "class_id long, place long, code int, sketch binary")
    stay = stage(_dealt(rows, places, chunk, "sketch").mapInArrow(sift, "class_id long, place long, code int").distinct(), "vector-meetings")

    def compare(key: tuple, columns: list[tuple]) -> Iterator[tuple[int, int, int | None]]:
        """For one cell (class, 0, a class it is linked with) and (class, number of vectors linked, null)."""
        side, ids, copies, raw = columns
        copies, same, table = np.array(copies), key[2] == key[3], key[0] % plan.tables
        v = _unit(np.frombuffer(b"".join(raw), kind).reshape(len(ids), -1))
        left, right = _sides(side, same)
        linked = v[left] @ v[right].T >= threshold
        if same:
            np.fill_diagonal(linked, False)
        if table and linked.any():  # pairs that met in an earlier table are counted there
            rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
            here, there = _codes(v[left[rows]], plan, seed, table), _codes(v[right[cols]], plan, seed, table)
            own = linked[np.ix_(rows, cols)]
            for t in range(table):
                own &= here[:, t][:, None] != there[:, t][None, :]
            linked[np.ix_(rows, cols)] = own
        count = np.zeros(len(ids), dtype=np.int64)
        count[left] += linked @ copies[right]
        if not same:
            count[right] += linked.T @ copies[left]
        forest = Forest(len(ids))
        forest.join_matrix(linked, left, right)
        for a, b in forest.links:
            yield ids[a], 0, ids[b]
        for i in np.flatnonzero(count).tolist():
            yield ids[i], int(count[i]), None

    def compare_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (row for key, columns in _cells(batches) for row in compare(key, columns))
        yield from _batches(found, pa.schema([(c, pa.int64()) for c in ("class_id", "linked", "other")]))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors as bytes."""
        for batch in batches:
            first, flat = batch.column(2).offsets.to_numpy(), batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(kind)
            raw = [flat[a - first[0] : b - first[0]].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary())], names=["class_id", "n_copies", "v"])

    vectors = classes.select("class_id", "n_copies", "v").mapInArrow(packed, "class_id long, n_copies long, v binary")
    met = _dealt(stay.join(vectors, "class_id"), stay, chunk, "n_copies", "v")
    found = stage(met.mapInArrow(compare_cells, "class_id long, linked long, other long"), "vector-links")
    counts = found.groupBy("class_id").agg(F.sum("linked").alias("linked"))
    components = connected_components(found.where("other is not null").select("class_id", "other"))
    reached = classes.join(components, classes["class_id"] == components["node"], "left").select("class_id", "v", "least_id", "n_copies", F.coalesce("component", "class_id").alias("tie"))
    least = reached.groupBy("tie").agg(F.min("least_id").alias("component")).select(again("tie"), "component")
    per_class = reached.join(least, "tie").join(counts, "class_id", "left").select("v", F.coalesce("linked", F.lit(0)).alias("linked"), "n_copies", "component")
    ids = df.select(df[id_col].cast("long").alias("vec_id"), column.alias("own_v"))
    joined = ids.join(per_class, F.col("own_v") == F.col("v"), "left")
    linked = F.col("v").isNotNull() & F.col("vec_id").isNotNull()
    component = F.when(linked, F.col("component")).otherwise(F.col("vec_id"))
    return joined.select("vec_id", F.when(linked, F.col("linked") + F.col("n_copies") - 1).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
