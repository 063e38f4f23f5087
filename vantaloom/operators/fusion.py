"""Rank fusion, weighting, symbol dedup, reranking and rank diagnosis.

Scores are long-form: (query_id, chunk_id, score...). Ranks are over all chunks of a
query, ties by chunk id, and come from ``rank_within``, which needs no task a query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vantaloom.functions.text import symbol_key, tokens
from vantaloom.operators.ranking import rank_within, top_k
from vantaloom.sources.runtime import ship_package, small_side, stage

RRF_K, OVERVIEW_WEIGHT, RERANK_CHARS = 60, 0.3, 768
_ROWS = 512  # groups whose rankings a task's Python fuses at a time
SWEEP = (5, 10, 20, 30, 60, 100, 200)  # fixed values: the fusion constants that the sweep compares


def with_ranks(scores: DataFrame, *names: str) -> DataFrame:
    """Add ``r_<name>``, 0-based, for each score column."""
    for n in names:
        scores = rank_within(scores, "query_id", n, "chunk_id", f"r_{n}", start=0)
    return scores


def rrf(*ranks: str, k: int | Column = RRF_K, weights: tuple[float, ...] | None = None) -> Column:
    """Reciprocal rank fusion of 0-based ranks, each with a weight (1 by default)."""
    kk = F.lit(k) if isinstance(k, int) else k
    return sum((F.lit(float(w)) / (kk + F.col(r) + 1) for r, w in zip(ranks, weights or [1.0] * len(ranks), strict=True)), F.lit(0.0))


def min_rank(*ranks: str) -> Column:
    """The better rank decides, the worse one breaks ties; larger is better."""
    return -(F.least(*ranks) + 1e-3 * F.greatest(*ranks))


@dataclass(frozen=True)
class Strategy:
    """A named score over the two ranks, and how many candidates it recalls."""

    name: str
    depth: int
    score: Column


def strategies() -> list[Strategy]:
    """The six recall strategies that evaluations compare."""
    v, b = "r_cosine", "r_bm25"
    return [
        Strategy("s1_rrf_20", 20, rrf(v, b)),
        Strategy("s2_vector_20", 20, -F.col(v).cast("double")),
        Strategy("s3_weighted_20", 20, rrf(v, b, weights=(0.85, 0.15))),
        Strategy("s4_rrf_40", 40, rrf(v, b)),
        Strategy("s5_min_rank_20", 20, min_rank(v, b)),
        Strategy("s6_vector_40", 40, -F.col(v).cast("double")),
    ]


def fuse(ranked: DataFrame, score: Column, depth: int, digits: int = 10, name: str = "fused") -> DataFrame:
    """The ``depth`` best chunks of each query by a fused score, with 1-based ranks."""
    return top_k(ranked.withColumn(name, F.round(score, digits)), "query_id", depth, [F.desc(name), F.asc("chunk_id")])


def strategy_grid(ranked: DataFrame, chosen: list[Strategy] | None = None) -> DataFrame:
    """(strategy, query_id, rank, chunk_id) of every strategy, in one pass over the ranks."""
    every = chosen or strategies()
    rows = F.array(*[F.struct(F.lit(s.name).alias("strategy"), F.lit(s.depth).alias("depth"), F.round(s.score, 10).alias("fused")) for s in every])
    long = ranked.select("query_id", "chunk_id", F.explode(rows).alias("s")).select("query_id", "chunk_id", "s.*")
    w = Window.partitionBy("strategy", "query_id").orderBy(F.desc("fused"), F.asc("chunk_id"))
    deepest = max(s.depth for s in every)
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= deepest).where("rank <= depth").select("strategy", "query_id", "rank", "chunk_id")


def k_sweep(ranked: DataFrame, ks=SWEEP, depth: int = 10) -> DataFrame:
    """Top chunks for each RRF constant, in one pass."""
    long = ranked.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    long = long.withColumn("fused", F.round(rrf("r_cosine", "r_bm25", k=F.col("k")), 10))
    w = Window.partitionBy("k", "query_id").orderBy(F.desc("fused"), F.asc("chunk_id"))
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= depth).select("k", "query_id", "rank", "chunk_id", "fused")


def rrf_lists(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """Fusion of explicit rankings: ``lists`` has group_id and ``items``, one ranking a row; absent items add nothing."""
    placed = lists.select("group_id", F.posexplode("items").alias("pos", "item"))
    return placed.groupBy("group_id", "item").agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("pos") + 1)), 10).alias("score"))


def rrf_rankings(groups: DataFrame, k: int = RRF_K) -> DataFrame:
    """As ``rrf_lists``, from (group_id, rankings), an array of rankings a row. Only ids are shuffled, and the rankings of groups that have several rows."""
    ship_package(groups.sparkSession)
    several = small_side(stage(groups.groupBy(F.col("group_id").alias("g")).agg(F.count("*").alias("n")).where("n > 1").select("g"), "several"))
    same = F.col("group_id").eqNullSafe(F.col("g"))

    def fuse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(start, _ROWS)
                lists = batch.column(1)
                of = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
                own = lists.flatten()
                n = pc.fill_null(pc.list_value_length(own), 0).to_numpy().astype(np.int64)
                items = own.flatten().dictionary_encode(null_encoding="encode")
                place = np.arange(len(items)) - np.repeat(np.cumsum(n) - n, n)
                keys = np.repeat(of, n) * max(len(items.dictionary), 1) + items.indices.to_numpy()
                keys, at = np.unique(keys, return_inverse=True)
                row, item = np.divmod(keys, max(len(items.dictionary), 1))
                score = np.bincount(at, 1.0 / (k + place + 1), len(keys))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), items.dictionary.take(pa.array(item)), pa.array(score)], names=["group_id", "item", "score"])

    id_type, item_type = groups.schema["group_id"].dataType.simpleString(), groups.schema["rankings"].dataType.elementType.elementType.simpleString()
    alone = groups.join(several, same, "left_anti").select("group_id", "rankings").mapInArrow(fuse_rows, f"group_id {id_type}, item {item_type}, score double")
    rest = groups.join(several, same, "left_semi").select("group_id", F.explode("rankings").alias("items"))
    return alone.withColumn("score", F.round("score", 10)).unionByName(rrf_lists(rest, k))


def downweight(score: Column, is_overview: Column, weight: float = OVERVIEW_WEIGHT) -> Column:
    """Scores of overview chunks times a weight (which lifts negative scores, as it is meant to)."""
    return F.when(is_overview, score * F.lit(weight)).otherwise(score)


def best_per_symbol(fused: DataFrame, top: int, key: str = "symbol", score: str = "fused") -> DataFrame:
    """The best part of each symbol, then the ``top`` symbols of each query."""
    w = Window.partitionBy("query_id", key).orderBy(F.desc(score), F.asc("chunk_id"))
    one = fused.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return top_k(one, "query_id", top, [F.desc(score), F.asc("chunk_id")])


def overlap_score(query: Column, text: Column) -> Column:
    """A deterministic reranker without a model: share of the query's distinct tokens that the text has."""
    q = F.array_distinct(tokens(query))
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(q, tokens(text))).cast("double"), F.size(q)), F.lit(0.0)), 6)


def model_scorer(load: Callable, batch: int = 32) -> Callable[[Column, Column], Column]:
    """A scorer for ``rerank`` from a pair model with ``predict(list of (query, text)) -> scores``.

    ``load`` runs once in a worker's lifetime; the model sees at most ``batch`` pairs at a time.
    """

    def run(queries: pa.Array, texts: pa.Array) -> pa.Array:
        pairs = [(q or "", t or "") for q, t in zip(queries.to_pylist(), texts.to_pylist(), strict=True)]
        model = _model(load)
        return pa.array([float(s) for at in range(0, len(pairs), batch) for s in model.predict(pairs[at : at + batch])], pa.float64())

    def scorer(query: Column, text: Column) -> Column:
        ship_package(SparkSession.active())
        return F.arrow_udf(run, returnType="double")(query, text)

    return scorer


@lru_cache(maxsize=4)
def _model(load: Callable):
    return load()


def rerank(candidates: DataFrame, scorer=overlap_score, top: int = 5, max_chars: int | None = None) -> DataFrame:
    """Score the candidates (query_id, q, chunk_id, text) and keep the best; texts may be cut for scoring alone."""
    text = F.col("text") if max_chars is None else F.substring("text", 1, max_chars)
    return top_k(candidates.withColumn("rerank_score", scorer(F.col("q"), text)), "query_id", top, [F.desc("rerank_score"), F.asc("chunk_id")])


def rerank_row(grid: DataFrame, reranked: DataFrame) -> DataFrame:
    """A full score row from a rerank order: n - rank (0-based), and minus infinity off the list."""
    n = reranked.groupBy("query_id").agg(F.count("*").alias("n"))
    marked = reranked.join(n, "query_id").select("query_id", "chunk_id", (F.col("n") - F.col("rank") + 1).cast("double").alias("row_score"))
    return grid.join(marked, ["query_id", "chunk_id"], "left").withColumn("row_score", F.coalesce("row_score", F.lit(float("-inf"))))


def first_hit(ranked: DataFrame, hit: Column, depth: int, keys: list[str], every: DataFrame) -> DataFrame:
    """Rank of the first hit of each group, or depth + 1; ``every`` has all the groups."""
    found = ranked.where(hit).groupBy(*keys).agg(F.min("rank").alias("rank"))
    return every.join(found, keys, "left").withColumn("rank", F.coalesce("rank", F.lit(depth + 1)).cast("long"))
