"""Retrieval metrics over long-form rankings (query_id, rank, text) and gold strings (query_id, gold).

A hit of a gold string is a substring of the text, case-sensitive. Because no gold
string holds a line break, a hit in joined texts is a hit in one of them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantaloom.functions.text import has_symbol
from vantaloom.operators.context import pack_budget
from vantaloom.sources.runtime import ship_package, small_side, stage


def occurrences(texts: DataFrame, gold: DataFrame, unit: str | list[str] = "chunk_id", whole: bool = False, most_mb: int = 64) -> DataFrame:
    """(query_id, gold, unit...) where a text holds a gold string; with ``whole``, as a whole identifier.

    Each text is read once for all the gold strings: an automaton over the distinct
    strings goes to every task after a check of their size (``most_mb`` of text), and
    what it finds joins back to the questions. Beyond that size, pairs are tested one by one.
    An empty gold string is found in every text, as a substring always is.
    """
    units = [unit] if isinstance(unit, str) else unit
    golds = gold.select("gold").where("gold is not null").distinct()
    size = golds.agg(F.coalesce(F.sum(F.octet_length("gold")), F.lit(0))).first()[0]
    if size > most_mb * 1e6:
        test = has_symbol(F.col("text"), F.col("gold")) if whole else F.contains("text", "gold")
        return texts.select(*units, "text").join(gold, test).select("query_id", "gold", *units)
    words = [r[0] for r in golds.collect()]
    ship_package(texts.sparkSession)
    held = texts.sparkSession.sparkContext.broadcast(sorted(words))

    def find(values: pa.Array) -> pa.Array:
        search = _search(tuple(held.value), whole)
        return pa.array([None if t is None else search(t) for t in values.to_pylist()], pa.list_(pa.string()))

    hits = texts.select(*units, F.explode(F.arrow_udf(find, returnType="array<string>")("text")).alias("gold"))
    return hits.join(small_side(gold.select("query_id", "gold")), "gold").select("query_id", "gold", *units)


@lru_cache(maxsize=2)
def _search(words: tuple[str, ...], whole: bool) -> Callable[[str], list[str]]:
    """A function that lists which of the words a text holds; built once in a worker."""
    automaton = ahocorasick.Automaton()
    for w in words:
        if w:
            automaton.add_word(w, w)
    if len(automaton):
        automaton.make_automaton()
    always = [w for w in words if not w]

    def inner(text: str, i: int) -> bool:
        return 0 <= i < len(text) and (text[i] == "_" or (text[i].isascii() and text[i].isalnum()))

    def run(text: str) -> list[str]:
        found = set()
        for end, w in automaton.iter(text) if len(automaton) else ():
            if w not in found and not (whole and (inner(text, end + 1) or inner(text, end - len(w)))):
                found.add(w)
        return always + sorted(found)

    return run


def gold_hits(ranked: DataFrame, gold: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(query_id, gold, first): the first rank of each gold string, null where it never occurs.

    ``found`` are occurrences by chunk; without them ``ranked`` must carry the texts.
    """
    if found is None:
        hits = ranked.join(gold, "query_id").where(F.contains("text", "gold"))
    else:
        hits = ranked.select("query_id", "chunk_id", "rank").join(found, ["query_id", "chunk_id"])
    return gold.join(hits.groupBy("query_id", "gold").agg(F.min("rank").alias("first")), ["query_id", "gold"], "left")


def completion(hits: DataFrame) -> DataFrame:
    """(query_id, done): the rank at which all gold strings of a query have occurred, else null."""
    return hits.groupBy("query_id").agg(F.when(F.count("first") == F.count("*"), F.max("first")).alias("done"))


def recall_and_mrr(done: DataFrame, ks=(1, 3, 5, 10)) -> DataFrame:
    """Mean Recall@k for each k and the mean reciprocal completion rank."""
    at = [F.round(F.avg(F.when(F.col("done") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}") for k in ks]
    return done.agg(F.count("*").alias("n_queries"), *at, F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("done"), F.lit(0.0))), 6).alias("mrr"))


def hit_matrix(done: DataFrame, ks=(1, 3, 5, 10)) -> DataFrame:
    """Per query, whether it is complete at each k."""
    return done.select("query_id", *[F.coalesce(F.col("done") <= k, F.lit(False)).alias(f"hit_{k}") for k in ks])


def gains(found: DataFrame, unit: str = "chunk_id") -> DataFrame:
    """(query_id, rel): how many gold strings of the query each unit that has one holds."""
    return found.groupBy("query_id", unit).agg(F.countDistinct("gold").alias("rel")).select("query_id", "rel")


def relevance(ranked: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, chunk_id, rank, rel): how many gold strings of the query each chunk holds; chunks without one are left out."""
    rel = found.groupBy("query_id", "chunk_id").agg(F.countDistinct("gold").alias("rel"))
    return ranked.select("query_id", "chunk_id", "rank").join(rel, ["query_id", "chunk_id"])


def ndcg(rel: DataFrame, ideal: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Per query nDCG@k: linear gains (query_id, rank, rel), discount 1 / log2(rank + 1), against the ideal (query_id, rel)."""
    gain = F.col("rel") / F.log2(F.col("rank") + 1)
    dcg = rel.where(F.col("rank") <= k).groupBy("query_id").agg(F.sum(gain).alias("dcg"))
    w = Window.partitionBy("query_id").orderBy(F.desc("rel"))
    best = ideal.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).groupBy("query_id").agg(F.sum(gain).alias("idcg"))
    both = queries.select("query_id").join(dcg, "query_id", "left").join(best, "query_id", "left")
    return both.select("query_id", F.round(F.coalesce(F.try_divide("dcg", "idcg"), F.lit(0.0)), 6).alias("ndcg"))


def least_units(units: DataFrame, gold: DataFrame, unit: str = "unit_id") -> DataFrame:
    """(query_id, least): how few units (query_id or all, unit, text) hold all gold strings of a query together; null where all of them don't.

    Each unit's gold strings are a bit mask; distinct masks of a query are folded into
    the least number of units for every mask that they can make, so the state of a
    query has at most 2**gold entries.
    """
    numbered = gold.groupBy("query_id").agg(F.array_sort(F.collect_set("gold")).alias("golds"))
    bits = gold.join(numbered, "query_id").select("query_id", "gold", (F.array_position("golds", F.col("gold")) - 1).cast("int").alias("i"), F.size("golds").alias("n"))
    if "query_id" in units.columns:
        own = units.join(bits, "query_id").where(F.contains("text", "gold"))
    else:
        own = occurrences(units, gold, unit).join(bits, ["query_id", "gold"])
    masks = own.groupBy("query_id", unit, "n").agg(F.bit_or(F.expr("shiftleft(1, i)")).alias("mask")).select("query_id", "n", "mask").distinct()
    state = masks.groupBy("query_id", "n").agg(F.array_sort(F.collect_set("mask")).alias("masks"))
    full = F.expr("shiftleft(1, n) - 1")
    zero = F.array(F.struct(F.lit(0).alias("m"), F.lit(0).alias("c")))

    def step(acc: Column, mask: Column) -> Column:
        grown = F.concat(acc, F.transform(acc, lambda s: F.struct(s["m"].bitwiseOR(mask).alias("m"), (s["c"] + 1).alias("c"))))
        keys = F.array_distinct(F.transform(grown, lambda s: s["m"]))
        return F.transform(keys, lambda key: F.struct(key.alias("m"), F.array_min(F.transform(F.filter(grown, lambda s: s["m"] == key), lambda s: s["c"])).alias("c")))

    reached = F.aggregate("masks", zero, step)
    best = F.array_min(F.transform(F.filter(reached, lambda s: s["m"] == full), lambda s: s["c"]))
    return gold.select("query_id").distinct().join(state.select("query_id", best.alias("least")), "query_id", "left")


def coverable(units: DataFrame, gold: DataFrame, k: int, unit: str = "unit_id") -> DataFrame:
    """Per query, whether at most k units hold all its gold strings together."""
    return least_units(units, gold, unit).select("query_id", F.coalesce(F.col("least") <= k, F.lit(False)).alias("coverable"))


def attainment(recall: Column, ceiling: Column) -> Column:
    """Recall as a share of what the granularity allows; 0 where it allows nothing."""
    return F.round(F.coalesce(F.try_divide(recall, ceiling), F.lit(0.0)), 6)


def mean_ndcg(rel: DataFrame, queries: DataFrame, ks: tuple[int, ...], ideal: DataFrame | None = None) -> DataFrame:
    """One row: the mean nDCG@k for each k; the ideal is ``rel`` in its best order unless another is given."""
    best = rel.select("query_id", "rel") if ideal is None else ideal
    means = [ndcg(rel, best, queries, k).agg(F.round(F.avg("ndcg"), 6).alias(f"ndcg_{k}")) for k in ks]
    out = means[0]
    for more in means[1:]:
        out = out.crossJoin(F.broadcast(more))  # one row each
    return out


def code_report(ranked: DataFrame, gold: DataFrame, found: DataFrame, depth: int = 10) -> DataFrame:
    """One row for code search: Recall@k, MRR and nDCG of the first ``depth`` chunks.

    ``found`` are occurrences as whole identifiers in all chunks; the ideal order is over all of them.
    """
    top = ranked.where(F.col("rank") <= depth)
    done = completion(gold_hits(top, gold, found))
    rel = found.groupBy("query_id", "chunk_id").agg(F.countDistinct("gold").alias("rel"))
    placed = top.select("query_id", "chunk_id", "rank").join(rel, ["query_id", "chunk_id"])
    gains = mean_ndcg(placed, gold.select("query_id").distinct(), (5, 10), rel.select("query_id", "rel"))
    return recall_and_mrr(done).crossJoin(F.broadcast(gains))


def parent_report(chunk_done: DataFrame, placed: DataFrame, parents: DataFrame, gold: DataFrame, ks=(1, 3, 5, 10), budget: int = 8000) -> DataFrame:
    """One row for each k: recall by chunks, by parent passages and within a budget, the ceiling, attainment and context sizes.

    ``chunk_done`` (query_id, done) is the completion by chunks; ``placed`` (query_id,
    parent, rank) ranks parents by their first chunk, the first ten and all before a gold string's first; ``parents`` has (parent, text).
    Attainment is parent recall as a share of the ceiling, the questions whose gold
    strings k parents can hold at all. MRR, nDCG and the sizes of the contexts of the
    largest k stand in every row.
    """
    most = max(ks)
    found = stage(occurrences(parents, gold, "parent"), "parent-found")
    placed = stage(placed, "parent-ranks")
    at = gold.join(found.join(placed, ["query_id", "parent"]).groupBy("query_id", "gold").agg(F.min("rank").alias("first")), ["query_id", "gold"], "left")
    done = completion(at).withColumnRenamed("done", "parent_done")
    rel = found.groupBy("query_id", "parent").agg(F.countDistinct("gold").alias("rel")).join(placed, ["query_id", "parent"])
    top = stage(placed.where(F.col("rank") <= most).join(parents, "parent").select("query_id", "rank", "text"), "parent-top")
    packed = pack_budget(top, budget, ["query_id"]).join(gold, "query_id").where(F.contains("text", "gold"))
    within = completion(gold.join(packed.groupBy("query_id", "gold").agg(F.min("rank").alias("first")), ["query_id", "gold"], "left")).withColumnRenamed("done", "budget_done")
    least = least_units(parents.select(F.col("parent").alias("unit_id"), "text"), gold)
    k = F.explode(F.array(*[F.lit(x) for x in ks])).alias("k")
    every = chunk_done.select("query_id", F.col("done").alias("chunk_done")).join(done, "query_id").join(within, "query_id").join(least, "query_id").select("*", k)
    chars = top.select("query_id", "rank", F.length("text").alias("n"), k).where(F.col("rank") <= F.col("k")).groupBy("query_id", "k").agg(F.sum("n").alias("chars"))
    rate = lambda c: F.round(F.avg(F.when(F.col(c) <= F.col("k"), 1.0).otherwise(0.0)), 6)
    out = every.join(chars, ["query_id", "k"], "left").groupBy("k").agg(
        F.count("*").alias("n_queries"), rate("chunk_done").alias("chunk_recall"), rate("parent_done").alias("parent_recall"), rate("budget_done").alias("budget_recall"), rate("least").alias("ceiling"),
        attainment(rate("parent_done"), rate("least")).alias("attainment"), F.round(F.avg(F.coalesce("chars", F.lit(0))), 6).alias("mean_chars"),
    )
    n = F.col("chars")
    sizes = chars.where(F.col("k") == most).agg(F.count_if(n > budget).alias("n_truncated"), F.percentile(n, 0.5).alias("median_chars"), F.round(F.percentile(n, 0.95), 6).alias("p95_chars"), F.max(n).alias("max_chars"))
    mrr = done.agg(F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("parent_done"), F.lit(0.0))), 6).alias("mrr"))
    for one in (mrr, mean_ndcg(rel, gold.select("query_id").distinct(), (5, 10), gains(found, "parent")), sizes):
        out = out.crossJoin(F.broadcast(one))  # one row each
    return out


def miss_report(hits: DataFrame, k: int) -> DataFrame:
    """Queries incomplete at k: the gold strings that are missing, and those found with their ranks."""
    late = F.col("first").isNull() | (F.col("first") > k)
    return (
        hits.groupBy("query_id")
        .agg(
            F.array_join(F.array_sort(F.collect_list(F.when(late, F.col("gold")))), "|").alias("missing"),
            F.array_join(F.array_sort(F.collect_list(F.when(~late, F.concat_ws("@", "gold", "first")))), "|").alias("found"),
        )
        .where("missing <> ''")
    )


def grid_metrics(first: DataFrame, keys: list[str], depth: Column, ks=(1, 3, 5, 10)) -> DataFrame:
    """Recall@k, MRR cut at the depth, and coverage of first-hit ranks, for each group."""
    inside = F.col("rank") <= depth
    at = [F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}") for k in ks]
    return first.groupBy(*keys).agg(F.count("*").alias("n"), *at, F.round(F.avg(F.when(inside, F.lit(1.0) / F.col("rank")).otherwise(0.0)), 6).alias("mrr"), F.round(F.avg(inside.cast("double")), 6).alias("coverage"))
