"""Paired statistics of two arms over the same questions."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantaloom.sources.runtime import ship_package

DRAWS, SEED = 10_000, 42
EXACT_UP_TO = 13


def by_group(pairs: DataFrame, group: str = "grp") -> DataFrame:
    """The rows of each group, and all of them again as ``total``."""
    return pairs.withColumn("arm_group", F.explode(F.array(F.col(group), F.lit("total"))))


def paired_table(pairs: DataFrame, ks=(1, 3, 5, 10), group: str = "grp") -> DataFrame:
    """Per group (and total) and k: both recalls, discordant counts b and c, delta and McNemar's p.

    ``pairs``: one row a question with ``natural_rank`` and ``abstract_rank``.
    """
    long = pairs.select(F.col(group), "natural_rank", "abstract_rank", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    x, y = (F.col("natural_rank") <= F.col("k")).cast("int"), (F.col("abstract_rank") <= F.col("k")).cast("int")
    marked = long.withColumns({"x": x, "y": y})
    out = marked.rollup("k", group).agg(
        F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("natural"), F.round(F.avg("y"), 6).alias("abstract"), F.count_if(F.expr("x = 1 and y = 0")).alias("b"), F.count_if(F.expr("x = 0 and y = 1")).alias("c")
    ).where("k is not null")
    return out.select(F.coalesce(group, F.lit("total")).alias("arm_group"), "k", "n", "natural", "abstract", "b", "c", F.round((F.col("b") - F.col("c")) / F.col("n"), 6).alias("delta"), mcnemar_p(F.col("b"), F.col("c")).alias("mcnemar_p"))


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided binomial p of discordant counts; 1 where there are none."""
    n, m = (b + c).cast("int"), F.least(b, c).cast("int")
    log_choose = lambda i: F.aggregate(F.sequence(F.lit(1), i), F.lit(0.0), lambda s, j: s + F.log((n - j + 1).cast("double")) - F.log(j.cast("double")))
    term = lambda i: F.exp(F.when(i > 0, log_choose(i)).otherwise(0.0) + n * math.log(0.5))
    tail = F.aggregate(F.sequence(F.lit(0), m), F.lit(0.0), lambda s, i: s + term(i))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.round(F.least(F.lit(1.0), 2 * tail), 8))


def power_table(most: int, spark) -> DataFrame:
    """p of b = 1..most discordant pairs that all point one way, and whether that is significant."""
    b = spark.range(1, most + 1).select(F.col("id").alias("b"))
    return b.withColumn("p", mcnemar_p(F.col("b"), F.lit(0).cast("long"))).withColumn("significant", F.col("p") < 0.05)


def bootstrap_interval(differences: Iterable[float], draws: int = DRAWS, seed: int = SEED) -> tuple[float, float]:
    """Percentile interval (2.5, 97.5) of the mean under resampling, with linear percentiles."""
    d = np.asarray(list(differences), dtype=np.float64)
    if not len(d):
        return math.nan, math.nan
    picks = np.random.default_rng(seed).integers(0, len(d), size=(draws, len(d)))
    low, high = np.percentile(d[picks].mean(1), [2.5, 97.5])
    return float(low), float(high)


def wilcoxon_p(differences: Iterable[float]) -> float:
    """Signed-rank p, two-sided; zeros are dropped and ties get mid-ranks.

    Up to 13 differences the null distribution is counted exactly over all signs of
    the mid-ranks; beyond that it is the normal one, with the variance of tied ranks
    and no continuity correction. Without a non-zero difference it is NaN.
    """
    every = [float(x) for x in differences]
    d = np.array([x for x in every if x != 0])
    if not len(d):
        return math.nan
    size = np.abs(d)
    order = np.sort(size)
    ranks = (np.searchsorted(order, size, "left") + np.searchsorted(order, size, "right") + 1) / 2
    up = float(ranks[d > 0].sum())
    total = float(ranks.sum())
    if len(every) <= EXACT_UP_TO:
        counts = {0: 1}
        for r in (2 * ranks).astype(int):
            grown = dict(counts)
            for s, k in counts.items():
                grown[s + int(r)] = grown.get(s + int(r), 0) + k
            counts = grown
        least = min(up, total - up)
        return float(min(1.0, 2 * sum(k for s, k in counts.items() if s <= 2 * least + 1e-9) / 2 ** len(d)))
    n = len(d)
    ties = np.unique(size, return_counts=True)[1]
    variance = n * (n + 1) * (2 * n + 1) / 24 - float((ties**3 - ties).sum()) / 48
    z = (up - n * (n + 1) / 4) / math.sqrt(variance)
    return float(math.erfc(abs(z) / math.sqrt(2)))


def reciprocal(rank: Column, depth: int) -> Column:
    """1 / rank up to the depth, else 0."""
    return F.when(rank <= depth, F.lit(1.0) / rank).otherwise(F.lit(0.0))


def mrr_pairs(pairs: DataFrame, depth: int = 20, group: str = "grp", draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """Per group and total: both MRR, their difference with its interval, Wilcoxon's p and the median rank difference.

    A group's rows, one a question, go to one task of numpy: evaluation sets have
    tens to thousands of questions. The median is over questions that an arm has hit.
    """
    ship_package(pairs.sparkSession)
    rows = by_group(pairs, group).select("arm_group", "id", "natural_rank", "abstract_rank", reciprocal(F.col("natural_rank"), depth).alias("x"), reciprocal(F.col("abstract_rank"), depth).alias("y"))

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        d = (pdf["x"] - pdf["y"]).to_numpy()
        low, high = bootstrap_interval(d, draws, seed)
        hit = pdf[(pdf["natural_rank"] <= depth) | (pdf["abstract_rank"] <= depth)]
        median = float((hit["natural_rank"] - hit["abstract_rank"]).median()) if len(hit) else math.nan
        return pd.DataFrame([(pdf["arm_group"].iloc[0], len(pdf), pdf["x"].mean(), pdf["y"].mean(), d.mean(), low, high, wilcoxon_p(d), median)], columns=["arm_group", "n", "mrr_natural", "mrr_abstract", "delta", "ci_low", "ci_high", "wilcoxon_p", "median_rank_difference"])

    return rows.groupBy("arm_group").applyInPandas(measure, "arm_group string, n long, mrr_natural double, mrr_abstract double, delta double, ci_low double, ci_high double, wilcoxon_p double, median_rank_difference double")


def recall_intervals(pairs: DataFrame, ks=(1, 3, 5, 10), group: str = "grp", draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """Per group, total and k: the bootstrap interval of the recall difference."""
    ship_package(pairs.sparkSession)
    long = by_group(pairs, group).select("arm_group", "id", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"), "natural_rank", "abstract_rank")

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        k = pdf["k"].iloc[0]
        d = (pdf["natural_rank"] <= k).astype(float) - (pdf["abstract_rank"] <= k).astype(float)
        low, high = bootstrap_interval(d, draws, seed)
        return pd.DataFrame([(pdf["arm_group"].iloc[0], int(k), len(pdf), float(d.mean()), low, high)], columns=["arm_group", "k", "n", "delta", "ci_low", "ci_high"])

    return long.groupBy("arm_group", "k").applyInPandas(measure, "arm_group string, k int, n long, delta double, ci_low double, ci_high double")


def hashed_bootstrap(pairs: DataFrame, k: int, draws: int = 200, group: str = "grp") -> DataFrame:
    """A bootstrap that SQL can repeat: draws come from a hash of (draw, place), so any engine takes the same ones."""
    base = by_group(pairs, group).select("arm_group", "id", ((F.col("natural_rank") <= k).cast("int") - (F.col("abstract_rank") <= k).cast("int")).alias("d"))
    sorted_d = base.groupBy("arm_group").agg(F.array_sort(F.collect_list(F.struct("id", "d"))).alias("rows"))
    n = F.size("rows")
    draw = sorted_d.select("arm_group", "rows", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    pick = lambda i: (F.conv(F.substring(F.sha1(F.concat_ws(":", F.col("draw"), i).cast("binary")), 1, 8), 16, 10).cast("long") % n).cast("int")
    mean = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("long"), lambda s, i: s + F.get(F.col("rows"), pick(i))["d"]) / n
    return draw.select("arm_group", mean.alias("m")).groupBy("arm_group").agg(F.round(F.percentile("m", 0.025), 6).alias("ci_low"), F.round(F.percentile("m", 0.975), 6).alias("ci_high"))


def rank_change(pairs: DataFrame, group: str = "grp", depth: int = 20) -> DataFrame:
    """Original against paraphrase, by group and total: MRR, hit@1, hit@10, dropped and worsened questions."""
    x, y = F.col("natural_rank"), F.col("abstract_rank")
    rows = by_group(pairs, group)
    hit = lambda c, k: F.count_if(c <= k)
    return rows.groupBy("arm_group").agg(
        F.count("*").alias("n"), F.round(F.avg(reciprocal(x, depth)), 6).alias("mrr_original"), F.round(F.avg(reciprocal(y, depth)), 6).alias("mrr_paraphrase"), hit(x, 1).alias("original_at_1"), hit(y, 1).alias("paraphrase_at_1"),
        hit(x, 10).alias("original_at_10"), hit(y, 10).alias("paraphrase_at_10"), F.count_if((x <= depth) & (y > depth)).alias("dropped"), F.count_if(y > x).alias("worsened"),
    )


def strategy_pairing(grid: DataFrame, baseline: str, depth: int = 20, draws: int = 20_000, seed: int = 20260922) -> DataFrame:
    """Each strategy against a baseline: paired R@1, R@10 and MRR differences, intervals and P(delta <= 0).

    ``grid``: strategy, query_id, rank. One generator serves a strategy's three measures in turn.
    """
    ship_package(grid.sparkSession)
    base = grid.where(F.col("strategy") == baseline).select("query_id", F.col("rank").alias("base_rank"))
    both = grid.where(F.col("strategy") != baseline).join(base, "query_id")

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("query_id", kind="stable")
        a, b = pdf["rank"].to_numpy(), pdf["base_rank"].to_numpy()
        rr = lambda r: np.where(r <= depth, 1.0 / r, 0.0)
        rng, rows = np.random.default_rng(seed), []
        for name, d in (("recall_1", (a <= 1) * 1.0 - (b <= 1)), ("recall_10", (a <= 10) * 1.0 - (b <= 10)), ("mrr", rr(a) - rr(b))):
            means = d[rng.integers(0, len(d), size=(draws, len(d)))].mean(1)
            low, high = np.percentile(means, [2.5, 97.5])
            rows.append((pdf["strategy"].iloc[0], name, float(d.mean()), float(low), float(high), float((means <= 0).mean())))
        return pd.DataFrame(rows, columns=["strategy", "measure", "delta", "ci_low", "ci_high", "p_not_better"])

    return both.groupBy("strategy").applyInPandas(measure, "strategy string, measure string, delta double, ci_low double, ci_high double, p_not_better double")
