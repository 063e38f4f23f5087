"""Global ranks without a task for each query.

A window over a whole query would sort all its chunks in one task. Here rows fall into
buckets by score, whose counts give each bucket's first rank; a window then ranks
within (query, bucket). Buckets are equal slices of the score range of a query, and a
score that very many rows share is sliced further by id, so no bucket is a whole query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantaloom.sources.runtime import stage

SLICES, TIE_IDS = 64, 50_000


def rank_within(df: DataFrame, group: str, score: str, tie: str, name: str, start: int = 1, slices: int = SLICES, common: float | None = 0.0) -> DataFrame:
    """Add the rank by ``score`` descending, then ``tie`` ascending, per ``group``.

    ``common`` is a score that many rows may share; those rows are sliced by ``tie``, a number.
    """
    df = stage(df, "ranking")  # read three times below; unstaged, nested ranks would compute their scores over and over
    ends = df.groupBy(group).agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    wide = df.join(ends, group)
    place = F.when(F.col("__hi") > F.col("__lo"), F.floor((F.col("__hi") - F.col(score)) / (F.col("__hi") - F.col("__lo")) * slices)).otherwise(F.lit(0)).cast("long")
    if common is None:
        # Without a score of its own, a bucket is a slice of the range.
        sliced = wide.withColumns({"__b": place, "__c": F.lit(0).cast("int"), "__t": F.lit(0).cast("long")})
    else:
        same = F.col(score) == F.lit(common)
        side = F.when(F.col(score) > F.lit(common), F.lit(0)).when(same, F.lit(1)).otherwise(F.lit(2)).cast("int")
        sliced = wide.withColumns({"__b": place, "__c": side, "__t": F.when(same, F.floor(F.col(tie) / TIE_IDS)).otherwise(F.lit(0)).cast("long")})
    bucket = ["__b", "__c", "__t"]
    counts = sliced.groupBy(group, *bucket).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, *bucket, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    own = Window.partitionBy(group, *bucket).orderBy(F.desc(score), F.asc(tie))
    ranked = sliced.join(offsets, [group, *bucket]).withColumn(name, (F.row_number().over(own) + F.col("__first") + F.lit(start - 1)).cast("long"))
    return ranked.drop("__lo", "__hi", "__first", *bucket)


def top_k(df: DataFrame, group: str, k: int, order: list[Column], name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark keeps k rows a group before the shuffle."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
