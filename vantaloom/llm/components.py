"""Connected components of links, by alternating large-star and small-star rounds.

Each round is two aggregations and two joins on a node; the aggregations combine
before their shuffle and the joins are plain equi-joins, which Spark splits where a
node has very many links. A round's links are staged in the shared folder, so
lineage stays short and no link is gathered on the driver. The number of rounds grows
with the logarithm of the largest component.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantaloom.sources.runtime import stage


def again(name: str) -> Column:
    """The same column under a partitioning that the planner does not know, so that a join shuffles both its sides afresh and can split a node with very many links."""
    return F.expr(f"{name} + 0").alias(name)


def _large_star(links: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours the smallest node it knows."""
    both = links.union(links.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(again("u"), F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m")).select(again("u"), "m")
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``links`` has two long columns; the result (node, component) has every node that is linked.

    The component is the smallest node that can be reached. Null ends and loops are
    left out; links may repeat and come in either direction.
    """
    a, b = links.columns[:2]
    now = stage(links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").distinct(), "links")
    before = None
    for _ in range(most_rounds):
        now = stage(_small_star(_large_star(now)), "links")
        state = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    # Settled links are stars whose centre is the least node of its component.
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct()).distinct()
