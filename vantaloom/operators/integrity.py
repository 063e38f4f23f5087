"""Checks of evaluation sets against the corpus they ask about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantaloom.operators.metrics import occurrences
from vantaloom.sources.runtime import stage


def gold_check(questions: DataFrame, gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per question: leaks, least and most chunks of a gold string, answer documents, single-chunk answers, severity.

    ``questions`` (query_id, q), ``gold`` (query_id, gold), ``chunks`` (doc, chunk_id, text).
    An answer document holds every gold string somewhere; a leak is a gold string in the question.
    """
    found = stage(occurrences(chunks, gold, ["doc", "chunk_id"]), "gold-found")  # read three times below
    per_gold = gold.join(found, ["query_id", "gold"], "left").groupBy("query_id", "gold").agg(F.count("chunk_id").alias("n_chunks"), F.countDistinct("doc").alias("n_docs"))
    size = gold.groupBy("query_id").agg(F.countDistinct("gold").alias("n_gold"))
    whole = lambda *keys: found.groupBy("query_id", *keys).agg(F.countDistinct("gold").alias("got")).join(size, "query_id").where("got = n_gold").groupBy("query_id").agg(F.count("*").alias(f"n_{keys[-1]}"))
    leaks = questions.join(gold, "query_id").where(F.contains("q", "gold")).groupBy("query_id").agg(F.count("*").alias("leaks"))
    out = per_gold.groupBy("query_id").agg(F.min("n_chunks").alias("least_chunks"), F.max("n_chunks").alias("most_chunks"))
    for more in (leaks, whole("doc"), whole("doc", "chunk_id")):
        out = out.join(more, "query_id", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c.replace("n_doc", "answer_docs").replace("n_chunk_id", "single_chunks"))
    out = out.select("query_id", "least_chunks", "most_chunks", none("leaks"), none("n_doc"), none("n_chunk_id"))
    return out.withColumn("severity", severity())


def severity() -> Column:
    """All findings of a question, joined by ``+``; ``clean`` where there is none."""
    found = F.array_compact(
        F.array(
            F.when(F.col("least_chunks") == 0, F.lit("unsolvable")),
            F.when((F.col("least_chunks") > 0) & (F.col("answer_docs") != 1), F.lit("multi_doc")),
            F.when(F.col("leaks") > 0, F.lit("leak")),
            F.when((F.col("least_chunks") > 0) & (F.col("single_chunks") == 0), F.lit("recall1_zero")),
        )
    )
    return F.when(F.size(found) > 0, F.array_join(found, "+")).otherwise(F.lit("clean"))


def severity_report(checked: DataFrame) -> DataFrame:
    """Questions by finding."""
    return checked.select(F.explode(F.split("severity", r"\+")).alias("finding")).groupBy("finding").agg(F.count("*").alias("n_questions"))


def code_gold_check(questions: DataFrame, gold: DataFrame, chunks: DataFrame, many_files: int = 6) -> DataFrame:
    """Per question with symbol gold: missing symbols, literal leaks, files and chunks that hold them, and a warning."""
    found = occurrences(chunks, gold, ["doc", "chunk_id"], whole=True)
    per = gold.join(found, ["query_id", "gold"], "left").groupBy("query_id").agg(
        (F.countDistinct("gold") - F.countDistinct(F.when(F.col("chunk_id").isNotNull(), F.col("gold")))).alias("missing"), F.countDistinct("doc").alias("n_files"), F.count("chunk_id").alias("n_chunks")
    )
    leaks = questions.join(gold, "query_id").where(F.contains(F.lower("q"), F.lower("gold"))).groupBy("query_id").agg(F.count("*").alias("leaks"))
    return per.join(leaks, "query_id", "left").select("query_id", "missing", F.coalesce("leaks", F.lit(0)).cast("long").alias("leaks"), "n_files", "n_chunks", (F.col("n_files") > many_files).alias("warn"))


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that two chunkings do not share, with how often: an empty result means parity."""
    only = lambda a, b, side: a.exceptAll(b).groupBy(*a.columns).agg(F.count("*").alias("n")).withColumn("side", F.lit(side))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def key_equality(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two arms has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))
