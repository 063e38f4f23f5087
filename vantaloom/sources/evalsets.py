"""Evaluation sets: schemas, and readers of JSON lines that check them.

A question has an id, a text and gold strings; a generation task has facts, each of
which is a list of checks. A check's ``value`` may be a string, a number or a truth
value, so it is kept as JSON text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUESTIONS = "id string, q string, gold array<string>"
ANSWERS = "q string, facts array<string>"
CHECK = "struct<kind:string,name:string,names:array<string>,module:string,key:string,value:string,target:string,method:string,left:string,right:string,class:string,decorator:string,args:array<string>,not:boolean>"
TASKS = f"id string, path string, task string, runnable boolean, seed map<string,string>, run_check string, facts array<struct<desc:string,checks:array<{CHECK}>>>"


def read_set(spark: SparkSession, path: str, schema: str = QUESTIONS, prefix: str = "s") -> DataFrame:
    """JSON lines of a schema; questions without an id get ``prefix`` and their place by text, of two digits at least."""
    rows = spark.read.schema(schema).json(path)
    if "id" not in rows.columns or "gold" not in rows.columns:
        return rows
    nameless = rows.where("id is null").select("q", "gold")
    if not nameless.take(1):
        return rows
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("q"))  # a question set has tens to thousands of rows
    named = nameless.select(F.concat(F.lit(prefix), F.format_string("%02d", place)).alias("id"), "q", "gold")
    return rows.where("id is not null").unionByName(named)


def gold_rows(questions: DataFrame) -> DataFrame:
    """(query_id, gold): one row for each gold string."""
    return questions.select(F.col("id").alias("query_id"), F.explode("gold").alias("gold"))
