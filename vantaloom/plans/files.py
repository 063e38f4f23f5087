"""Queries of readers and sinks: files written from the tables into the shared folder and read back.

Every document is a file of its own in a folder of its source; the writer ends each text with a line feed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantaloom.plans import data
from vantaloom.plans.registry import query
from vantaloom.sources import corpus, evalsets
from vantaloom.sources.runtime import scratch, spread, table

S = SparkSession


def _tree(spark: S, d: str) -> str:
    """Files of the documents in a folder of their source, some thousands in each folder inside it."""
    path = scratch(spark, "tree")
    docs = table(spark, d, "documents").select(F.coalesce("source", F.lit("none")).alias("source"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # As Spark's own partition folders: characters that a path can't hold are written in hexadecimal.
    source = F.regexp_replace(F.url_encode("source"), r"\+", " ")
    folder = F.concat(F.lit("source="), source, F.lit("/part="), F.coalesce(F.shiftright("doc_id", 12), F.lit(0)))
    name = F.concat(F.lit("doc_id="), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("."), F.monotonically_increasing_id(), F.lit(".txt"))
    corpus.write_documents(spread(docs.select(folder.alias("folder"), name.alias("name"), F.concat("text", F.lit("\n")).alias("text"))), path)
    return path


@query("select doc_id, sha1(coalesce(text, '') || chr(10)) digest from documents")
def source_documents(spark: S, d: str) -> DataFrame:
    found = corpus.load_documents(spark, [_tree(spark, d)])
    return found.select(F.regexp_extract("path", "doc_id=([0-9-]+)[.][^/]*$", 1).try_cast("long").alias("doc_id"), F.sha1(F.col("text").cast("binary")).alias("digest"))


@query("select 'source=' || coalesce(source, 'none') folder, count(*) n_files, sum(strlen(coalesce(text, '')) + 1)::bigint n_bytes from documents group by all")
def source_folders(spark: S, d: str) -> DataFrame:
    path = _tree(spark, d)
    return corpus.folder_statistics(spark, path.removeprefix("file://"))[0]


@query(f"""with {data.QUESTIONS}, {data.GOLD}, nameless as (select query_id, 's' || lpad(n::varchar, greatest(2, length(n::varchar))::int, '0') id from (select query_id, row_number() over (order by q) n from questions where query_id % 5 = 0))
    select coalesce(id, query_id::varchar) query_id, gold from gold left join nameless using (query_id)""")
def source_questions(spark: S, d: str) -> DataFrame:
    """Questions as JSON lines, every fifth without an id, read as an evaluation set."""
    path = scratch(spark, "questions")
    gold = data.gold(spark, d).groupBy("query_id").agg(F.collect_list("gold").alias("gold"))
    own = F.when(F.col("query_id") % 5 != 0, F.col("query_id").cast("string"))
    corpus.write_results(data.questions(spark, d).join(gold, "query_id", "left").select(own.alias("id"), "q", F.coalesce("gold", F.array().cast("array<string>")).alias("gold")), path)
    return evalsets.gold_rows(evalsets.read_set(spark, path))


@query("""with own as (select doc_id, lang, sha1(coalesce(text, '')) as key, substr(coalesce(text, ''), 1, 40) description from documents)
    select doc_id, key in (select key from own where lang = 'en') cached, description from own""")
def source_cache(spark: S, d: str) -> DataFrame:
    """Descriptions through a cache that first holds the English documents alone, then what it lacked."""
    path = scratch(spark, "cache")
    text = F.coalesce("text", F.lit(""))
    own = table(spark, d, "documents").select("doc_id", "lang", F.sha1(text.cast("binary")).alias("key"), F.substring(text, 1, 40).alias("description"))
    corpus.append_cache(own.where("lang = 'en'").select("key", "description").dropDuplicates(["key"]), path)
    known = corpus.read_cache(spark, path).select("key", F.lit(True).alias("cached"))
    marked = own.join(known, "key", "left").select("doc_id", "key", "description", F.coalesce("cached", F.lit(False)).alias("cached"))
    later = scratch(spark, "cache")
    corpus.append_cache(corpus.read_cache(spark, path), later)
    corpus.append_cache(marked.where("not cached").select("key", "description").dropDuplicates(["key"]), later)
    return marked.drop("description").join(corpus.read_cache(spark, later), "key").select("doc_id", "cached", "description")


@query("select 'DOC_' || doc_id as key, coalesce(lang, '') || '=' || coalesce(source, '') as value from documents where doc_id % 7 not in (0, 1)")
def source_env(spark: S, d: str) -> DataFrame:
    """A line of settings for every document; some are comments, some have no sign of equality."""
    path = scratch(spark, "env")
    pair = F.concat(F.lit(" DOC_"), "doc_id", F.lit(" = "), F.coalesce("lang", F.lit("")), F.lit("="), F.coalesce("source", F.lit("")), F.lit(" "))
    line = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("# "), pair)).when(F.col("doc_id") % 7 == 1, F.concat(F.lit("DOC_"), "doc_id")).otherwise(pair)
    table(spark, d, "documents").select(line.alias("value")).write.text(path)
    return corpus.parse_env(spark.read.text(path))
