"""How the test tables stand for a retrieval system's inputs, in Spark and in SQL.

Documents are chunks, benchmark items are questions, embeddings are the vectors of both
(by id), sources are files, and source and language together name a symbol. Gold
strings of a question are its third, sixth and ninth word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantaloom.operators import dense, fused, fusion, lexical
from vantaloom.sources.runtime import spread, table


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return d.select(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("source").alias("doc"), (F.col("lang") == "es").alias("is_overview"), F.concat_ws("|", "source", "lang").alias("symbol"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).join(vectors(spark, sf_dir).withColumnRenamed("chunk_id", "query_id"), "query_id").select("query_id", "embedding")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("q", "[ \n]+")
    own = F.array_distinct(F.array(*[F.regexp_replace(F.get(words, F.lit(i)), "[^A-Za-z0-9À-ÿ]", "") for i in (2, 5, 8)]))
    return questions(spark, sf_dir).select("query_id", F.explode(own).alias("gold")).where("gold <> ''")


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, parent, text): four chunks in a row are one passage, named by its content, so equal passages are one."""
    c = chunks(spark, sf_dir).select("chunk_id", "text", F.floor(F.col("chunk_id") / 4).alias("place"))
    rows = F.array_sort(F.collect_list(F.struct("chunk_id", "text")))
    whole = c.groupBy("place").agg(rows.alias("rows")).select("rows", F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("text"))
    return whole.select(F.explode(F.transform("rows", lambda r: r["chunk_id"])).alias("chunk_id"), F.sha1(F.col("text").cast("binary")).alias("parent"), "text")


def index(spark: SparkSession, sf_dir: str) -> lexical.Index:
    return lexical.build_index(chunks(spark, sf_dir))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, chunk_id, bm25, cosine) for every question and chunk."""
    q, c = questions(spark, sf_dir), chunks(spark, sf_dir)
    matches = lexical.bm25_matches(index(spark, sf_dir), lexical.query_terms(q))
    grid = lexical.with_all_chunks(matches, q, c, "bm25")
    cosine = dense.score_matrix(vectors(spark, sf_dir), question_vectors(spark, sf_dir))
    return grid.join(cosine, ["query_id", "chunk_id"], "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with their 0-based ranks."""
    return fusion.with_ranks(scores(spark, sf_dir), "cosine", "bm25")


def parts(spark: SparkSession, sf_dir: str, lighter: bool = False) -> list[fused.Part]:
    """The questions and chunks for fused search; ``lighter`` weights overview chunks down."""
    c = chunks(spark, sf_dir)
    flags = c.select("chunk_id", F.when(F.col("is_overview"), fusion.OVERVIEW_WEIGHT).otherwise(1.0).alias("lighter")) if lighter else None
    return fused.parts(lexical.index_of(c), questions(spark, sf_dir), vectors(spark, sf_dir), question_vectors(spark, sf_dir), flags)


def candidates(spark: SparkSession, sf_dir: str, chosen: list[tuple[Column, int]], lighter: bool = False) -> DataFrame:
    """Chunks that may be among the best k of a score over their ranks, with their exact ranks."""
    return reduce(DataFrame.unionByName, [fused.reaching(p, chosen) for p in parts(spark, sf_dir, lighter)])


CHUNKS = "chunks as (select doc_id chunk_id, coalesce(text, '') as text, source as doc, lang = 'es' is_overview, source || '|' || lang symbol from documents)"
QUESTIONS = "questions as (select item_id query_id, text q from benchmark)"
TOKENS = "list_concat(regexp_extract_all(lower({0}), '[a-z0-9]+'), regexp_extract_all(lower({0}), '[一-鿿]'))"
INDEX = f"""{CHUNKS}, {QUESTIONS},
    toks as (select chunk_id, {TOKENS.format("text")} toks from chunks),
    postings as (select chunk_id, dl, term, count(*) tf from (select chunk_id, len(toks) dl, unnest(toks) term from toks) group by all),
    frequency as (select term, count(*) df from postings group by term),
    totals as (select count(*) n_docs, coalesce(avg(len(toks)), 0.0) avgdl from toks),
    terms as (select query_id, term, count(*) qf from (select query_id, unnest({TOKENS.format("q")}) term from questions) group by all)"""
BM25 = f"""{INDEX},
    weighted as (select query_id, term, qf * ln((n_docs - df + 0.5) / (df + 0.5) + 1) w, avgdl from terms join frequency using (term), totals),
    matches as (select query_id, chunk_id, sum(w * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) bm25 from postings join weighted using (term) group by all)"""
SCORES = f"""{BM25},
    grid as (select query_id, chunk_id, text, doc, is_overview, symbol from chunks, questions),
    cosines as (select q.vec_id query_id, c.vec_id chunk_id, round(list_dot_product(c.embedding::double[], q.embedding::double[]), 8) cosine
        from embeddings c, (select * from embeddings where vec_id in (select query_id from questions)) q where c.embedding is not null),
    scores as (select grid.*, round(coalesce(bm25, 0.0), 8) bm25, coalesce(cosine, 0.0) cosine from grid left join matches using (query_id, chunk_id) left join cosines using (query_id, chunk_id))"""
RANKED = f"""{SCORES},
    ranked as (select *, row_number() over (partition by query_id order by cosine desc, chunk_id) - 1 r_cosine, row_number() over (partition by query_id order by bm25 desc, chunk_id) - 1 r_bm25 from scores)"""
RRF = "round(1.0::double / (60 + r_cosine + 1) + 1.0::double / (60 + r_bm25 + 1), 10)"
FUSED = f"""{RANKED},
    fused as (select *, row_number() over (partition by query_id order by fused desc, chunk_id) as rank from (select *, {RRF} fused from ranked))"""
PASSAGES = """passages as (select chunk_id, sha1(p.text) parent, p.text as parent_text from chunks c join (select chunk_id // 4 place, string_agg(text, chr(10) order by chunk_id) as text from chunks group by all) p on c.chunk_id // 4 = p.place)"""
GOLD = """gold as (select distinct query_id, gold from (select query_id, unnest(list_distinct([regexp_replace(w[3], '[^A-Za-z0-9À-ÿ]', '', 'g'), regexp_replace(w[6], '[^A-Za-z0-9À-ÿ]', '', 'g'),
        regexp_replace(w[9], '[^A-Za-z0-9À-ÿ]', '', 'g')])) gold from (select query_id, string_split_regex(q, '[ \\n]+') w from questions)) where gold <> '')"""
