"""Small contracts: answers without an index, caches that repeat keys, the two Markdown chunkers."""

from pyspark.sql import functions as F

from vantaloom.operators import chunking, context, integrity, judging
from vantaloom.operators.postings import Postings


def test_a_search_without_an_index_says_so(spark, tmp_path):
    asked = spark.createDataFrame([(1, "a"), (2, "b")], "query_id int, q string")
    assert {tuple(r) for r in context.or_message(asked, None).collect()} == {(1, "（代码索引未加载）"), (2, "（代码索引未加载）")}
    found = spark.createDataFrame([(2, "text", 1)], "query_id int, context string, n_items int")
    assert {tuple(r) for r in context.or_message(asked, found).collect()} == {(1, ""), (2, "text")}
    index = Postings(spark, str(tmp_path / "none"))
    assert not index.exists
    index.apply(spark.createDataFrame([], "chunk_id long, text string"))
    assert index.exists and index.frequency.count() == 0 and index.totals.first()[0] == 0


def test_a_key_that_the_cache_repeats_counts_once(spark):
    chunks = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one")], "id int, text string")
    key = judging.chunk_key(F.lit("one"))
    cache = spark.range(2).select(key.alias("key"), F.concat(F.lit("d"), F.col("id").cast("string")).alias("description"))
    asked, fresh = judging.synthesize(chunks, cache, lambda texts: [t.upper() for t in texts])
    assert {(r["id"], r["description"]) for r in asked.collect()} == {(1, "d0"), (2, "TWO"), (3, "d0")}
    assert asked.count() == 3 and [r["description"] for r in fresh.collect()] == ["TWO"]


def test_chunkers_differ_only_for_a_heading_directly_above_a_finer_one(spark):
    texts = [(1, "# A\nbody\n## B\n\n### C\nmore"), (2, "## A\n### B\nbody"), (3, "plain"), (4, "")]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    one = chunking.explode_chunks(docs, chunking.markdown_chunks(F.col("text"))).select("doc_id", "chunk")
    two = chunking.explode_chunks(docs, chunking.parent_chunks(F.col("text"))).select("doc_id", F.col("chunk.chunk").alias("chunk"))
    assert [(r["doc_id"], r["chunk"], r["n"], r["side"]) for r in integrity.parity(one, two).collect()] == [(2, "## A", 1, "left")]
