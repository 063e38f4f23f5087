"""Ranking, fusion, context, metrics and integrity on small fixtures."""

import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from vantaloom.operators import context, dense, fusion, integrity, lexical, metrics, ranking

DOCS = {1: "red fox red", 2: "blue fox", 3: "green tree", 4: ""}


@pytest.fixture(scope="module")
def index(spark):
    return lexical.build_index(spark.createDataFrame(list(DOCS.items()), "chunk_id long, text string"))


def bm25(query):
    toks = {i: t.split() for i, t in DOCS.items()}
    avg = sum(map(len, toks.values())) / len(toks)
    out = {}
    for i, own in toks.items():
        s = 0.0
        for w in query.split():
            df = sum(w in t for t in toks.values())
            if w in own:
                f = own.count(w)
                s += math.log((len(toks) - df + 0.5) / (df + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(own) / avg))
        out[i] = s
    return out


def test_bm25_counts_repeated_query_terms(spark, index):
    q = spark.createDataFrame([(1, "red red fox"), (2, "nothing")], "query_id long, q string")
    chunks = spark.createDataFrame(list(DOCS.items()), "chunk_id long, text string")
    got = lexical.with_all_chunks(lexical.bm25_matches(index, lexical.query_terms(q)), q, chunks, "bm25")
    for r in got.collect():
        want = bm25("red red fox")[r["chunk_id"]] if r["query_id"] == 1 else 0.0
        assert r["bm25"] == pytest.approx(want, abs=1e-7)
    assert got.count() == 8


def test_ranks_equal_a_full_sort(spark):
    rng = random.Random(3)
    data = [(g, i, rng.choice([0.0, 0.0, 0.5, rng.random(), -rng.random()])) for g in range(3) for i in range(700)]
    df = spark.createDataFrame(data, "query_id long, chunk_id long, s double")
    for common in (0.0, None):
        got = {(r["query_id"], r["chunk_id"]): r["r"] for r in ranking.rank_within(df, "query_id", "s", "chunk_id", "r", common=common).collect()}
        for g in range(3):
            order = sorted((x for x in data if x[0] == g), key=lambda x: (-x[2], x[1]))
            assert [got[g, x[1]] for x in order] == list(range(1, 701))


def test_rrf_of_lists(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (1, ["b", "a"]), (2, ["c"])], "group_id long, items array<string>")
    got = {(r["group_id"], r["item"]): r["score"] for r in fusion.rrf_lists(df).collect()}
    assert got[1, "a"] == got[1, "b"] == pytest.approx(1 / 61 + 1 / 62, abs=1e-9)
    assert got[2, "c"] == pytest.approx(1 / 61, abs=1e-9)


def test_min_rank_prefers_the_better_rank(spark):
    df = spark.createDataFrame([(1, 0, 9), (2, 0, 3), (3, 1, 1)], "id long, a long, b long")
    assert [r["id"] for r in df.orderBy(F.desc(fusion.min_rank("a", "b"))).collect()] == [2, 1, 3]


def test_downweight_lifts_negative_scores(spark):
    df = spark.createDataFrame([(1.0, True), (-1.0, True), (1.0, False)], "s double, o boolean")
    assert [r[0] for r in df.select(fusion.downweight(F.col("s"), F.col("o"))).collect()] == pytest.approx([0.3, -0.3, 1.0])


def test_symbol_dedup(spark):
    df = spark.createDataFrame([(1, 1, "f", 0.9), (1, 2, "f", 0.8), (1, 3, "g", 0.7), (1, 4, "h", 0.1)], "query_id long, chunk_id long, symbol string, fused double")
    assert [r["chunk_id"] for r in fusion.best_per_symbol(df, 2).orderBy("rank").collect()] == [1, 3]


def test_rerank_row_and_first_hit(spark):
    ranked = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "query_id long, chunk_id long, rank int")
    grid = spark.createDataFrame([(1, 7), (1, 8), (1, 9)], "query_id long, chunk_id long")
    got = {r["chunk_id"]: r["row_score"] for r in fusion.rerank_row(grid, ranked).collect()}
    assert got == {7: 2.0, 8: 1.0, 9: -math.inf}
    every = spark.createDataFrame([(1,), (2,)], "query_id long")
    first = fusion.first_hit(ranked, F.col("chunk_id") == 8, 20, ["query_id"], every)
    assert {r["query_id"]: r["rank"] for r in first.collect()} == {1: 2, 2: 21}


@pytest.mark.parametrize(
    ("items", "want"),
    [(["a" * 6, "b" * 20], ["a" * 6, "b" * 4 + context.CUT_MARK]), (["a" * 15, "b" * 9], ["a" * 15, "b" * 5]), (["a" * 20, "b"], ["a" * 20, ""]), (["a" * 5, "b" * 5], ["a" * 5, "b" * 5]), (["a" * 25, "b"], ["a" * 10 + context.CUT_MARK])],
)
def test_pack_budget(spark, items, want):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(items)], "query_id long, rank int, text string")
    got = context.pack_budget(df, 20, ["query_id"]).orderBy("rank").collect()
    assert [r["text"] for r in got] == want


def test_mark_has_ten_characters():
    assert len(context.CUT_MARK) == 10


def test_parents_once(spark):
    df = spark.createDataFrame([(1, 1, "p"), (1, 2, "q"), (1, 3, "p")], "query_id long, rank int, parent string")
    assert [(r["rank"], r["parent"]) for r in context.expand_parents(df).orderBy("rank").collect()] == [(1, "p"), (2, "q")]


def test_mrr_is_the_completion_rank(spark):
    ranked = spark.createDataFrame([(1, 1, "x"), (1, 2, "z"), (1, 3, "y"), (2, 1, "no")], "query_id long, rank int, text string")
    gold = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "query_id long, gold string")
    got = metrics.recall_and_mrr(metrics.completion(metrics.gold_hits(ranked, gold))).first()
    assert got["mrr"] == pytest.approx((1 / 3 + 0) / 2, abs=1e-6)
    assert (got["recall_1"], got["recall_3"]) == (0.0, 0.5)


def test_ndcg(spark):
    rel = spark.createDataFrame([(1, 2, 2)], "query_id long, rank int, rel long")
    ideal = spark.createDataFrame([(1, 2), (1, 0)], "query_id long, rel long")
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    got = {r["query_id"]: r["ndcg"] for r in metrics.ndcg(rel, ideal, queries, 2).collect()}
    assert got == {1: pytest.approx(0.63093, abs=1e-5), 2: 0.0}


@pytest.mark.parametrize(("k", "want"), [(1, False), (2, False), (3, True), (4, True)])
def test_ceiling_needs_three_units(spark, k, want):
    units = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "cc"), (4, "zz")], "unit_id long, text string")
    gold = spark.createDataFrame([(1, "aa"), (1, "bb"), (1, "cc"), (2, "nowhere")], "query_id long, gold string")
    got = {r["query_id"]: r["coverable"] for r in metrics.coverable(units, gold, k).collect()}
    assert got == {1: want, 2: False}


def test_gold_check_severities(spark):
    q = spark.createDataFrame([(1, "about aa"), (2, "b"), (3, "c")], "query_id long, q string")
    gold = spark.createDataFrame([(1, "aa"), (2, "bb"), (2, "cc"), (3, "none")], "query_id long, gold string")
    chunks = spark.createDataFrame([("d1", 1, "aa"), ("d2", 2, "bb"), ("d2", 3, "cc")], "doc string, chunk_id long, text string")
    got = {r["query_id"]: r["severity"] for r in integrity.gold_check(q, gold, chunks).collect()}
    assert got == {1: "leak", 2: "recall1_zero", 3: "unsolvable"}


def test_parity(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "c string")
    b = spark.createDataFrame([("x",), ("y",), ("z",)], "c string")
    assert sorted((r["c"], r["n"], r["side"]) for r in integrity.parity(a, b).collect()) == [("x", 1, "left"), ("z", 1, "right")]
    assert integrity.parity(a, a).count() == 0


def test_dot_products_agree(spark):
    v = spark.createDataFrame([(1, [0.6, 0.8]), (2, [1.0, 0.0])], "chunk_id long, embedding array<float>")
    q = v.withColumnRenamed("chunk_id", "query_id")
    got = {(r["query_id"], r["chunk_id"]): r["cosine"] for r in dense.score_matrix(v, q).collect()}
    assert got[1, 2] == got[2, 1] == pytest.approx(0.6, abs=1e-6)
    assert got[1, 1] == pytest.approx(1.0, abs=1e-6)
    assert [r["alarm"] for r in dense.similar_queries(q, 0.5).collect()] == [True]


def test_descriptions_meet_every_question(spark, tmp_path):
    items = [(3, "alpha words"), (50, "bravo words"), (41, "charlie words")]
    texts = ["alpha words", "charlie words", "bravo words", None]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["jaccard"] for r in __spark_entry__.queries()["description_distance"](spark, str(tmp_path)).collect()}
    assert got == {0: 1.0, 1: 1.0, 2: 1.0, 3: 0.0}


def lengths():
    """A stand-in for a model of pairs and of texts, which checks the batches it gets; local, so that workers get its code."""

    class Lengths:
        def predict(self, pairs):
            assert len(pairs) <= 2
            return [len(t) - len(q) for q, t in pairs]

        def encode(self, texts):
            assert len(texts) <= 2
            return [[float(len(t)), 1.0] for t in texts]

    return Lengths


def test_models_score_in_batches(spark):
    df = spark.createDataFrame([(1, "q", i, "x" * i) for i in range(7)], "query_id long, q string, chunk_id long, text string").coalesce(1)
    got = fusion.rerank(df, scorer=fusion.model_scorer(lengths(), batch=2), top=2).orderBy("rank").collect()
    assert [(r["chunk_id"], r["rerank_score"]) for r in got] == [(6, 5.0), (5, 4.0)]
    assert [r[0] for r in df.select(dense.embed(F.col("text"), lengths(), 2)).collect()][3] == [3.0, 1.0]


def test_hash_embedding_counts_tokens(spark):
    df = spark.createDataFrame([("a b a",), ("",), (None,)], "t string")
    a, empty, null = (r[0] for r in df.select(dense.hash_embedding(F.col("t"))).collect())
    assert sorted(x for x in a if x) == pytest.approx([1 / math.sqrt(5), 2 / math.sqrt(5)]) and not any(empty) and not any(null)


@pytest.mark.parametrize("most_mb", [64, 0])
@pytest.mark.parametrize("whole", [False, True])
def test_occurrences_like_a_plain_search(spark, rows, whole, most_mb):
    import re

    rng = random.Random(5)
    texts = [(i, "".join(rng.choice("ab_ é.") for _ in range(rng.randrange(30)))) for i in range(60)] + [(99, None)]
    gold = [(1, "ab"), (2, "a"), (2, "b_"), (3, "ab"), (3, "é"), (4, "zz")]
    got = rows(metrics.occurrences(spark.createDataFrame(texts, "chunk_id long, text string"), spark.createDataFrame(gold, "query_id long, gold string"), whole=whole, most_mb=most_mb))
    hit = lambda g, t: bool(re.search(rf"(?<![A-Za-z0-9_]){re.escape(g)}(?![A-Za-z0-9_])", t)) if whole else g in t
    assert got == sorted(((q, g, i) for i, t in texts if t is not None for q, g in gold if hit(g, t)), key=repr)


def test_code_report_counts_whole_identifiers(spark):
    ranked = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 4, 11)], "query_id long, chunk_id long, rank long")
    chunks = spark.createDataFrame([(1, "foobar"), (2, "foo()"), (3, "x.bar"), (4, "baz")], "chunk_id long, text string")
    gold = spark.createDataFrame([(1, "foo"), (1, "bar"), (2, "baz")], "query_id long, gold string")
    got = metrics.code_report(ranked, gold, metrics.occurrences(chunks, gold, whole=True)).first()
    assert (got["recall_1"], got["recall_3"], got["recall_10"]) == (0.0, 0.5, 0.5)
    assert got["mrr"] == pytest.approx(1 / 6, abs=1e-6)
    assert got["ndcg_5"] == pytest.approx((1 / math.log2(3) + 1 / 2) / (1 + 1 / math.log2(3)) / 2, abs=1e-6)


def test_vectors_with_gaps_have_no_score(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [None, 1.0]), (3, [1.0]), (4, None)], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [(r["query_id"], r["chunk_id"]) for r in dense.score_matrix(v, q).collect()] == [(7, 1)]


def test_best_matches_are_those_of_all_matches(spark, monkeypatch):
    """Blocks of a few chunks and parts of a few questions give the same lists as a row for every match; equal texts tie by id."""
    texts = [" ".join(f"w{(i * j) % 7}" for j in range(i % 5)) for i in range(120)]
    index = lexical.build_index(spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").repartition(4))
    terms = lexical.query_terms(spark.createDataFrame([(1, "w1 w2 w2"), (2, "w3"), (3, "unknown"), (4, "w0 w6 w5 w4"), (5, "")], "query_id int, q string"))
    every = lexical.bm25_matches(index, terms).withColumn("bm25", F.round("bm25", 6))
    want = ranking.top_k(every, "query_id", 6, [F.desc("bm25"), F.asc("chunk_id")])
    shared = index.postings.join(terms, "term").groupBy("query_id", "chunk_id").agg(F.count("*").cast("double").alias("bm25"))
    most = ranking.top_k(shared, "query_id", 6, [F.desc("bm25"), F.asc("chunk_id")])
    for megabytes, cells in ((64, 1 << 20), (1e-4, 30)):
        monkeypatch.setattr(lexical, "WEIGHTS_MB", megabytes)
        monkeypatch.setattr(lexical, "CELLS", cells)
        for found, own in ((lexical.best_matches(index, terms, 6), want), (lexical.best_matches(index, terms, 6, shared=True), most)):
            columns = ["query_id", "chunk_id", "bm25", "rank"]
            assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, own.select(*columns).collect()))


def test_rankings_of_a_group_are_fused_where_they_lie(spark, rows):
    own = [(1, [["a", "b", "a"], ["b", None]]), (2, [["a"]]), (2, [["b", "a"], []]), (None, [["c"]]), (None, [["c"]]), (3, []), (4, None), (5, [None, ["a", ""]])]
    groups = spark.createDataFrame(own, "group_id long, rankings array<array<string>>")
    got = fusion.rrf_rankings(groups)
    assert rows(got) == rows(fusion.rrf_lists(groups.select("group_id", F.explode("rankings").alias("items"))))
    one = fusion.rrf_rankings(groups.where("group_id = 1"))
    assert "MapInArrow" in one._jdf.queryExecution().executedPlan().toString() and len(one.collect()) == 3
