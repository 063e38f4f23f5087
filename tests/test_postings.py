"""The block index against plain BM25: edits, deletions, merges, ties, negative and far ids, and blocks left shut."""

import math
import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vantaloom.functions import text as tx
from vantaloom.operators import lexical
from vantaloom.operators.postings import Postings

WORDS = ["spark", "join", "shuffle", "skew", "plan", "task", "row", "key"]


def plain(texts: dict, questions: dict, k: int) -> dict:
    """(query, rank) -> (chunk, score) by loops over all chunks."""
    toks = {c: t.split() for c, t in texts.items()}
    n, mean = len(toks), sum(map(len, toks.values())) / max(1, len(toks))
    df = Counter(w for t in toks.values() for w in set(t))
    out = {}
    for q, words in questions.items():
        found = []
        for c, t in toks.items():
            tf, score = Counter(t), 0.0
            for w in words.split():
                if tf[w]:
                    score += math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * 2.5 / (tf[w] + 1.5 * (1 - 0.75 + 0.75 * len(t) / mean))
            if any(tf[w] for w in words.split()):
                found.append((c, round(score, 6)))
        found.sort(key=lambda r: (-r[1], r[0]))
        out |= {(q, i): r for i, r in enumerate(found[:k], 1)}
    return out


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "chunk_id long, text string").repartition(3)


def ask(spark, index, questions, k=4, seed=1):
    terms = lexical.query_terms(spark.createDataFrame(list(questions.items()), "query_id int, q string"))
    top, blocks = index.search(terms, k, seed)
    return {(r["query_id"], r["rank"]): (r["chunk_id"], pytest.approx(r["bm25"], abs=2e-6)) for r in top.collect()}, blocks


def same(spark, index, texts, questions, k=4):
    df = Counter(w for t in texts.values() for w in set(t.split()))
    assert {r["term"]: r["df"] for r in index.frequency.collect()} == dict(df)
    n, avgdl = index.totals.first()
    assert n == len(texts) and avgdl == pytest.approx(sum(len(t.split()) for t in texts.values()) / max(1, len(texts)))
    assert {r["chunk_id"] for r in index.live(index.read("docs")).collect()} == set(texts)
    assert ask(spark, index, questions, k)[0] == plain(texts, questions, k)


def write(rng, n):
    return " ".join(rng.choice(WORDS[: rng.randrange(1, 9)]) for _ in range(rng.randrange(0, n)))


def test_any_order_of_changes_equals_a_rebuild(spark, tmp_path):
    rng = random.Random(3)
    index, held = Postings(spark, str(tmp_path / "index"), bits=2), {}
    questions = {q: " ".join(rng.choice([*WORDS, "unknown"]) for _ in range(q % 4)) for q in range(6)} | {9: "row row key"}
    same(spark, index, held, questions)
    for step in range(4):
        ids = [*rng.sample(range(-20, 40), 15), 2**61 + step]
        news = {i: write(rng, 12) for i in ids}
        gone = rng.sample(range(-20, 40), 8)
        again = {i: t for i, t in held.items() if i % 2}  # most come as they are
        index.apply(frame(spark, again | news), spark.createDataFrame([(i,) for i in gone], "chunk_id long"))
        held = {i: t for i, t in (held | news).items() if i not in gone}
        same(spark, index, held, questions)
        if step == 2:
            index.merge()
            same(spark, index, held, questions)
            assert index.read("docs").select("gen").distinct().count() == 1


def test_unchanged_chunks_write_nothing(spark, tmp_path):
    index, texts = Postings(spark, str(tmp_path / "index")), {1: "spark join", 2: ""}
    for _ in range(2):
        index.apply(frame(spark, texts))
    gens = index.read("docs").groupBy("gen").count().collect()
    assert len(gens) == 1 and gens[0]["count"] == 2 and index.read("killed").count() == 0
    same(spark, index, texts, {1: "spark"})


def test_nulls_repeats_and_unknown_deletions(spark, tmp_path):
    index = Postings(spark, str(tmp_path / "index"))
    rows = [(1, None), (None, "spark"), (2, "spark join"), (2, "spark join"), (3, "key"), (3, "row"), (4, "task")]
    index.apply(spark.createDataFrame(rows, "chunk_id long, text string"), spark.createDataFrame([(4,), (99,), (None,)], "chunk_id long"))
    least = min(("key", "row"), key=lambda w: __import__("hashlib").sha1(w.encode()).hexdigest())
    same(spark, index, {1: "", 2: "spark join", 3: least}, {1: "spark key row task"})


def test_a_generation_that_was_not_committed_does_not_count(spark, tmp_path, monkeypatch):
    index, texts = Postings(spark, str(tmp_path / "index")), {1: "spark join"}
    index.apply(frame(spark, texts))
    monkeypatch.setattr(Postings, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        index.apply(frame(spark, {1: "key", 2: "row"}))
    monkeypatch.undo()
    same(spark, index, texts, {1: "spark key"})
    index.apply(frame(spark, {2: "row"}))
    same(spark, index, texts | {2: "row"}, {1: "spark row"})


def test_blocks_that_cannot_matter_stay_shut(spark, tmp_path):
    rng = random.Random(5)
    texts = {i: "row " + write(rng, 30) for i in range(600)} | {i: "row row row row row key" for i in range(300, 306)}
    index = Postings(spark, str(tmp_path / "index"), bits=4)
    index.apply(frame(spark, texts))
    found, blocks = ask(spark, index, {1: "row key"}, k=5, seed=2)
    assert found == plain(texts, {1: "row key"}, 5)
    n, opened = blocks.agg(F.count("*"), F.sum(F.col("opened").cast("int"))).first()
    assert n > 30 and opened < n // 2
    scores = index.score(index.weights(lexical.query_terms(spark.createDataFrame([(1, "row key")], "query_id int, q string"))), blocks)
    top = scores.withColumn("block", F.shiftright("chunk_id", 4)).groupBy("block").agg(F.max("bm25").alias("best")).join(blocks, "block")
    assert top.where("best > bound + 1e-6").count() == 0 and top.count() == n


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(WORDS[:3]), max_size=6).map(" ".join), min_size=1, max_size=12), st.integers(1, 5))
def test_ties_at_the_last_place(spark, tmp_path_factory, texts, k):
    index, held = Postings(spark, str(tmp_path_factory.mktemp("index") / "x"), bits=1), dict(enumerate(texts))
    index.apply(frame(spark, held))
    assert ask(spark, index, {1: "spark join", 2: "shuffle"}, k)[0] == plain(held, {1: "spark join", 2: "shuffle"}, k)


def test_tokenizer_stays_that_of_the_index(spark, tmp_path):
    index = Postings(spark, str(tmp_path / "index"), tokenizer=tx.tokens_cased)
    index.apply(frame(spark, {1: "Spark spark"}))
    assert {r["term"] for r in index.frequency.collect()} == {"Spark", "spark"}


def test_a_search_moves_no_row_for_a_query_and_a_block(spark, tmp_path):
    """What is dealt is a row for a block and a term, however many queries ask for the term."""
    index = Postings(spark, str(tmp_path / "index"))
    texts = {i: "row key" if i % 3 else "row" for i in range(400)}
    index.apply(frame(spark, texts))
    index.apply(frame(spark, {i: "key" for i in range(0, 400, 5)}), spark.createDataFrame([(7,)], "chunk_id long"))
    texts = {i: "key" if i % 5 == 0 else t for i, t in texts.items() if i != 7}
    questions = {q: "row key row" if q % 2 else "row" for q in range(300)}
    got, _ = ask(spark, index, questions, k=3)
    assert got == plain(texts, questions, 3)
    plan = index.search(lexical.query_terms(spark.createDataFrame(list(questions.items()), "query_id int, q string")), 3)[0]._jdf.queryExecution().toString()
    assert "bound#" not in plan


def test_blocks_lie_whole_in_one_file(spark, tmp_path):
    index = Postings(spark, str(tmp_path / "index"), bits=2)
    index.apply(frame(spark, {i: "row key task" for i in range(64)}))
    files = index.read("blocks").withColumn("file", F.input_file_name()).groupBy("block").agg(F.countDistinct("file").alias("n"), F.count("*").alias("terms"))
    assert [tuple(r) for r in files.select("n", "terms").distinct().collect()] == [(1, 3)]
