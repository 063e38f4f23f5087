"""Candidates with exact ranks against the whole grid: ties, negative cosines, chunks without vectors or words, questions in parts."""

import random

import pytest
from pyspark.sql import functions as F

from vantaloom.operators import fused, fusion, lexical

WORDS = ["spark", "join", "shuffle", "skew", "plan", "task", "row", "key"]


def small(seed, n):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 9))) for _ in range(n)]
    vector = lambda: [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)]
    vectors = {i: None if i % 11 == 0 else [1.0, None, 0.0] if i % 13 == 0 else [1.0, 2.0] if i % 17 == 0 else vector() for i in range(n) if i % 3}
    questions = [(q, " ".join(rng.choice(WORDS + ["unknown"]) for _ in range(q % 5))) for q in range(1, 9)]
    return texts, vectors, questions, {q: vector() for q, _ in questions if q != 4}


def grid(texts, vectors, questions, q_vectors, index, spark, light):
    """Every question and chunk, by the DataFrame operators, ranked in plain Python."""
    qs = spark.createDataFrame(questions, "query_id int, q string")
    bm25 = {(r[0], r[1]): r[2] for r in lexical.bm25_matches(index, lexical.query_terms(qs)).collect()}
    out = {}
    for q, _ in questions:
        rows = []
        for c in range(len(texts)):
            u, v, w = q_vectors.get(q), vectors.get(c), 0.3 if light(c) else 1.0
            cosine = sum(x * y for x, y in zip(u, v, strict=True)) if u and v and len(v) == 3 and None not in v else 0.0
            rows.append((c, round(round(cosine, 8) * w, 8) + 0.0, round(round(bm25.get((q, c), 0.0), 8) * w, 8)))
        by_v, by_b = (sorted(rows, key=lambda r, k=k: (-r[k], r[0])) for k in (1, 2))
        place = [{r[0]: i for i, r in enumerate(s)} for s in (by_v, by_b)]
        out[q] = {c: (place[0][c], place[1][c]) for c, _, _ in rows}
    return out


@pytest.mark.parametrize(("n", "megabytes", "light"), [(90, 64, False), (200, 0.0001, True), (5, 64, False)])
def test_candidates_have_exact_ranks_and_hold_every_top(spark, monkeypatch, n, megabytes, light):
    monkeypatch.setattr(fused, "WEIGHTS_MB", megabytes)
    monkeypatch.setattr(fused, "_BLOCK", 17)
    texts, vectors, questions, q_vectors = small(n, n)
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "chunk_id long, text string").repartition(3)
    index = lexical.build_index(chunks)
    v = spark.createDataFrame(list(vectors.items()), "chunk_id long, embedding array<double>")
    qv = spark.createDataFrame(list(q_vectors.items()), "query_id int, embedding array<double>")
    flags = chunks.select("chunk_id", F.when(F.col("chunk_id") % 4 == 0, 0.3).otherwise(1.0).alias("lighter")) if light else None
    parts = fused.parts(index, spark.createDataFrame(questions, "query_id int, q string"), v, qv, flags)
    want = grid(texts, vectors, questions, q_vectors, index, spark, lambda c: light and c % 4 == 0)
    assert (len(parts) > 1) == (megabytes < 1)
    scores = [(fusion.rrf("r_cosine", "r_bm25"), 3), (fusion.min_rank("r_cosine", "r_bm25"), 5), (fusion.rrf("r_cosine", "r_bm25", weights=(0.85, 0.15)), 4), (-F.col("r_cosine").cast("double"), 6)]
    for part in parts:
        for depth in (2, fused.enough(part, scores)):
            got = fused.candidates(part, depth)
            rows = got.collect()
            assert bool(rows) == bool(part.ids) and all((r["r_cosine"], r["r_bm25"]) == want[r["query_id"]][r["chunk_id"]] for r in rows)
        for score, k in scores:
            top = {(r["query_id"], r["rank"]): r["chunk_id"] for r in fusion.fuse(got, score, k).collect()}
            full = spark.createDataFrame([(q, c, *r) for q in part.ids for c, r in want[q].items()], "query_id int, chunk_id long, r_cosine long, r_bm25 long")
            assert top == {(r["query_id"], r["rank"]): r["chunk_id"] for r in fusion.fuse(full, score, k).collect()}


def test_no_questions_and_no_chunks(spark):
    chunks = spark.createDataFrame([(1, "spark join")], "chunk_id long, text string")
    questions = spark.createDataFrame([(1, "spark"), (2, "")], "query_id int, q string")
    v, qv = spark.createDataFrame([], "chunk_id long, embedding array<double>"), spark.createDataFrame([], "query_id int, embedding array<double>")
    found = [fused.candidates(p, 4) for p in fused.parts(lexical.build_index(chunks), questions, v, qv)]
    assert sorted((r["query_id"], r["chunk_id"], r["r_bm25"]) for f in found for r in f.collect()) == [(1, 1, 0), (2, 1, 0)]
    for a, b in ((chunks.where("false"), questions), (chunks, questions.where("false"))):
        assert sum(fused.candidates(p, 4).count() for p in fused.parts(lexical.build_index(a), b, v, qv)) == 0


def test_rankings_begin_as_the_whole_and_reach_what_is_sought(spark):
    """The ranking holds the first chunks, goes on to the first of each group, and no further question by question."""
    texts, vectors, questions, q_vectors = small(3, 400)
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").repartition(3)
    index = lexical.build_index(chunks)
    v = spark.createDataFrame(list(vectors.items()), "chunk_id long, embedding array<double>")
    qv = spark.createDataFrame(list(q_vectors.items()), "query_id int, embedding array<double>")
    (part,) = fused.parts(index, spark.createDataFrame(questions, "query_id int, q string"), v, qv)
    want = grid(texts, vectors, questions, q_vectors, index, spark, lambda c: False)
    whole = {q: [c for _, c in sorted((-round(1 / (61 + r[0]) + 1 / (61 + r[1]), 10), c) for c, r in own.items())] for q, own in want.items() if q in part.ids}
    deep = {q: own[-1 if q == 2 else 150 if q == 3 else 2] for q, own in whole.items()}
    found = spark.createDataFrame([(q, "g", c) for q, c in deep.items()], "query_id int, gold string, chunk_id long")
    got = {}
    for r in fused.ranked_until(part, fusion.rrf("r_cosine", "r_bm25"), found, ["query_id", "gold"], 10).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["chunk_id"]
    for q, own in whole.items():
        assert [got[q][i + 1] for i in range(len(got[q]))] == own[: len(got[q])]
        assert len(got[q]) >= 10 and deep[q] in got[q].values()
    assert len(got[2]) == 400 and min(map(len, got.values())) < 400


def test_stage_diagnosis_makes_no_grid(spark, monkeypatch):
    def grid(*_, **__):
        raise AssertionError("a row for every question and chunk")

    monkeypatch.setattr(lexical, "with_all_chunks", grid)
    got = __import__("__spark_entry__").queries()["stage_diagnosis"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 40 and all((r["recalled"]) == ((r["rank_fused"] or 99) <= 20) for r in got)
