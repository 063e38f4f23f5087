"""What the arms of paired statistics read: chunks are scored once a pass, tokens aren't written, and no more texts are searched than strategies list."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.test_fused import WORDS, grid, small
from vantaloom.functions.text import tokens
from vantaloom.operators import fused, fusion, lexical, metrics, paired
from vantaloom.plans import evaluation

SF = "/root/testdata/sf0.01"


def parts_of(spark, n, index=lexical.index_of):
    texts, vectors, questions, q_vectors = small(n, n)
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").repartition(3)
    v = spark.createDataFrame(list(vectors.items()), "chunk_id long, embedding array<double>")
    qv = spark.createDataFrame(list(q_vectors.items()), "query_id int, embedding array<double>")
    own = fused.parts(index(chunks), spark.createDataFrame(questions, "query_id int, q string"), v, qv)
    return own, grid(texts, vectors, questions, q_vectors, lexical.build_index(chunks), spark, lambda c: False)


def test_a_chunk_is_scored_once_for_the_lists_and_once_for_the_ranks(spark, monkeypatch):
    (part,), want = parts_of(spark, 90, lexical.build_index)
    scored, plain = spark.sparkContext.accumulator(0), fused._scored

    def counting(part):
        score = plain(part)

        def run(batch):
            scored.add(batch.num_rows)
            return score(batch)

        return run

    monkeypatch.setattr(fused, "_scored", counting)
    rows = fused.candidates(part, 8).collect()
    assert rows and all((r["r_cosine"], r["r_bm25"]) == want[r["query_id"]][r["chunk_id"]] for r in rows)
    assert scored.value == 2 * 90


def test_arms_write_no_tokens_and_search_listed_texts_alone(spark, monkeypatch):
    labels, searched = [], []
    plain, find = lexical.stage, metrics.occurrences
    noted = lambda df, label, *more: labels.append(label) or plain(df, label, *more)
    for module in (lexical, fused):
        monkeypatch.setattr(module, "stage", noted)

    def occurrences(texts, gold, *more, **named):
        searched.append(texts.count())
        return find(texts, gold, *more, **named)

    monkeypatch.setattr(metrics, "occurrences", occurrences)
    pairs = evaluation.arm_pairs(spark, SF)
    assert pairs.count() == 40 and paired.recall_intervals(pairs, draws=50).count() == 12
    assert "cells" in labels and "tokens" not in labels
    assert len(searched) == 1 and 20 <= searched[0] < 1000


@pytest.mark.parametrize("megabytes", [64, 0.0001])
def test_the_depth_is_told_from_the_ranks(spark, monkeypatch, megabytes):
    """A score that counts the worse rank in full asks ``enough`` for a depth that grows with the chunks."""
    monkeypatch.setattr(fused, "DEPTH", 8)
    monkeypatch.setattr(fused, "WEIGHTS_MB", megabytes)
    parts, want = parts_of(spark, 400)
    assert (len(parts) > 1) == (megabytes < 1)
    steep = -(F.least("r_cosine", "r_bm25") + 0.4 * F.greatest("r_cosine", "r_bm25"))
    chosen, asked, plain = [(steep, 3), (fusion.rrf("r_cosine", "r_bm25"), 4)], [], fused.candidates
    monkeypatch.setattr(fused, "candidates", lambda part, depth: asked.append((depth, len(part.ids))) or plain(part, depth))
    for part in [p for p in parts if p.ids]:
        got, most = fused.reaching(part, chosen), fused.enough(part, chosen)
        assert most > 100
        for score, k in chosen:
            full = spark.createDataFrame([(q, c, *r) for q in part.ids for c, r in want[q].items()], "query_id int, chunk_id long, r_cosine long, r_bm25 long")
            top = [{(r["query_id"], r["rank"]): r["chunk_id"] for r in fusion.fuse(df, score, k).collect()} for df in (got, full)]
            assert top[0] == top[1] and len(top[0]) == k * len(part.ids)
    if megabytes > 1:
        assert asked[0] == (16, len(parts[0].ids)) and sum(n for depth, n in asked if depth > 64) < len(parts[0].ids)


def test_words_of_texts_as_the_tokens(spark):
    texts = ["", None, "Spark joins 2 tables", "a", "b", " ", "İK ſß Ǆ é1E", "中文y Z9", "x_y-z’s\nTAB\t0", "end", ""] + [" ".join(WORDS) + "中" * 3, "\U0001f600ok"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    want = {r[0]: Counter(r[1]) for r in frame.select("i", tokens(F.col("text"))).collect()}
    batch = frame.orderBy("i").toArrow().column("text").combine_chunks()
    for at in (0, 3):
        of, words = lexical.words_of(batch.slice(at))
        got = [Counter() for _ in texts[at:]]
        for i, w in zip(of.tolist(), words.to_pylist(), strict=True):
            got[i][w] += 1
        assert got == [want[i] for i in range(at, len(texts))]
    assert [len(x) for x in lexical.words_of(batch.slice(0, 0))] == [0, 0]
