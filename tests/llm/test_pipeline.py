"""The pipeline's stages, and the guard of the entry module."""

import re
import zlib

import corpus_pipeline
import numpy as np
import plain_toxicity
import pytest

import __spark_entry__
from vantaloom.llm import queries, secrets, tokens, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES:
        after = step(spark, docs, SF)
        if name != "packing":
            assert after.columns == docs.columns
            after = corpus_pipeline.stage(after, "test")
        out.append((name, docs, after))
        docs = after
    return out


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(zip(*(words[i:] for i in range(5)), strict=False)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def test_stages_against_brute_force(spark, stages):
    (_, whole, clean), (_, _, unique), (_, _, redacted), (_, _, pieces) = stages
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(whole, labels)
    rows = [tuple(r) for r in whole.select("doc_id", "text").collect()]
    plain = plain_toxicity.Plain(rows, [tuple(r) for r in labels.select("doc_id", "toxic").collect()])
    plain_toxicity.agrees(model, plain)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, text in rows if plain.probability(text, model.link) < 0.5}

    rows = sorted((r["doc_id"], shingles(r["text"])) for r in clean.collect())
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    assert {r["doc_id"] for r in unique.collect()} == {d for d, _ in rows if find(d) == d}

    before, after = ({r["doc_id"]: r for r in df.collect()} for df in (unique, redacted))
    assert before.keys() == after.keys()
    for d, r in after.items():
        assert r["n_chars"] == len(r["text"])
        if r["text"] == before[d]["text"]:
            assert not any(len(m[rule.group]) >= rule.least for rule in secrets.BASE for m in re.finditer(rule.pattern, r["text"]))
        else:
            assert "[SECRET]" in r["text"]

    library = tokens.library(queries.tokenizer("byte_bpe_50k.json"))
    ids = {d: np.array([*library.encode(r["text"], add_special_tokens=False).ids, 0], "<u4") for d, r in after.items()}
    got = {}
    for p in pieces.collect():
        assert p["ids_crc32"] == zlib.crc32(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]])
        got[p["doc_id"]] = got.get(p["doc_id"], 0) + p["length"]
    assert got == {d: len(x) for d, x in ids.items()}


def test_entry_lists_every_operator():
    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
