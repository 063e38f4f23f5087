"""Aggregation of a judge's verdicts, description synthesis, and the judge itself behind a provider."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantaloom.functions.text import chunk_key, strip, tokens
from vantaloom.sources.runtime import ship_package

VERDICTS = "struct<verdicts:array<struct<claim:string,fact:string,supported:boolean,stated:boolean>>>"
BATCH, SYNTH_CHARS = 15, 1200


def clean_claims(claims: Column) -> Column:
    """Claims trimmed, blank ones dropped, repeats dropped, in order."""
    return F.array_distinct(F.filter(F.transform(claims, strip), lambda c: F.length(c) > 0))


def faithfulness(rows: DataFrame, claims: str = "claims", supported: str = "supported") -> DataFrame:
    """Per answer: claims, verdicts, unsupported ones, the ratio, and whether verdicts are missing.

    Without claims the answer invents nothing (1.0); claims without verdicts give 0.
    """
    n = F.size(clean_claims(F.col(claims)))
    verdicts = F.size(supported)
    yes = F.size(F.filter(supported, lambda v: F.coalesce(v, F.lit(False))))
    ratio = F.when(F.size(claims) == 0, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(yes.cast("double"), verdicts), F.lit(0.0)))
    none = F.size(claims) == 0
    return rows.select("*", n.cast("long").alias("n_claims"), F.when(none, 0).otherwise(verdicts).cast("long").alias("n_verdicts"), F.when(none, 0).otherwise(verdicts - yes).cast("long").alias("n_unsupported"), F.round(ratio, 6).alias("faithfulness"), ratio.alias("ratio"), (~none & (n != verdicts)).alias("mismatch"))


def faithfulness_summary(scored: DataFrame, *keys: str) -> DataFrame:
    """The headline is the number of unsupported claims; the mean ratio comes with it. Means are of ratios before rounding, so the order of rows can't tip them."""
    return scored.groupBy(*keys).agg(F.count("*").alias("n_answers"), F.sum("n_unsupported").alias("n_unsupported"), F.round(F.avg("ratio"), 6).alias("mean_faithfulness"), F.count_if("mismatch").alias("n_mismatch"))


def correctness(rows: DataFrame, facts: str = "facts", stated: str = "stated") -> DataFrame:
    """Per answer: stated facts over the number of facts, not of verdicts."""
    n, hit = F.size(facts), F.size(F.filter(stated, lambda v: F.coalesce(v, F.lit(False))))
    share = F.coalesce(F.try_divide(hit.cast("double"), n), F.lit(0.0))
    return rows.select("*", n.cast("long").alias("n_facts"), hit.cast("long").alias("n_stated"), F.round(share, 6).alias("accuracy"), share.alias("ratio"), (n != F.size(stated)).alias("mismatch"))


def correctness_summary(scored: DataFrame, *keys: str) -> DataFrame:
    """Macro mean over answers, and micro counts of facts."""
    return scored.groupBy(*keys).agg(F.count("*").alias("n_answers"), F.round(F.avg("ratio"), 6).alias("mean_accuracy"), F.sum("n_stated").alias("n_stated"), F.sum("n_facts").alias("n_facts"), F.count_if("mismatch").alias("n_mismatch"))


def parse_verdicts(raw: Column) -> Column:
    """Verdicts of a judge's JSON; text that is none gives an empty array."""
    return F.coalesce(F.from_json(raw, VERDICTS)["verdicts"], F.array().cast("array<struct<claim:string,fact:string,supported:boolean,stated:boolean>>"))


def overlap_judge(claim: Column, context: Column, least: float = 0.6) -> Column:
    """A deterministic judge without a model: a claim is supported if the context has most of its distinct tokens."""
    own = F.array_distinct(tokens(claim))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(own, tokens(context))).cast("double"), F.size(own)), F.lit(0.0)) >= least


def synthesize(chunks: DataFrame, cache: DataFrame | None, provider: Callable[[list[str]], list[str]], batch: int = BATCH, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Descriptions of chunks by a provider that takes a list of texts; (chunks with ``description``, new cache rows).

    Only keys that the cache lacks are asked for, each once; a provider that fails or
    answers too little leaves blanks, which are not cached. A key that the cache holds
    twice, as after a build that ran again, counts once, with the least description.
    """
    ship_package(chunks.sparkSession)
    keyed = chunks.withColumn("key", chunk_key(F.col(text)))
    missing = keyed.select("key", F.substring(text, 1, SYNTH_CHARS).alias("cut")).dropDuplicates(["key"])
    if cache is not None:
        missing = missing.join(cache.select("key"), "key", "left_anti")
    w = Window.partitionBy(F.substring("key", 1, 3)).orderBy("key")
    numbered = missing.withColumn("batch_id", F.concat_ws(":", F.substring("key", 1, 3), F.floor((F.row_number().over(w) - 1) / batch)))

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            found = list(provider(pdf["cut"].tolist()))
        except Exception:  # a provider's failure must not fail the build; blanks are asked for again next time
            found = []
        found = (found + [""] * len(pdf))[: len(pdf)]
        return pd.DataFrame({"key": pdf["key"], "description": found})

    fresh = numbered.groupBy("batch_id").applyInPandas(ask, "key string, description string").where("description <> ''")
    whole = fresh if cache is None else cache.groupBy("key").agg(F.min("description").alias("description")).unionByName(fresh)
    return keyed.join(whole, "key", "left").withColumn("description", F.coalesce("description", F.lit(""))).drop("key"), fresh


class Judge:
    """A judge behind a chat provider ``(system, user) -> str``: claims, their support, stated facts."""

    def __init__(self, chat: Callable[[str, str], str]):
        self.chat = chat

    def _json(self, system: str, user: str) -> dict:
        try:
            data = json.loads(self.chat(system, user))
        except (json.JSONDecodeError, TypeError):
            return {}
        return data if isinstance(data, dict) else {}

    def decompose(self, answer: str) -> list[str]:
        return self._json("Split the answer into atomic claims, each one new fact. JSON: {\"claims\": [...]}", answer).get("claims", [])

    def verify(self, claims: list[str], context: str) -> list[dict]:
        return self._json("Say of each claim whether the context supports it. JSON: {\"verdicts\": [{\"claim\", \"supported\"}]}", json.dumps({"context": context, "claims": claims})).get("verdicts", [])

    def facts(self, answer: str, facts: list[str]) -> list[dict]:
        return self._json("Say of each fact whether the answer states it. JSON: {\"verdicts\": [{\"fact\", \"stated\"}]}", json.dumps({"answer": answer, "facts": facts})).get("verdicts", [])

    def calibrate(self, samples: list[tuple[str, str, bool]]) -> list[bool]:
        """For (context, answer, faithful) samples, whether the judge tells them right."""
        out = []
        for context, answer, faithful in samples:
            claims = self.decompose(answer)
            verdicts = self.verify(claims, context) if claims else []
            out.append((bool(verdicts) and all(v.get("supported") for v in verdicts)) == faithful)
        return out
