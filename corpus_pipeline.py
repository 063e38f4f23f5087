"""A corpus pipeline: toxicity, n-gram Jaccard join, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written
as Parquet and read again as the next stage's ``docs``. Toxic documents go; of each
group of near-duplicates the document with the least id stays; secrets are replaced in
the texts that remain; the last stage packs them into token sequences. A stage works
on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantaloom.llm import ngram_join, packing, secrets, toxicity
from vantaloom.llm.queries import tokenizer
from vantaloom.sources.runtime import stage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on this corpus's labels, does not reject."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join."""
    return ngram_join.keep_first(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in the text and the length counted anew (kept where there is no text)."""
    found = stage(secrets.findings(secrets.scan(docs).where("size(spans) > 0")), "findings")
    clean = secrets.redact(docs, found)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), "n_chars").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), with_ids=False)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", drop_near_duplicates), ("secrets", redact_secrets), ("packing", pack_sequences)]

# A trained classifier and a tokenizer are beyond SQL; tests/llm compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = step(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stage(docs, f"pipeline-{name}")
    return docs
