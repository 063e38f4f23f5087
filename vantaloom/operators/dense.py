"""Dense retrieval: embeddings by provider, cosine on unit vectors, top-k."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantaloom.functions.text import CJK
from vantaloom.operators.ranking import top_k
from vantaloom.sources.runtime import ship_package, small_side

QUERY_PREFIX = "Represent this sentence for searching relevant passages: "  # a fixed value: the instruction before queries of this model family
MATRIX_MB = 256
_WORDS, _CJK = re.compile("[a-z0-9]+"), re.compile(CJK)


class HashModel:
    """A deterministic embedder without weights: signless feature hashing of tokens, L2-normalised."""

    def __init__(self, dim: int = 64, most_words: int = 200_000):
        self.dim, self.most, self.known = dim, most_words, {}

    def slot(self, word: str) -> int:
        at = self.known.get(word)
        if at is None:
            at = int.from_bytes(hashlib.sha1(word.encode()).digest()[:4], "big") % self.dim
            if len(self.known) < self.most and len(word) < 64:
                self.known[word] = at
        return at

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            words = _WORDS.findall(text.lower()) + _CJK.findall(text)
            out[i] = np.bincount([self.slot(w) for w in words], minlength=self.dim) if words else 0
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


@lru_cache(maxsize=4)
def _model(load: Callable):
    return load()


def embed(text: Column, load: Callable = HashModel, batch: int = 32) -> Column:
    """Vectors of texts by a model with ``encode(list of texts) -> rows``; null texts count as empty.

    ``load`` runs once in a worker's lifetime; it must be a function or class of an
    importable module. The model sees at most ``batch`` texts at a time.
    """
    ship_package(SparkSession.active())

    def run(values: pa.Array) -> pa.Array:
        model, texts = _model(load), [t or "" for t in values.to_pylist()]
        rows = [row for at in range(0, len(texts), batch) for row in np.asarray(model.encode(texts[at : at + batch]), dtype=np.float64)]
        return pa.array(rows, pa.list_(pa.float64()))

    return F.arrow_udf(run, returnType="array<double>")(text)


def hash_embedding(text: Column) -> Column:
    """The embedder without a model, for tests and as a default."""
    return embed(text, HashModel)


def with_query_prefix(text: Column) -> Column:
    """The instruction that goes before queries, and not before documents."""
    return F.concat(F.lit(QUERY_PREFIX), text)


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; on unit vectors, the cosine."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def whole(vector: Column, dim: int) -> Column:
    """Whether a vector has the length and no null component; others have no score."""
    return F.coalesce((F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull()), F.lit(False))


def score_matrix(vectors: DataFrame, queries: DataFrame, id_col: str = "chunk_id", vector_col: str = "embedding", digits: int = 8) -> DataFrame:
    """(query_id, chunk_id, cosine) of every pair, for bulk work: one matrix product a batch.

    The query side is gathered after a check of its size (``MATRIX_MB``); a larger one
    is joined pair by pair with it as the streamed side of a nested loop.
    """
    ship_package(vectors.sparkSession)
    n, dim = queries.agg(F.count("*"), F.max(F.size(vector_col))).first()
    queries = queries.where(whole(F.col(vector_col), dim or 0))
    if (n or 0) * (dim or 0) * 8 > MATRIX_MB * 1e6:
        pairs = vectors.where(whole(F.col(vector_col), dim)).select(F.col(id_col).alias("chunk_id"), F.col(vector_col).alias("v")).crossJoin(queries.select("query_id", F.col(vector_col).alias("u")))
        return pairs.select("query_id", "chunk_id", F.round(dot(F.col("v"), F.col("u")), digits).alias("cosine"))
    rows = queries.select("query_id", vector_col).orderBy("query_id").collect()
    ids = [r[0] for r in rows]
    held = vectors.sparkSession.sparkContext.broadcast(np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), dim or 0))

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, dim)
                scores = np.round(v @ q.T, digits) + 0.0
                chunk = np.repeat(part.column(0).to_numpy(zero_copy_only=False), len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(ids * part.num_rows), pa.array(chunk, pa.int64()), pa.array(scores.reshape(-1))], names=["query_id", "chunk_id", "cosine"])

    known = vectors.where(whole(F.col(vector_col), dim or 0)).select(F.col(id_col).cast("long").alias("chunk_id"), F.col(vector_col))
    return known.mapInArrow(product, f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id long, cosine double")


def dense_top_k(scores: DataFrame, k: int = 10) -> DataFrame:
    """The k best chunks of each query, ties by chunk."""
    return top_k(scores, "query_id", k, [F.desc("cosine"), F.asc("chunk_id")])


def similar_queries(queries: DataFrame, threshold: float = 0.8, vector_col: str = "embedding") -> DataFrame:
    """Pairs of queries (upper triangle) at or over a similarity; ``alarm`` marks them."""
    a = queries.select(F.col("query_id").alias("a"), F.col(vector_col).alias("u"))
    b = queries.select(F.col("query_id").alias("b"), F.col(vector_col).alias("v"))
    pairs = a.join(small_side(b), F.col("a") < F.col("b"))
    return pairs.select("a", "b", F.round(dot(F.col("u"), F.col("v")), 6).alias("similarity")).withColumn("alarm", F.col("similarity") >= threshold)
