"""Toxic passages by maximum-scoring segments, calibrated by extreme values.

Units are words and prefixes of words. A unit's toxic share is shrunk towards that of
the next shorter prefix, as the posterior mean under a Dirichlet prior centred on it;
its score is the log-odds against the share of all tokens. A token scores as its
longest known unit, less a drift that keeps the expected score below zero. One linear
scan finds every maximal scoring segment of a text. With lambda the root of
sum p(s) exp(lambda s) = 1 over background tokens, and K from the count of background
segments, a segment of score S in n tokens has the expectation E = K n exp(-lambda S).
The evidence of the best and of all significant segments goes through a logistic link.

Learning: rows of ``labels`` whose crc32(doc_id) mod 5 is not 0, at most about
``max_train`` of them (by hash; the documented bound of the sample). Token counts keep
four folds apart, so that each training document is calibrated by a model that has
not seen it. The model has at most ``max_units`` units, which bounds its broadcast.
Scoring covers every document; only the text is an input of a score.

Cases: a null or empty text has no tokens and gets the score of no evidence. Without
usable labels of both classes every score is the share of toxic labels (0 without
any). Repeated labels of a document count as toxic if one does; null ones are left
out. Rows that repeat get equal scores. An empty table gives an empty result. Extra
columns are not carried along.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantaloom.sources.runtime import ship_package, stage

FOLDS, LEAST, LONGEST, PRIOR, DRIFT, CACHE, KEPT = 4, 3, 8, 20.0, 0.5, 150_000, 64
WORDS = re.compile(r"\w+").findall
COUNTS = [f"c{c}_{f}" for c in (0, 1) for f in range(FOLDS)]
SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_segments", T.IntegerType()), T.StructField("segments", T.StringType())])


def units(word: str) -> list[str]:
    """Prefixes from short to long, then the word itself."""
    return [word[:k] for k in range(LEAST, min(len(word), LONGEST + 1))] + [word + "$"]


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last + 1, score), in linear time.

    A stack holds candidates with the running total before and after each; a new
    positive token joins back over those candidates that it improves.
    """
    total = np.cumsum(scores)
    stack: list[tuple] = []  # first, last + 1, total before, total after, place of the nearest candidate that starts lower
    for i in np.flatnonzero(scores > 0).tolist():
        after = float(total[i])
        first, before, j = i, after - float(scores[i]), len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= after:
                break
            first, before = stack[j][0], stack[j][2]
            del stack[j:]
            j -= 1
        stack.append((first, i + 1, before, after, j))
    return [(x[0], x[1], x[3] - x[2]) for x in stack]


@dataclass
class Model:
    """Unit scores, the constants of the extreme-value law and the logistic link."""

    scores: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 1.0
    link: tuple[float, ...] = (0.0, 0.0, 0.0)
    known: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    def token(self, word: str) -> float:
        out = 0.0
        for u in units(word):
            out = self.scores.get(u, out)
        return out - DRIFT

    def token_scores(self, text: str | None) -> np.ndarray:
        words = WORDS((text or "").lower())
        known = self.known
        fresh = set(words).difference(known)
        if fresh:
            if len(known) + len(fresh) > CACHE:
                known.clear()
                fresh = set(words)
            long = {w: self.token(w) for w in fresh if len(w) > KEPT}
            known.update((w, self.token(w)) for w in fresh if len(w) <= KEPT)
            if long:  # words too long to be kept, so that the table's bytes are bounded as well
                return np.array([long[w] if w in long else known[w] for w in words], dtype=np.float64)
        return np.array(list(map(known.__getitem__, words)), dtype=np.float64)

    def evidence(self, scores: np.ndarray) -> tuple[float, float, list[tuple[int, int, float]]]:
        """-log p of the best segment, the sum over significant ones, and those (E below 1)."""
        found = maximal_segments(scores)
        if not found:
            return 0.0, 0.0, []
        edge = math.log(self.k * len(scores) + 1e-300)
        bits = [(a, b, self.lam * s - edge) for a, b, s in found]
        good = [x for x in bits if x[2] > 0]
        best = max(x[2] for x in bits)
        expected = math.exp(-best) if best > -50 else math.inf
        return -math.log(-math.expm1(-expected)) if expected > 1e-12 else best, sum(x[2] for x in good), good

    def probability(self, best: float, total: float) -> float:
        z = self.link[0] + self.link[1] * math.log1p(best) + self.link[2] * math.log1p(total)
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def _shares(counts: dict[str, np.ndarray], toxic: np.ndarray, every: np.ndarray) -> dict[str, np.ndarray]:
    """Scores of units by fold left out (last: none left out), each shrunk towards its shorter prefix."""
    root = np.clip(toxic / np.maximum(every, 1), 1e-6, 1 - 1e-6)
    shares: dict[str, np.ndarray] = {}
    centres: dict[str, np.ndarray] = {}

    def share(u: str) -> np.ndarray:
        if u in shares:
            return shares[u]
        stem = u[:-1][:LONGEST] if u.endswith("$") else u[:-1]
        c, above = counts[u], root
        if len(stem) >= LEAST and stem in counts:
            # The prior is what the stem says without this unit's own tokens; else they would count at every length.
            rest = np.maximum(counts[stem] - c, 0)
            above = (rest[1] + PRIOR * centre(stem)) / (rest[0] + rest[1] + PRIOR)
        centres[u] = above
        shares[u] = (c[1] + PRIOR * above) / (c[0] + c[1] + PRIOR)
        return shares[u]

    def centre(u: str) -> np.ndarray:
        share(u)
        return centres[u]

    for u in sorted(counts, key=len):
        share(u)
    logit = lambda p: np.log(p / (1 - p))
    return {u: logit(np.clip(s, 1e-6, 1 - 1e-6)) - logit(root) for u, s in shares.items()}


def _select(scores: dict[str, np.ndarray], at: int, max_units: int) -> dict[str, float]:
    """Units of clear toxic score, and those that correct a shorter unit that is kept."""
    clear = {u: float(s[at]) for u, s in scores.items() if s[at] > 0.7}
    if len(clear) > max_units // 2:
        clear = dict(sorted(clear.items(), key=lambda x: (-x[1], x[0]))[: max_units // 2])
    out = dict(clear)
    for u in sorted(scores):
        if u not in out and len(out) < max_units and any(p in clear for p in units(u.removesuffix("$"))):
            out[u] = max(0.0, float(scores[u][at]))
    return out


def _lambda(positive: np.ndarray, often: np.ndarray, n_tokens: float) -> float:
    """The positive root of sum p(s) exp(lambda s) = 1 for positive scores and their numbers; other tokens score minus the drift."""
    rest = max(n_tokens - float(often.sum()), 0.0)
    total = lambda x: ((np.exp(np.minimum(x * positive, 700)) * often).sum() + rest * math.exp(-x * DRIFT)) / max(n_tokens, 1)
    low, high = 1e-3, 1e-3
    while total(high) < 1 and high < 20:
        high *= 1.5
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if total(mid) < 1 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge-regularised logistic regression with two slopes of zero or above.

    The best weights are the best without a bound for the slopes that are not zero, so
    each choice of those is fitted by Newton steps, and the best allowed fit is taken.
    """
    a = np.column_stack([np.ones(len(x)), x])
    ridge = np.array([1e-6, 0.05, 0.05])
    loss = lambda w: np.logaddexp(0, a @ w).sum() - y @ (a @ w) + (ridge * w * w).sum() / 2

    def fit(*free: int) -> np.ndarray:
        w, at = np.zeros(a.shape[1]), np.ix_(free, free)
        w[0] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
            rise = a.T @ (y - p) - ridge * w
            move = np.zeros(len(w))
            move[[*free]] = np.linalg.solve(((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge))[at], rise[[*free]])
            move *= min(1.0, 2 / max(np.abs(move).max(), 1e-300))
            while np.abs(move).max() > 1e-9 and loss(w + move) > loss(w):
                move /= 2
            w = w + move
            if np.abs(move).max() < 1e-8:
                break
        return w

    fits = [fit(0), fit(0, 1), fit(0, 2), fit(0, 1, 2)]
    return tuple(map(float, min((w for w in fits if (w[1:] >= 0).all()), key=loss)))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_train: int = 20_000, max_units: int = 60_000) -> Model:
    """Learn a model; what is collected is bounded by the sample and by ``max_units``."""
    ship_package(docs.sparkSession)
    usable = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n = usable.count()
    if n > max_train:
        usable = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < 1_000_000 * max_train // n)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).join(F.broadcast(usable), "doc_id")  # at most about max_train rows of two numbers
    # A text counts once however many copies it has; near copies, which mostly begin alike, share a fold.
    rows = rows.groupBy("text").agg(F.max("toxic").alias("toxic")).select("text", "toxic", F.pmod(F.xxhash64(F.substring("text", 1, 40)), F.lit(FOLDS)).cast("int").alias("fold"))
    rows = stage(rows, "toxicity-sample")  # bounded by max_train; the documents are read once for it

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = defaultdict(lambda: [0] * len(COUNTS))

        def flush() -> pa.RecordBatch:
            table = [pa.array(list(seen), pa.string())] + [pa.array(c, pa.int64()) for c in (zip(*seen.values(), strict=True) if seen else [[]] * len(COUNTS))]
            seen.clear()
            return pa.RecordBatch.from_arrays(table, names=["word", *COUNTS])

        for batch in batches:
            for text, toxic, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = toxic * FOLDS + fold
                for w in set(WORDS((text or "").lower())):
                    seen[w][at] += 1
                if len(seen) > CACHE:
                    yield flush()
        yield flush()

    words = rows.mapInArrow(count, "word string, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("word").agg(*[F.sum(c).alias(c) for c in COUNTS])
    prefixes = F.transform(F.sequence(F.lit(LEAST), F.least(F.length("word") - 1, F.lit(LONGEST))), lambda k: F.substring("word", F.lit(1), k))
    every = F.concat(F.when(F.length("word") > LEAST, prefixes).otherwise(F.array().cast("array<string>")), F.array(F.concat("word", F.lit("$"))))
    sums = words.select(F.explode(every).alias("unit"), *COUNTS).groupBy("unit").agg(*[F.sum(c).alias(c) for c in COUNTS])
    c1, c0 = (sum((F.col(f"c{k}_{f}") for f in range(1, FOLDS)), F.col(f"c{k}_0")) for k in (1, 0))
    # Every token has one unit that ends in "$", so those give the totals.
    totals = sums.where(F.col("unit").endswith("$")).agg(*[F.sum(c).alias(c) for c in COUNTS]).collect()[0]
    if not any(totals[c] for c in COUNTS if c[1] == "1") or not any(totals[c] for c in COUNTS if c[1] == "0"):
        share = usable.agg(F.avg("toxic")).collect()[0][0] or 0.0
        return Model(link=(math.log(min(max(share, 1e-12), 1 - 1e-12) / (1 - min(max(share, 1e-12), 1 - 1e-12))), 0.0, 0.0))
    toxic_share = sum(totals[f"c1_{f}"] for f in range(FOLDS)) / sum(totals[c] for c in COUNTS)
    useful = sums.where((c1 + c0 >= 4) & (c1 >= 2) & (c1 > 1.2 * toxic_share * (c1 + c0)))
    table = useful.orderBy(F.desc(c1), "unit").limit(4 * max_units).toArrow()
    counts: dict[str, np.ndarray] = {}
    left_out = lambda m: np.append(m.sum(1, keepdims=True) - m, m.sum(1, keepdims=True), axis=1)
    for unit, *c in zip(*(table.column(n).to_pylist() for n in ["unit", *COUNTS]), strict=True):
        counts[unit] = left_out(np.array(c, dtype=np.float64).reshape(2, FOLDS))
    whole = left_out(np.array([totals[c] for c in COUNTS], dtype=np.float64).reshape(2, FOLDS))
    scores = _shares(counts, whole[1], whole.sum(0))
    by_fold = [Model(_select(scores, f, max_units)) for f in range(FOLDS + 1)]
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(by_fold[:FOLDS]))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per text its tokens and segment scores; per batch how often background tokens have each positive score."""
        models = pickle.loads(held.value)
        kinds = (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.int64())
        for batch in batches:
            out, often = [], Counter()
            for text, toxic, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = models[fold].token_scores(text)
                out.append((toxic, len(s), [x[2] for x in maximal_segments(s)], None, None))
                if not toxic:
                    often.update(s[s > 0].tolist())
            out.extend((None, None, None, x, n) for x, n in often.items())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=["toxic", "n", "segments", "value", "often"])

    found = stage(rows.mapInArrow(measure, "toxic int, n long, segments array<double>, value double, often long"), "toxicity-segments")
    background = found.where("toxic = 0")
    n_tokens = float(background.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    spread = found.where("value is not null").groupBy("value").agg(F.sum("often").alias("often")).orderBy("value").toArrow()  # at most one row for each score a unit has
    model = by_fold[FOLDS]
    model.lam = _lambda(spread.column("value").to_numpy(), spread.column("often").to_numpy(), n_tokens)
    tops = background.select(F.explode("segments").alias("top"))
    cut = tops.agg(F.percentile("top", 0.5)).first()[0]
    cut = 1.0 if cut is None else float(cut)
    model.k = max(1e-9, float(tops.where(F.col("top") >= cut).count()) / max(1.0, n_tokens * math.exp(-model.lam * cut)))
    constants = (model.lam, model.k)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for toxic, n, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                edge = math.log(constants[1] * max(n, 1))
                bits = [constants[0] * x - edge for x in own]
                best = max(bits, default=-math.inf)
                e = math.exp(-best) if best > -50 else math.inf
                p = -math.expm1(-e) if e > 1e-12 else math.exp(-min(best, 700))
                out.append((toxic, math.log1p(-math.log(max(p, 1e-300))), math.log1p(sum(b for b in bits if b > 0))))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.int32(), pa.float64(), pa.float64()), strict=True)], names=["toxic", "best", "total"])

    # Three numbers for each text of the bounded sample.
    table = found.where("toxic is not null").select("toxic", "n", "segments").mapInArrow(features, "toxic int, best double, total double").orderBy("toxic", "best", "total").toArrow()
    model.link = _logistic(np.column_stack([table.column("best").to_numpy(), table.column("total").to_numpy()]), table.column("toxic").to_numpy().astype(np.float64))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Every document's score, decision and significant passages (token places and evidence)."""
    ship_package(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = pickle.loads(held.value)
        for batch in batches:
            ps, ns, texts = [], [], []
            for text in batch.column(1):
                best, total, good = own.evidence(own.token_scores(text.as_py()))
                ps.append(own.probability(best, total))
                ns.append(len(good))
                texts.append(",".join(f"{a}:{b}:{bits:.2f}" for a, b, bits in good))
            predicted = [int(p >= 0.5) for p in ps]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ps, pa.float64()), pa.array(predicted, pa.int32()), pa.array(ns, pa.int32()), pa.array(texts, pa.string())], names=SCORED.fieldNames())

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCORED)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with their columns."""
    ship_package(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = pickle.loads(held.value)
        for batch in batches:
            keep = [own.probability(*own.evidence(own.token_scores(t.as_py()))[:2]) < 0.5 for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
