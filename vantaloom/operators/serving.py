"""Serving semantics over a request log: validation, cache, single flight, rate limit, suggestions.

In the time-dependent ones each decision rests on the one before. ``anchors.periods`` cuts
a key's requests into slices of time whose effects are composed, so that slices, not
keys, are dealt to tasks, however steady a hot key's requests come.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantaloom.operators.anchors import periods

MAX_QUERY_BYTES = 2000
CACHE_TTL, RATE_LIMIT, RATE_WINDOW, TOKEN_LIMIT, BODY_LIMIT = 600, 60, 60, 5, 64 * 1024  # fixed values: defaults in seconds, requests and bytes


def validate(query: Column, question: Column) -> Column:
    """A struct of the effective query and the status: ``query`` before ``question``, 400 if empty or over the bytes."""
    text = F.coalesce(F.nullif(query, F.lit("")), F.nullif(question, F.lit("")), F.lit(""))
    return F.struct(text.alias("query"), F.when((text == "") | (F.octet_length(text) > MAX_QUERY_BYTES), 400).otherwise(200).alias("status"))


def chat_status(question: Column, ready: Column, failed: Column) -> Column:
    """400 for an empty question, 503 before the index is ready, 500 on an error, else 200."""
    return F.when(F.trim(F.coalesce(question, F.lit(""))) == "", 400).when(~ready, 503).when(failed, 500).otherwise(200)


def suggestions(pool: DataFrame, seed: int, quotas: dict[str, int], extra: str = "id") -> DataFrame:
    """A sample without replacement of each category, in the order of the quotas; draws by a hash of seed and id."""
    key = F.sha1(F.concat_ws(":", F.lit(seed), F.col(extra)).cast("binary"))
    wanted = F.coalesce(*[F.when(F.col("category") == c, F.lit(n)) for c, n in quotas.items()])
    order = F.coalesce(*[F.when(F.col("category") == c, F.lit(i)) for i, c in enumerate(quotas)])
    w = Window.partitionBy("category").orderBy(key, extra)
    most = max(quotas.values())
    return pool.where(F.col("category").isin(list(quotas))).withColumn("pick", F.row_number().over(w).cast("long")).where(F.col("pick") <= most).where(F.col("pick") <= wanted).withColumn("place", order)


def runs_by_gap(log: DataFrame, key: str, at: str, gap: float, span: float = 3600.0) -> DataFrame:
    """Add ``run``, the time at which it begins: a key's requests are of one run while less than ``gap`` seconds lie between neighbours.

    Neighbours are found within slices of ``span`` seconds, so a hot key meets in no
    task; per key, only one row a slice is ordered.
    """
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    sliced = log.withColumn("__slice", F.floor(F.col(at) / span))
    slices = Window.partitionBy(key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy(key, "__slice").orderBy(at, "event_id")
    before = sliced.groupBy(key, "__slice").agg(F.max(at).alias("__end")).select(key, "__slice", last("__end", slices).alias("__before"))
    fresh = F.coalesce(F.col(at) - F.coalesce(F.lag(at).over(own), F.col("__before")) >= gap, F.lit(True))
    marked = sliced.join(before, [key, "__slice"]).withColumn("__start", F.when(fresh, F.col(at)))
    open_runs = marked.groupBy(key, "__slice").agg(F.max("__start").alias("__newest")).select(key, "__slice", last("__newest", slices).alias("__open"))
    joined = marked.join(open_runs, [key, "__slice"])
    return joined.withColumn("run", F.coalesce(last("__start", own.rowsBetween(Window.unboundedPreceding, 0)), F.col("__open"))).select(*log.columns, "run")


def cache_step(ttl: float) -> Callable:
    """Hits do not renew; a miss writes, and the entry lives ``ttl`` seconds from that write."""

    def step(written: float | None, row: tuple) -> tuple:
        at = row[0]
        hit = written is not None and at < written + ttl
        return (written if hit else at), (hit, written if hit else at)

    return step


def cache_replay(log: DataFrame, key: str, at: str, ttl: float = CACHE_TTL, span: float | None = None) -> DataFrame:
    """Per request: whether the cache answers it, and when its entry was written."""
    p = periods(log, key, at, float(ttl), span or _span(ttl))
    return p.select(F.col("key").alias(key), F.col("event").alias("event_id"), F.col("at").alias(at), (~F.col("first")).alias("hit"), F.col("begin").alias("written_at"))


def rate_step(limit: int, window: float) -> Callable:
    """A counter with an expiry that is set at its first request alone; allowed up to the limit."""

    def step(state: tuple | None, row: tuple) -> tuple:
        at = row[0]
        start, n = state if state is not None and at < state[0] + window else (at, 0)
        return (start, n + 1), (n + 1, n + 1 <= limit)

    return step


def rate_replay(log: DataFrame, key: str, at: str, limit: int = RATE_LIMIT, window: float = RATE_WINDOW, span: float | None = None) -> DataFrame:
    """Per request: the counter's value and whether it is allowed; windows start at the first request."""
    p = periods(log, key, at, float(window), span or _span(window))
    return p.select(F.col("key").alias(key), F.col("event").alias("event_id"), F.col("at").alias(at), F.col("count").alias("n_in_window"), (F.col("count") <= limit).alias("allowed"))


def single_flight(log: DataFrame, key: str, at: str, duration: str, span: float | None = None) -> DataFrame:
    """Per request: whether it shares a call in flight, and when that call ends. A request that finds none starts one of its own duration."""
    longest = 0.0 if span else log.agg(F.coalesce(F.max(F.nanvl(F.col(duration).cast("double"), F.lit(0.0))), F.lit(0.0))).first()[0]
    p = periods(log, key, at, F.col(duration), span or _span(longest))
    return p.select(F.col("key").alias(key), F.col("event").alias("event_id"), F.col("at").alias(at), (~F.col("first")).alias("shared"), F.col("end").alias("answered_at"))


def _span(period: float) -> float:
    """Slices of some periods each: their maps have about as many steps as one period has requests."""
    return max(4.0 * period, 1.0)
