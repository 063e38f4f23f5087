"""Cache, rate limit and single flight over a stream, in event time: what a replay of the log decides.

Events wait in state until the watermark has passed them, as events before them may still
come; then a timer of their key folds them in time order. A key's state is the events
that wait and the period that is open; a timer at that period's end drops it.
So the decisions equal those of ``operators.anchors`` over the same events, in whatever order and in
whatever micro-batches they come within the watermark, and also after a restart
from the checkpoint. Events behind the watermark are dropped, as streams do, and events without a time never come due. A decision is
late by the watermark's delay; ``streaming.serving`` decides at once, in the order of arrival.

The state lives in RocksDB, so it may outgrow the executors' memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vantaloom.operators.serving import CACHE_TTL, RATE_LIMIT, RATE_WINDOW
from vantaloom.sources.runtime import ship_package

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NAMES = ["event_id", "at", "first", "end", "begin", "count"]
_OUT = "event_id long, at double, first boolean, end double, begin double, count long"


class Periods(StatefulProcessor):
    """One key: ``waiting`` events by time, and the open ``period``."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at double, event_id long, seconds double, nth long", "n int")
        self.period = handle.getValueState("period", "end double, begin double, count long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = set()
        for frame in rows:
            for at, event_id, seconds in zip(frame["at"], frame["event_id"], frame["seconds"], strict=True):
                nth = 0  # events that repeat wait side by side
                while self.waiting.containsKey((at, event_id, seconds, nth)):
                    nth += 1
                self.waiting.updateValue((at, event_id, seconds, nth), (1,))
                due.add(_ms(at))
        # Timers that are set already are set again; the earliest is set anew whenever one has been handled.
        for ms in due:
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        ripe = sorted(k for k in self.waiting.keys() if _ms(k[0]) <= passed)
        end, begin, count = self.period.get() if self.period.exists() else (-math.inf, 0.0, 0)
        found = []
        for event in ripe:
            at, event_id, seconds, _ = event
            first = at >= end
            end, begin, count = (at + seconds, at, 1) if first else (end, begin, count + 1)
            found.append((key[0], event_id, at, first, end, begin, count))
            self.waiting.removeKey(event)
        if found:
            self.period.update((float(end), float(begin), int(count)))
            self.handle.registerTimer(max(_ms(end), passed + 1))
        elif self.period.exists() and _ms(end) <= passed and not any(True for _ in self.waiting.keys()):
            self.period.clear()
        # Plain objects: columns of pandas' own string type do not become Arrow arrays in one piece.
        columns = zip([self.key, *_NAMES], zip(*found, strict=True), strict=True) if found else ()
        return iter([pd.DataFrame({n: pd.Series(c, dtype=object) if n == self.key else c for n, c in columns})] if found else [])

    def close(self) -> None:
        pass


def _ms(at: float) -> int:
    """The first millisecond at which the watermark has passed a time."""
    return math.ceil(at * 1000)


def stream_periods(events: DataFrame, key: str, seconds: Column | float, late: str = "10 minutes") -> DataFrame:
    """Each event of ``events`` (key, ts, event_id) once the watermark has passed it: whether it opens a period, that period's end and begin, and its place in it.

    Sets the session's state store to RocksDB, which timers and states of this kind need.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    ship_package(spark)
    length = F.coalesce(F.nanvl((seconds if isinstance(seconds, Column) else F.lit(seconds)).cast("double"), F.lit(0.0)), F.lit(0.0))
    timed = events.where("ts is not null").withWatermark("ts", late)
    own = timed.select(F.col(key), "ts", F.col("event_id").cast("long").alias("event_id"), (F.unix_micros("ts") / 1e6).alias("at"), length.alias("seconds"))
    kind = events.schema[key].dataType.simpleString()
    return own.groupBy(key).transformWithStateInPandas(Periods(key), f"`{key}` {kind}, {_OUT}", "Append", "EventTime")


def stream_cache(events: DataFrame, key: str, ttl: float = CACHE_TTL, late: str = "10 minutes") -> DataFrame:
    """Each event with whether the cache answers it, and when its entry was written."""
    return stream_periods(events, key, float(ttl), late).select(key, "event_id", "at", (~F.col("first")).alias("hit"), F.col("begin").alias("written_at"))


def stream_rate_limit(events: DataFrame, key: str, limit: int = RATE_LIMIT, window: float = RATE_WINDOW, late: str = "10 minutes") -> DataFrame:
    """Each event with its counter's value and the decision."""
    return stream_periods(events, key, float(window), late).select(key, "event_id", "at", F.col("count").alias("n_in_window"), (F.col("count") <= limit).alias("allowed"))


def stream_single_flight(events: DataFrame, key: str, duration: str, late: str = "10 minutes") -> DataFrame:
    """Each event with whether it shares a call in flight, and when that call ends, which is when its waiters have their answer."""
    return stream_periods(events, key, F.col(duration), late).select(key, "event_id", "at", (~F.col("first")).alias("shared"), F.col("end").alias("answered_at"))
