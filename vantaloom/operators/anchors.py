"""Chains of periods over a log, so that a hot key is folded by all cores.

A request opens a period that lasts so many seconds; later requests of its key fall into it
until it ends, and the first one at or after its end opens the next: so do cache entries,
rate windows and calls in flight. Each decision rests on the one before, but only through
the end of the open period. So the log is cut into slices of time, and a slice is folded for all
entering ends at once: the first request at or after the end opens the slice's first
period, so a slice is a map with steps at its requests from the entering period to the
leaving one, and steps that leave in the same period are one. Maps of ``FAN`` slices in a row are composed into
one, level by level, until one is left of a key; back down the levels, every slice gets
the period it is entered with; then all slices are replayed at once.

A task holds one slice's requests, or one map and what is composed so far. A map has at most as
many steps as its slices have requests, and about as many as one period has where
the slices are longer than periods.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantaloom.sources.runtime import ship_package, stage

FAN, ROWS = 64, 2_000
NEVER = float("-inf")
# A period is known by its end, its beginning, and how many requests it had up to where it is looked at.
_MAP = "requests long, steps array<double>, ends array<double>, begins array<double>, counts array<long>"
_PERIOD = "end double, begin double, count long"


def _chain(at: list[float], end: list[float]) -> list[int]:
    """For each request the one that opens the next period, should it open one itself; their number if none does."""
    return [bisect_left(at, e, i + 1) for i, e in enumerate(end)]


def fold_slice(at: list[float], seconds: list[float]) -> tuple:
    """A slice's map: its requests, the steps, and the period that is left with if the entering one ends at or before a step."""
    n = len(at)
    end = [t + s for t, s in zip(at, seconds, strict=True)]
    leaves: list[tuple[float, float, int]] = [(0.0, 0.0, 0)] * n
    for i, j in reversed(list(enumerate(_chain(at, end)))):
        leaves[i] = leaves[j] if j < n else (end[i], at[i], n - i)
    return n, *_joined(at, leaves)


def _joined(steps: list[float], leaves: list[tuple]) -> tuple[list, list, list, list]:
    """Neighbours that leave in the same period become one step, the later."""
    kept = [i for i in range(len(steps)) if i + 1 == len(steps) or leaves[i] != leaves[i + 1]]
    return [steps[i] for i in kept], *([leaves[i][c] for i in kept] for c in range(3))


def follow(period: tuple[float, float, int], requests: int, steps: list, ends: list, begins: list, counts: list) -> tuple[float, float, int]:
    """The period that a map is left with."""
    i = bisect_left(steps, period[0])
    return (ends[i], begins[i], counts[i]) if i < len(steps) else (period[0], period[1], period[2] + requests)


def compose(first: tuple, then: tuple) -> tuple:
    """The map of two maps in a row."""
    steps, leaves = list(first[1]), [follow(p, *then) for p in zip(*first[2:], strict=True)]
    # Periods that outlast the first map's requests meet the second as they are.
    late = bisect_left(then[1], steps[-1]) if steps else 0
    while late < len(then[1]) and steps and then[1][late] <= steps[-1]:
        late += 1
    steps += then[1][late:]
    leaves += list(zip(*(c[late:] for c in then[2:]), strict=True))
    return first[0] + then[0], *_joined(steps, leaves)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _grouped(df: DataFrame, keys: list[str], order: list[str], make: Callable[[Iterator[tuple]], Iterator[tuple]], lead: list[str], out: str) -> DataFrame:
    """``make(rows)`` over each group's rows in order, without holding a group; its rows are the ``lead`` columns, then those of ``out``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship_package(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([df.schema[c] for c in lead] + T.StructType.fromDDL(out).fields)
    layout, width = to_arrow_schema(schema), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (row for _, own in groupby(_rows(batches), key=lambda r: r[:width]) for row in make(own))
        while some := list(islice(found, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), layout.types, strict=True)], names=layout.names)

    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _maps(rows: Iterator[tuple]) -> Iterator[tuple]:
    own = list(rows)
    yield *own[0][:2], *fold_slice([r[2] for r in own], [r[4] for r in own])


def _composed(rows: Iterator[tuple]) -> Iterator[tuple]:
    whole = None
    for row in rows:
        key, own = row[:2], row[3:8]
        whole = own if whole is None else compose(whole, own)
    yield *key, *whole


def _entered(rows: Iterator[tuple]) -> Iterator[tuple]:
    period = None
    for row in rows:
        period = row[8:11] if period is None else period
        yield row[0], row[2], *period
        period = follow(period, *row[3:8])


def _replayed(rows: Iterator[tuple]) -> Iterator[tuple]:
    period = None
    for key, _, at, event, seconds, *entering in rows:
        end, begin, count = entering if period is None else period
        first = at >= end
        period = (at + seconds, at, 1) if first else (end, begin, count + 1)
        yield key, event, at, first, *period


def periods(log: DataFrame, key: str, at: str, seconds: Column | float, span: float, event: str = "event_id", fan: int = FAN) -> DataFrame:
    """(key, event, at, first, end, begin, count) of every request: whether it opens a period, that period's end and begin, and its place in it.

    ``span`` is a slice's length in seconds; any gives the same result. Requests at the same time are in the order of
    their event ids. Requests without a time are left out; a null or undefined length counts as 0. A null key is a key.
    """
    length = F.coalesce(F.nanvl((seconds if isinstance(seconds, Column) else F.lit(seconds)).cast("double"), F.lit(0.0)), F.lit(0.0))
    time = F.col(at).cast("double")
    own = log.where(time.isNotNull() & ~F.isnan(time)).select(F.col(key).alias("key"), F.floor(time / span).alias("slice"), time.alias("at"), F.col(event).alias("event"), length.alias("seconds"))
    level = stage(_grouped(own, ["key", "slice"], ["at", "event"], _maps, ["key", "slice"], _MAP), "slices")
    low, high = level.agg(F.coalesce(F.min("slice"), F.lit(0)), F.coalesce(F.max("slice"), F.lit(0))).first()
    # Slices are numbered from the first one of all keys on, so that the levels come to an end at 0.
    numbered = lambda df: df.withColumn("slice", F.col("slice") - F.lit(low))
    maps = [numbered(level)]
    under = lambda df: df.select("key", F.floor(F.col("slice") / fan).alias("parent"), "slice", *[c.split()[0] for c in _MAP.split(", ")])
    while (high - low) // fan ** len(maps) > 0:
        up = _grouped(under(maps[-1]), ["key", "parent"], ["slice"], _composed, ["key", "parent"], _MAP)
        maps.append(stage(up.withColumnRenamed("parent", "slice"), "slices"))
    entering = None
    for level in reversed(maps):
        if entering is None:
            rows = under(level).select("*", F.lit(NEVER).alias("end"), F.lit(0.0).alias("begin"), F.lit(0).cast("long").alias("count"))
        else:
            rows = _with_entering(under(level), "parent", entering)
        entering = stage(_grouped(rows, ["key", "parent"], ["slice"], _entered, ["key", "slice"], _PERIOD), "entering")
    rows = _with_entering(numbered(own), "slice", entering)
    kind = log.schema[event].dataType.simpleString()
    return _grouped(rows, ["key", "slice"], ["at", "event"], _replayed, ["key"], f"event {kind}, at double, first boolean, {_PERIOD}")


def _with_entering(rows: DataFrame, place: str, entering: DataFrame) -> DataFrame:
    """Each slice's rows with the period it is entered with; keys may be null."""
    e = entering.select(F.col("key").alias("__key"), F.col("slice").alias("__slice"), "end", "begin", "count")
    return rows.join(e, F.col("key").eqNullSafe(F.col("__key")) & (F.col(place) == F.col("__slice"))).drop("__key", "__slice")
