"""Cache and rate limit that decide at once: keyed state with expiry in event time.

A decision is made in the micro-batch in which its event comes, whose rows are folded in time order.
Events that come after later ones of an earlier micro-batch are judged in the order of arrival, so
they may be judged otherwise than by a replay of the log; ``streaming.periods`` waits for the watermark
and decides as a replay does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vantaloom.operators.serving import CACHE_TTL, RATE_LIMIT, RATE_WINDOW, cache_step, rate_step


def _stateful(events: DataFrame, key: str, late: str, keep: float, step: Callable, state: str, out: str, names: list[str], from_state: Callable, to_state: Callable) -> DataFrame:
    """``events``: key, ts (timestamp), event_id. A key's state goes ``keep`` seconds of event time after its last event."""

    def update(group: tuple, frames: Iterator[pd.DataFrame], own: GroupState) -> Iterator[pd.DataFrame]:
        if own.hasTimedOut:
            own.remove()
            return
        now = from_state(own.get) if own.exists else None
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"], kind="stable")
        found = []
        for at, event_id in zip(rows["at"], rows["event_id"], strict=True):
            now, values = step(now, (float(at),))
            found.append((group[0], float(at), int(event_id), *values))
        own.update(to_state(now))
        own.setTimeoutTimestamp(max(own.getCurrentWatermarkMs(), int(found[-1][1] * 1000)) + max(1, int(keep * 1000)))
        yield pd.DataFrame(found, columns=names)

    timed = events.withWatermark("ts", late).withColumn("at", F.unix_micros("ts") / 1e6)
    return timed.groupBy(key).applyInPandasWithState(update, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def stream_rate_limit(events: DataFrame, key: str, limit: int = RATE_LIMIT, window: float = RATE_WINDOW, late: str = "10 minutes") -> DataFrame:
    """Each event with its counter's value and the decision."""
    kind = events.schema[key].dataType.simpleString()
    out = f"`{key}` {kind}, at double, event_id long, n_in_window long, allowed boolean"
    return _stateful(events, key, late, window, rate_step(limit, window), "start double, n long", out, [key, "at", "event_id", "n_in_window", "allowed"], tuple, lambda s: (float(s[0]), int(s[1])))


def stream_cache(events: DataFrame, key: str, ttl: float = CACHE_TTL, late: str = "10 minutes") -> DataFrame:
    """Each event with whether the cache answers it, and when its entry was written."""
    kind = events.schema[key].dataType.simpleString()
    out = f"`{key}` {kind}, at double, event_id long, hit boolean, written_at double"
    return _stateful(events, key, late, ttl, cache_step(ttl), "written double", out, [key, "at", "event_id", "hit", "written_at"], lambda s: s[0], lambda s: (float(s),))
