"""Periods over a log: slices of any length against a plain fold; streams in event time against a replay."""

import random

import pytest
from pyspark.sql import functions as F

from vantaloom.operators import anchors, serving
from vantaloom.streaming import periods as streams


def folded(log):
    """Plain fold over each key: {event: (first, end, begin, count)}."""
    out, state = {}, {}
    for key, event, at, seconds in sorted(log, key=lambda r: (r[2], r[1])):
        end, begin, count = state.get(key, (float("-inf"), 0.0, 0))
        first = at >= end
        state[key] = (at + seconds, at, 1) if first else (end, begin, count + 1)
        out[event] = (first, *state[key])
    return out


def a_log(seed, n=300, spread=120.0):
    """A hot key, a cold one and a null one; ties, bursts, calls of no length and of very long ones."""
    rng = random.Random(seed)
    times = lambda k: [round(rng.random() * spread, rng.choice([0, 2])) for _ in range(k)]
    keys = ["hot"] * n + ["cold"] * 20 + [None] * 20
    return [(k, i, t, rng.choice([0.0, 0.5, 3.0, 7.25, 40.0])) for i, (k, t) in enumerate(zip(keys, times(n) + times(20) + times(20), strict=True))]


def test_maps_compose_to_the_map_of_the_whole():
    rng = random.Random(4)
    for _ in range(200):
        at = sorted(round(rng.random() * 30, 1) for _ in range(rng.randrange(1, 25)))
        seconds = [rng.choice([0.0, 1.0, 2.5, 9.0, 30.0]) for _ in at]
        cut = sorted({0, len(at), *(rng.randrange(len(at) + 1) for _ in range(3))})
        parts = [anchors.fold_slice(at[a:b], seconds[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
        whole = parts[0]
        for part in parts[1:]:
            whole = anchors.compose(whole, part)
        for end in [anchors.NEVER, *(x + d for x in at for d in (-0.05, 0.0, 0.05)), 100.0]:
            period = want = (end, -1.0, 5)
            for t, s in zip(at, seconds, strict=True):
                want = (t + s, t, 1) if t >= want[0] else (want[0], want[1], want[2] + 1)
            assert anchors.follow(period, *whole) == want
        assert len(whole[1]) <= len(at)


@pytest.mark.parametrize(("span", "fan"), [(1.0, 2), (3.0, 3), (7.5, 64), (1000.0, 64)])
def test_periods_against_a_fold(spark, span, fan):
    log = a_log(7)
    df = spark.createDataFrame([*log, ("hot", 9001, None, 1.0), ("hot", 9002, float("nan"), 1.0)], "k string, event_id long, t double, seconds double").withColumn("end", F.lit("clash"))
    got = {r["event"]: (r["first"], r["end"], r["begin"], r["count"]) for r in anchors.periods(df, "k", "t", F.col("seconds"), span, fan=fan).collect()}
    assert got == folded(log)
    assert anchors.periods(df.where("false"), "k", "t", F.col("seconds"), span).count() == 0


@pytest.mark.parametrize("span", [1.0, 3.0, 1000.0, None])
def test_replays_with_any_slices(spark, span):
    log = [(k or "none", i, t, s) for k, i, t, s in a_log(9)]
    df = spark.createDataFrame(log, "k string, event_id long, t double, seconds double")
    fixed = folded([(k, i, t, 10.0) for k, i, t, _ in log])
    assert {r["event_id"]: (r["hit"], r["written_at"]) for r in serving.cache_replay(df, "k", "t", 10, span).collect()} == {i: (not f, b) for i, (f, _, b, _) in fixed.items()}
    assert {r["event_id"]: (r["n_in_window"], r["allowed"]) for r in serving.rate_replay(df, "k", "t", 3, 10, span).collect()} == {i: (c, c <= 3) for i, (_, _, _, c) in fixed.items()}
    assert {r["event_id"]: (r["shared"], r["answered_at"]) for r in serving.single_flight(df, "k", "t", "seconds", span).collect()} == {i: (not f, e) for i, (f, e, _, _) in folded(log).items()}


def test_a_hot_key_is_dealt_over_tasks(spark):
    """One key at a steady pace without gaps: its requests are replayed in all partitions, none of which has half of them."""
    log = spark.range(40_000).select(F.lit("only").alias("k"), F.col("id").alias("event_id"), F.col("id").cast("double").alias("t"))
    got = anchors.periods(log, "k", "t", 60.0, 240.0).withColumn("task", F.spark_partition_id())
    sizes = [r["n"] for r in got.groupBy("task").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 40_000 and len(sizes) > 1 and max(sizes) < 20_000
    assert got.where("first <> (event % 60 = 0) or count <> event % 60 + 1 or begin <> event - event % 60").count() == 0


def _play(spark, tmp_path, name, make, batches):
    """The rows of a stream over files that come one micro-batch at a time; it is stopped and started again from its checkpoint half-way."""
    schema = "key string, event_id long, seconds double, ts timestamp"
    source, out = tmp_path / f"{name}-in", tmp_path / f"{name}-out"
    source.mkdir()
    for i, rows in enumerate(batches):
        rows = [(k, e, s, t) for k, e, t, s in rows]
        df = spark.createDataFrame(rows, "key string, event_id long, seconds double, t double")
        df.select("key", "event_id", "seconds", F.timestamp_micros(F.round(F.col("t") * 1e6).cast("long")).alias("ts")).coalesce(1).write.mode("append").parquet(str(source / f"b={i}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
        q = make(stream).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / f"{name}-state")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    return spark.read.parquet(str(out))


def test_streams_decide_as_replays_do(spark, tmp_path):
    """Late events over several micro-batches, each a restart from the checkpoint; the events of the verdict's case among them."""
    base = 1_000_000_000.0
    late = [[("a", 1, 0.0, 5.0), ("a", 2, 50.0, 5.0), ("b", 10, 3.0, 9.0)], [("a", 3, 10.0, 5.0), ("a", 4, 61.0, 20.0), ("b", 11, 1.0, 4.0)], [("a", 5, 62.5, 1.0), ("a", 6, 61.0, 1.0), ("b", 12, 200.0, 1.0)]]
    late = [[(k, i, base + t, s) for k, i, t, s in b] for b in late]
    flush = [[("z", 99, base + 5000, 1.0)]]  # moves the watermark past all the others
    events = [e for b in late for e in b]
    log = spark.createDataFrame(events, "key string, event_id long, at double, seconds double")
    makers = {
        "rates": (lambda s: streams.stream_rate_limit(s, "key", 2, 60, "5 minutes"), serving.rate_replay(log, "key", "at", 2, 60), ["event_id", "n_in_window", "allowed"]),
        "flights": (lambda s: streams.stream_single_flight(s, "key", "seconds", "5 minutes"), serving.single_flight(log, "key", "at", "seconds"), ["event_id", "shared", "answered_at"]),
        "caches": (lambda s: streams.stream_cache(s, "key", 60, "5 minutes"), serving.cache_replay(log, "key", "at", 60), ["event_id", "hit", "written_at"]),
    }
    for name, (make, batch, columns) in makers.items():
        got = _play(spark, tmp_path, name, make, late + flush)
        assert sorted(map(tuple, got.where("event_id < 99").select(*columns).collect())) == sorted(map(tuple, batch.select(*columns).collect()))


def test_state_goes_when_periods_have_ended(spark, tmp_path):
    base = 1_000_000_000.0
    rows = [[("a", 1, base, 5.0), ("b", 2, base, 5.0)], [("z", 3, base + 1000, 1.0)], [("z", 4, base + 2000, 1.0)], [("z", 5, base + 3000, 1.0)]]
    got = _play(spark, tmp_path, "gone", lambda s: streams.stream_periods(s, "key", F.col("seconds"), "10 seconds"), rows)
    assert {r["event_id"] for r in got.collect()} == {1, 2, 3, 4}
    kept = spark.read.format("statestore").option("stateVarName", "period").load(str(tmp_path / "gone-state"))
    assert {r["key"][0] for r in kept.select("key").collect()} <= {"z"}
