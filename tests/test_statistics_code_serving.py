"""Paired statistics against golden numbers, code facts, judging, agent and serving semantics."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vantaloom.operators import agent, code, judging, paired, serving
from vantaloom.streaming import serving as streams

# (group, natural rank, abstract rank) of 17 questions at depth 20; 21 stands for not found.
GOLDEN = [("A", 1, 21), ("A", 1, 21), ("A", 1, 21), ("A", 1, 18), ("A", 1, 21), ("A", 1, 1), ("A", 1, 6), ("A", 1, 1), ("B", 3, 9), ("B", 1, 1), ("B", 1, 21), ("B", 21, 21), ("B", 1, 21), ("B", 10, 2), ("B", 4, 13), ("B", 9, 21), ("B", 1, 4)]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(i, *g) for i, g in enumerate(GOLDEN)], "id int, grp string, natural_rank int, abstract_rank int")


def test_paired_table(pairs):
    got = {(r["arm_group"], r["k"]): r for r in paired.paired_table(pairs).collect()}
    assert len(got) == 12
    for key, want in {("A", 1): (6, 0, 0.03125), ("B", 3): (4, 1, 0.375), ("total", 3): (10, 1, 0.01171875), ("total", 10): (9, 0, 0.00390625), ("B", 1): (3, 0, 0.25)}.items():
        r = got[key]
        assert (r["b"], r["c"], r["mcnemar_p"]) == (want[0], want[1], pytest.approx(want[2], abs=1e-8))


def test_recall_intervals(pairs):
    got = {(r["arm_group"], r["k"]): (r["ci_low"], r["ci_high"]) for r in paired.recall_intervals(pairs).collect()}
    for key, want in {("A", 1): (0.375, 1.0), ("A", 10): (0.25, 0.875), ("B", 1): (0.0, 0.666667), ("B", 3): (-0.111111, 0.777778), ("B", 10): (0.111111, 0.777778), ("total", 1): (0.294118, 0.764706), ("total", 3): (0.235294, 0.823529)}.items():
        assert got[key] == pytest.approx(want, abs=1e-6)


def test_mrr_pairs(pairs):
    got = {r["arm_group"]: r for r in paired.mrr_pairs(pairs).collect()}
    for group, delta, low, high, p, median in (("A", 0.722222, 0.375, 0.979167, 0.03125, -18.5), ("B", 0.317379, 0.028549, 0.622222, 0.109375, -7.5), ("total", 0.507893, 0.273947, 0.735671, 0.0033706238791354, -10.5)):
        r = got[group]
        assert (r["delta"], r["ci_low"], r["ci_high"], r["wilcoxon_p"], r["median_rank_difference"]) == pytest.approx((delta, low, high, p, median), abs=1e-6)


def test_wilcoxon_without_differences():
    assert math.isnan(paired.wilcoxon_p([0.0, 0.0]))


@pytest.mark.parametrize(("b", "c", "p"), [(9, 0, 0.00390625), (5, 0, 0.0625), (4, 0, 0.125), (10, 1, 0.01171875), (0, 0, 1.0)])
def test_mcnemar(spark, b, c, p):
    assert spark.range(1).select(paired.mcnemar_p(F.lit(b), F.lit(c))).first()[0] == pytest.approx(p, abs=1e-8)


def test_power(spark):
    got = {r["b"]: r["significant"] for r in paired.power_table(10, spark).collect()}
    assert [b for b, s in got.items() if s] == [6, 7, 8, 9, 10]


SOURCE = '''"""Top."""
import os
LIMIT = 3
if LIMIT:
    def hidden():
        pass

@wrap(
    1)
class Outer:
    """Doc."""
    x: int = 1
    def go(self):
        CONST = 2
        class Deep:
            y = 2
        return CONST
    async def wait(self): ...
'''


def test_symbol_chunks():
    got = code.SourceChunker("a.py", SOURCE).run()
    names = [(s.kind, s.qualname) for s in got]
    assert names == [("module", ""), ("constant", "LIMIT"), ("class", "Outer"), ("method", "Outer.go"), ("constant", "CONST"), ("class", "Outer.go.Deep"), ("method", "Outer.wait")]
    outer = got[2].text.split("\n")
    assert outer[0] == "[source a.py:8-18 | class Outer]"
    assert outer[1:3] == ["@wrap(", "1)"]
    assert outer[3:] == ["Doc.", code.FIELDS_MARK, "    x: int = 1", code.METHODS_MARK, "    def go(self):", "    async def wait(self): ..."]
    assert code.SourceChunker("b.py", "def (").run()[0].text.startswith("[source b.py:1 | whole-file (parse failed)]")


@pytest.mark.parametrize("text", ["# sqrt(limit=3)", "def broken(", "", None])
def test_nothing_holds_for_comments_and_broken_code(text):
    facts = [{"desc": "d", "checks": [{"kind": "name", "name": "floor", "not": True}]}]
    assert code.check_facts(text, facts) == [("d", False)]


@pytest.mark.parametrize(
    ("check", "want"),
    [
        ({"kind": "import", "module": "m", "names": ["a"]}, True), ({"kind": "import", "module": "n", "names": ["a"]}, False), ({"kind": "imports", "names": ["os"]}, True), ({"kind": "call", "name": "run"}, True),
        ({"kind": "kwarg", "name": "size", "value": 16}, True), ({"kind": "kwarg", "name": "size", "value": 17}, False), ({"kind": "dict_entry", "key": "k", "value": "v"}, True), ({"kind": "pair", "key": "k"}, True),
        ({"kind": "func", "name": "f", "args": ["x", "rest", "z"]}, True), ({"kind": "func", "name": "f", "args": ["q"]}, False), ({"kind": "class", "name": "C", "decorator": "dec"}, True), ({"kind": "field", "class": "C", "names": ["a", "b"]}, True),
        ({"kind": "assign", "target": "y", "method": "f"}, True), ({"kind": "assign", "target": "a", "method": "f"}, False), ({"kind": "name", "name": "only_in_text"}, False), ({"kind": "compare", "left": "x", "right": "z"}, True),
        ({"kind": "pow2_buggy"}, True), ({"kind": "call", "name": "nope", "not": True}, True),
    ],
)
def test_check_kinds(check, want):
    source = 'import os\nfrom m import a\nN = 16\n@dec(1)\nclass C:\n    a: int\n    b = 2\ndef f(x, *rest, z=1):\n    self.y = {"k": "v"}\n    obj.run(size=N)\n    return x < z or 1 << n.bit_length()\n"only_in_text"\n'
    assert code.check_facts(source, [{"desc": "d", "checks": [check]}]) == [("d", want)]


def test_unknown_kind_raises():
    with pytest.raises(ValueError, match="unknown kind"):
        code.check_facts("x = 1", [{"desc": "d", "checks": [{"kind": "other"}]}])


@pytest.mark.parametrize(("source", "check", "ok", "passed", "late"), [("print(1)", None, True, False, False), ("import sys; sys.exit(7)", None, False, False, False), ("while True: pass", None, False, False, True), ("x = 2", "assert x == 2", True, True, False), ("x = 2", "assert x == 3", False, False, False)])
def test_run_source(source, check, ok, passed, late):
    got = code.run_source(source, check, timeout=3)
    assert (got["ok"], got["check_ok"], got["timed_out"]) == (ok, passed, late)


def test_generation_summary(spark):
    df = spark.createDataFrame([(True, 2, 2, True, True, False, False), (True, 1, 2, True, False, False, True), (False, 0, 2, True, False, True, False), (True, 2, 2, False, False, False, False)], "parses boolean, facts_hit int, facts_all int, runnable boolean, run_ok boolean, timed_out boolean, fixed boolean")
    r = code.generation_summary(df).first()
    assert (r["n_tasks"], r["parsed"], r["facts_hit"], r["facts_all"], r["n_runnable"], r["timeouts"], r["fix_rate"]) == (4, 3, 5, 8, 3, 1, 1.0)
    assert r["pass_at_1"] == pytest.approx(1 / 3, abs=1e-6)


def test_faithfulness(spark):
    df = spark.createDataFrame([(1, [], []), (2, ["a"], []), (3, ["a", " b ", "c", "a"], [True, True, False])], "id int, claims array<string>, supported array<boolean>")
    got = {r["id"]: r for r in judging.faithfulness(df).collect()}
    assert [got[i]["faithfulness"] for i in (1, 2, 3)] == [1.0, 0.0, 0.666667]
    assert [got[i]["mismatch"] for i in (1, 2, 3)] == [False, True, False]


def test_synthesis_asks_once_and_survives_failure(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, text string")
    found, fresh = judging.synthesize(df, None, lambda texts: ["d:" + t for t in texts])
    assert {r["id"]: r["description"] for r in found.collect()} == {1: "d:x", 2: "d:x", 3: "d:y"}
    assert fresh.count() == 2

    def fails(texts):
        raise OSError

    found, fresh = judging.synthesize(df, None, fails)
    assert {r["description"] for r in found.collect()} == {""} and fresh.count() == 0


def test_judge_reads_json_only():
    assert judging.Judge(lambda s, u: "no").decompose("a") == []
    assert judging.Judge(lambda s, u: '{"claims": ["a"]}').decompose("a") == ["a"]


@pytest.mark.parametrize(("q", "write", "run", "want"), [("Write a function f", True, True, "write_code"), ("Write a function f", False, True, "search"), ("run this script", True, True, "run_python"), ("run this script", True, False, "search"), ("write\nsome code", True, True, "search"), ("what is a class", True, True, "search"), ("compute it in python", False, True, "run_python")])
def test_route(spark, q, write, run, want):
    assert spark.range(1).select(agent.route(F.lit(q), F.lit(write), F.lit(run))).first()[0] == want


def test_agent_loop():
    replies = iter([agent.Reply(calls=[("c1", "search", '{"query": "q"}'), ("c2", "search", "{bad")], usage={"prompt": 3}), agent.Reply("done")])
    bot = agent.Agent(lambda messages, names: next(replies), {"search": lambda query: "found " + query})
    answer, contexts, trace = bot.run("q")
    assert answer == "done" and contexts[:2] == ["found q", "found q"] and "not JSON" in contexts[2]
    assert trace["steps"][0]["prompt"] == 3 and trace["steps"][1]["completion"] == 0
    with pytest.raises(ValueError, match="unknown tool"):
        bot.execute("other", "{}")
    endless = agent.Agent(lambda m, n: agent.Reply(calls=[("c", "search", '{"query": "q"}')]), {"search": lambda query: "x"})
    assert endless.run("q", 2)[0] == agent.NO_ANSWER


def test_workspace(tmp_path):
    w = agent.Workspace(str(tmp_path))
    w.write("a/b.txt", "x y x")
    assert w.edit("a/b.txt", "x", "z") == "replaced 1 in a/b.txt, 1 more remain" and w.read("a/b.txt") == "z y x"
    for bad in (lambda: w.read("../up"), lambda: w.edit("a/b.txt", "", "q"), lambda: w.edit("a/b.txt", "none", "q")):
        with pytest.raises(ValueError):
            bad()


def log(spark, times, key="k"):
    return spark.createDataFrame([(key, float(t), i) for i, t in enumerate(times)], "key string, at double, event_id long")


def test_rate_limit_window_starts_at_the_first_request(spark):
    got = serving.rate_replay(log(spark, [0, 10, 59, 60]), "key", "at", 2, 60).orderBy("at").collect()
    assert [r["allowed"] for r in got] == [True, True, False, True]


def test_cache_hits_do_not_renew(spark):
    got = serving.cache_replay(log(spark, [0, 599, 601, 1200]), "key", "at", 600).orderBy("at").collect()
    assert [r["hit"] for r in got] == [False, True, False, True]


def test_single_flight(spark):
    df = log(spark, [0, 1, 5, 6]).withColumn("duration", F.lit(3.0))
    got = serving.single_flight(df, "key", "at", "duration").orderBy("at").collect()
    assert [r["shared"] for r in got] == [False, True, False, True]


def test_validation(spark):
    df = spark.createDataFrame([("a", "b"), ("", "b"), (None, None), ("é" * 1001, None)], "query string, question string")
    got = df.select(serving.validate(F.col("query"), F.col("question")).alias("v")).select("v.*").collect()
    assert [r["status"] for r in got] == [200, 200, 400, 400] and got[1]["query"] == "b"


def test_streams_agree_with_replays(spark, tmp_path):
    """A replayed stream gives the decisions of the batch operators."""
    rows = [("a", 1e9 + t, i) for i, t in enumerate([0, 10, 59, 60, 700])] + [("b", 1e9 + t, 100 + i) for i, t in enumerate([5, 6, 7])]
    events = spark.createDataFrame(rows, "key string, at double, event_id long")
    events = events.withColumn("ts", F.timestamp_micros((F.col("at") * 1e6).cast("long")))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, stream, batch, column in (
        ("rates", streams.stream_rate_limit(source, "key", 2, 60), serving.rate_replay(events, "key", "at", 2, 60), "allowed"),
        ("caches", streams.stream_cache(source, "key", 600), serving.cache_replay(events, "key", "at", 600), "hit"),
    ):
        q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        got = {r["event_id"]: r[column] for r in spark.table(name).collect()}
        assert got == {r["event_id"]: r[column] for r in batch.collect()}


@pytest.mark.parametrize("span", [3.0, 1000.0])
def test_runs_begin_at_gaps_across_slices(spark, span):
    rng = random.Random(11)
    log = [(k, i, round(rng.random() * 60, 2)) for i, k in enumerate(rng.choices(["a", "a", "b"], k=80))]
    got = {r["event_id"]: r["run"] for r in serving.runs_by_gap(spark.createDataFrame(log, "k string, event_id long, at double"), "k", "at", 2.0, span).collect()}
    for key in "ab":
        begin = last = None
        for at, i in sorted((at, i) for k, i, at in log if k == key):
            begin = at if last is None or at - last >= 2.0 else begin
            assert got[i] == begin
            last = at
