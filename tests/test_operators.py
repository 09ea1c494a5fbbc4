from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.functions import forecast, text
from millrace.operators import aggregates as A
from millrace.operators import filters as P
from millrace.operators import graph as G
from millrace.operators import joins as J
from millrace.operators import windows as W
from millrace.sources import sinks


def at(s):
    return datetime(2024, 1, 1) + timedelta(seconds=s)


def test_state_groups_and_optional_filters(spark):
    df = spark.createDataFrame([("RUNNING", 1), ("FAILED", 1), ("PAUSED", 2)], "state string, n int")
    assert df.where(P.state_group("state", "active")).count() == 2
    assert df.where(P.state_group("state", "terminal")).count() == 1
    assert df.where(P.optional(n=1, state=None)).count() == 2
    assert df.where(P.one_of("state", [])).count() == 3
    with pytest.raises(ValueError):
        P.state_group("state", "some")


def test_attributes_compare_by_type(spark):
    df = spark.createDataFrame([('{"a": 5}',), ('{"a": "5"}',), ('{"b": 1}',), ("not json",), (None,)], "j string")
    count = lambda c: df.where(c).count()
    assert count(P.attribute("j", "a", "gte", 5)) == 1
    assert count(P.attribute("j", "a", "eq", "5")) == 1
    assert count(P.attribute("j", "a", "ne", 4)) == 1
    assert count(P.attribute("j", "a", "exists")) == 2
    assert count(P.contains_attributes("j", {"a": 5})) == 1
    with pytest.raises(ValueError):
        P.attribute("j", "a", "like", 1)


def test_guarded_int(spark):
    df = spark.createDataFrame([("7",), ("007",), ("4294967296",), ("x7",), ("",), (None,), ("9" * 30,)], "v string")
    assert [r[0] for r in df.select(P.guarded_int(F.col("v"))).collect()] == [7, 7, None, None, None, None, None]


def test_asof_takes_equal_times_and_ties(spark):
    left = spark.createDataFrame([(1, "a", at(10)), (2, "a", at(5)), (3, "b", at(9))], "id int, k string, ts timestamp")
    right = spark.createDataFrame([("a", at(5)), ("a", at(10)), ("a", at(11))], "k string, r timestamp")
    got = {r.id: r.last for r in J.asof_last(left, right, ["k"], "ts", "r", "last").collect()}
    assert got == {1: at(10), 2: at(5), 3: None}


def test_top_n_other_adds_up(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 5), ("c", 1), ("d", 2)], "k string, n long")
    assert {tuple(r) for r in A.top_n_other(counts, "k", 2).collect()} == {("a", 5), ("b", 5), ("_other", 3)}


def test_saturating_sum(spark):
    df = spark.createDataFrame([(2**62,), (2**62,), (2**62,)], "v long")
    assert df.agg(A.saturating_sum(F.col("v"))).first()[0] == 2**63 - 1
    assert df.limit(0).agg(A.saturating_sum(F.col("v"))).first()[0] == 0


def test_peak_of_a_diamond(spark):
    # a 2 s, then b 10 s and c 3 s, then d 1 s: two at once from the second second on.
    df = spark.createDataFrame([("g", 0, 2), ("g", 2, 12), ("g", 2, 5), ("g", 12, 13)], "g string, s int, e int")
    assert tuple(W.peak(df, ["g"], "s", "e").first()) == ("g", 2, 2)


def test_slack_of_a_diamond(spark):
    tasks = spark.createDataFrame([("g", t, d) for t, d in (("a", 2), ("b", 10), ("c", 3), ("d", 1))], "dag string, task string, duration long")
    edges = spark.createDataFrame([("g", "b", "a"), ("g", "c", "a"), ("g", "d", "b"), ("g", "d", "c")], "dag string, task string, upstream string")
    got = {r.task: (r.early_start, r.slack, r.makespan) for r in G.slack(tasks, edges).collect()}
    assert got == {"a": (0, 0, 13), "b": (2, 0, 13), "c": (2, 7, 13), "d": (12, 0, 13)}


def test_slack_of_a_long_chain_and_of_a_cycle(spark):
    tasks = spark.createDataFrame([("g", i, 1) for i in range(30)] + [("h", 0, 5)], "dag string, task int, duration long")
    edges = spark.createDataFrame([("g", i, i - 1) for i in range(1, 30)], "dag string, task int, upstream int")
    got = G.slack(tasks, edges).collect()
    assert {(r.dag, r.task, r.early_start, r.slack, r.makespan) for r in got} == {("g", i, i, 0, 30) for i in range(30)} | {("h", 0, 0, 0, 5)}
    cycle = edges.union(spark.createDataFrame([("g", 0, 29)], edges.schema))
    with pytest.raises(ValueError):
        G.slack(tasks, cycle)


def test_profile_of_a_schedule(spark):
    tasks = spark.createDataFrame([("g", t, d) for t, d in (("a", 2), ("b", 10), ("c", 3), ("d", 1))], "dag string, task string, duration long")
    edges = spark.createDataFrame([("g", "b", "a"), ("g", "c", "a"), ("g", "d", "b"), ("g", "d", "c")], "dag string, task string, upstream string")
    plan = G.slack(tasks, edges)
    assert tuple(W.peak(plan, ["dag"], "early_start", "early_finish").first()) == ("g", 2, 2)
    assert tuple(W.peak(plan, ["dag"], "late_start", "late_finish").first()) == ("g", 2, 9)


def test_numbers_and_ranks_over_ranges(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(None).cast("string")).otherwise("k").alias("k"), (F.col("id") * 7919 % 5000).alias("v"))
    got = {(r.k, r.v): r.no for r in W.numbered(df, ["k"], ["v"], "no").collect()}
    for k in (None, "k"):
        assert [n for _, n in sorted((v, n) for (x, v), n in got.items() if x == k)] == list(range(1, sum(x == k for x, _ in got) + 1))
    ranks = {r.k: (r.half, r.n) for r in A.nearest_ranks(df, "k", "v", {"half": 0.5}).collect()}
    for k in (None, "k"):
        own = sorted(v for x, v in got if x == k)
        assert ranks[k] == (own[-(-len(own) // 2) - 1], len(own))


def test_keys_with_dots(spark):
    df = spark.createDataFrame([('{"a.b": 5, "a": {"b": 7}}',)], "j string")
    assert df.where(P.attribute("j", "a.b", "eq", 5)).count() == 1 and df.where(P.attribute("j", "a.b", "exists")).count() == 1
    with pytest.raises(ValueError):
        P.attribute("j", "it's", "eq", 1)


def test_first_difference(spark):
    row = lambda a, b: spark.range(1).select(A.first_difference(F.lit(a), F.lit(b))).first()[0]
    assert row(["x", "x"], ["x", "y"]) == 1
    assert row(["x"], ["x", "y"]) == 1
    assert row(["x", "y"], ["x", "y"]) is None


def test_run_tree_has_no_row_limit(spark):
    runs = spark.range(2, 300).selectExpr("id", "id div 2 as parent")
    spark.conf.set("spark.sql.cteRecursionRowLimit", 100)
    try:
        got = J.run_tree(runs, spark.createDataFrame([(1,)], "id long"), "id", "parent", 12).collect()
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert sorted(map(tuple, got)) == [(1, i, i.bit_length() - 1) for i in range(1, 300)]


def test_run_tree_ends_on_cycles(spark):
    runs = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "id long, parent long")
    assert J.run_tree(runs, spark.createDataFrame([(1,)], "id long"), "id", "parent", 5).count() == 6


def test_coverage_gap(spark):
    demand = spark.createDataFrame([("q1",), ("q2",), ("q3",), ("q3",)], "q string")
    polls = spark.createDataFrame([(["q1"],)], "queues array<string>")
    paused = spark.createDataFrame([("q2",)], "q string")
    assert [r.q for r in J.coverage_gap(demand, polls, "queues", "q", paused).collect()] == ["q3"]


def test_signature_and_keys(spark):
    df = spark.createDataFrame([("db timeout after 30000ms connecting\n  at x:12",)], "e string")
    assert df.select(text.failure_signature(F.col("e"))).first()[0] == "db timeout after <NUM>ms connecting"
    a, b = (spark.range(1).select(text.idempotency_key(F.lit(x), F.lit(y))).first()[0] for x, y in (("a|1:b", "c"), ("a", "b|1:c")))
    assert a != b


def test_retry_forms(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(forecast.retry_delay(F.lit(n), 1.0, 2.0, 5.0)) for n in (1, 2, 3, 4)] == [1.0, 2.0, 4.0, 5.0]
    assert one(forecast.reachable_attempts(5, 1.0, 1.0, 1.0, F.lit(0.0), F.lit(2.5))) == 3
    assert one(forecast.bucket_level(F.lit(3.0), F.lit(10), F.lit(0.5), F.lit(6.0))) == 6.0


def test_sinks(spark, tmp_path):
    spans = spark.createDataFrame([("a", 1, 5, 9)], "n string, t int, s long, e long")
    assert '"dur":4' in sinks.chrome_trace(spans, "n", "t", "s", "e").first()[0]
    edges = spark.createDataFrame([("g", "b", "a")], "g string, t string, u string")
    assert sinks.mermaid(edges, "g", "t", "u").first()["text"] == "graph TD\n  a --> b"
    assert sinks.dot(edges, "g", "t", "u").first()["text"] == 'digraph {\n  "a" -> "b";\n}'
    tasks = spark.createDataFrame([("g", "b", 2, 3), ("g", "a", 0, 2)], "g string, t string, s int, d int")
    assert sinks.gantt(tasks, "g", "t", "s", "d").first()["text"] == "gantt\n  dateFormat X\n  a :0, 2s\n  b :2, 3s"
    for run in ("1", "1", "2"):
        sinks.archive(spark.createDataFrame([(1, at(0)), (2, at(90000))], "id int, ts timestamp"), "ts", str(tmp_path / "a"), run)
    assert spark.read.parquet(str(tmp_path / "a")).count() == 4
    assert sorted(p.name for p in (tmp_path / "a").glob("day=*")) == ["day=2024-01-01", "day=2024-01-02"]


def test_gains_follow_the_next_longest_path(spark):
    tasks = spark.createDataFrame([("g", "a", 2), ("g", "b", 8), ("g", "c", 5), ("g", "d", 1), ("h", "x", 3)], "dag string, task string, duration long")
    edges = spark.createDataFrame([("g", "b", "a"), ("g", "c", "a"), ("g", "d", "b"), ("g", "d", "c")], "dag string, task string, upstream string")
    got = {(r.dag, r.task): (r.makespan, r.gain) for r in G.gains(tasks, edges, F.lit(0).cast("long")).collect()}
    assert got == {("g", "a"): (11, 2), ("g", "b"): (11, 3), ("g", "c"): (11, 0), ("g", "d"): (11, 1), ("h", "x"): (3, 3)}
    assert G.gains(tasks.limit(0), edges.limit(0), F.lit(0)).count() == 0


def test_rows_and_events_are_appended_together(spark, tmp_path):
    ledger, events = spark.createDataFrame([(1, 5)], "run long, cost long"), spark.createDataFrame([(1, "spent")], "run long, what string")
    for batch in ("b0", "b1", "b1"):
        sinks.append_together({"ledger": ledger, "event": events}, f"{tmp_path}/log", batch)
    got = spark.read.parquet(f"{tmp_path}/log").select("batch", "kind", "run", "cost", "what").collect()
    assert sorted((tuple(r) for r in got), key=str) == [(b, *x) for b in ("b0", "b1") for x in (("event", 1, None, "spent"), ("ledger", 1, 5, None))]
