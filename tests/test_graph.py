import random
from itertools import pairwise

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.operators import graph as G
from millrace.operators import layout

TASKS, EDGES = "dag string, task int, duration long", "dag string, task int, upstream int"


def laid_by_hand(tasks, edges):
    """{(dag, task): (at, tail, makespan)} of tasks {(dag, task): duration}, edges (dag, task, upstream)."""
    edges = [(g, t, u) for g, t, u in edges if (g, t) in tasks and (g, u) in tasks]
    at, tail = {}, {}
    for _ in range(len(tasks) + 1):
        for g, t in tasks:
            at[g, t] = max([0, *(at.get((g, u), 0) + tasks[g, u] for h, x, u in edges if (h, x) == (g, t) and tasks[g, u] is not None)])
            tail[g, t] = max([0, *(tail.get((g, x), 0) + tasks[g, x] for h, x, u in edges if (h, u) == (g, t) and tasks[g, x] is not None)])
    ends = {}
    for (g, t), d in tasks.items():
        if d is not None:
            ends[g] = max(ends.get(g, at[g, t] + d), at[g, t] + d)
    return {(g, t): (at[g, t], tail[g, t], ends.get(g)) for g, t in tasks}


def gain_by_hand(tasks, edges, changed, shorter):
    tasks, edges = {k: d for k, d in tasks.items() if k[0] == changed[0]}, [e for e in edges if e[0] == changed[0]]
    at, tail, end = laid_by_hand(tasks, edges)[changed]
    if tasks[changed] is None or end - tail - tasks[changed] != at:
        return 0
    sooner = laid_by_hand(tasks | {changed: shorter(tasks[changed])}, edges)[changed][2]
    return 0 if sooner is None else end - sooner


def random_graphs(seed, graphs=25, most=9):
    draw = random.Random(seed)
    tasks, edges = {}, []
    for g in range(graphs):
        names = draw.sample(range(-50, 50), draw.randint(1, most))
        for i, t in enumerate(names):
            tasks[f"g{g}", t] = draw.choice([None, -2, 0, 1, 1, 2, 3, 5, 8])
            edges += [(f"g{g}", t, u) for u in names[:i] if draw.random() < 0.4]
        # Repeated edges, and edges whose ends are no tasks.
        edges += [*draw.sample(edges, min(2, len(edges))), (f"g{g}", names[0], 999), (f"g{g}", 998, names[0]), (f"h{g}", names[0], names[-1])]
    return tasks, edges


def frames(spark, tasks, edges):
    return spark.createDataFrame([(*k, d) for k, d in tasks.items()], TASKS), spark.createDataFrame(edges, EDGES)


@pytest.fixture
def jobs_of(spark):
    def count(name, run):
        spark.sparkContext.setJobGroup(name, name)
        try:
            run()
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    return count


@pytest.mark.parametrize("large, graphs, most", [(G.LARGE, 25, 9), (4, 4, 4)])
def test_gains_against_brute_force(spark, large, graphs, most):
    tasks, edges = random_graphs(1, graphs, most)
    got = G.gains(*frames(spark, tasks, edges), F.floor(F.col("duration") / 2).cast("long"), large).collect()
    assert {(r.dag, r.task): r.gain for r in got} == {k: gain_by_hand(tasks, edges, k, lambda d: d // 2) for k in tasks}
    assert len(got) == len(tasks)


def test_gains_of_a_chain_take_no_job_for_each_level(spark, jobs_of):
    tasks = {("g", i): 1 for i in range(40)}
    edges = [("g", b, a) for a, b in pairwise(range(40))]
    got = []
    assert jobs_of("gains of a chain", lambda: got.extend(G.gains(*frames(spark, tasks, edges), F.lit(0).cast("long")).collect())) < 20
    assert [r.gain for r in got] == [1] * 40


def rows_of(tasks, edges):
    rows = [(g, t, d, None if d is None else d // 2, None, False) for (g, t), d in tasks.items()] + [(g, t, None, None, u, True) for g, t, u in edges]
    rows.sort(key=lambda r: r[0])
    kinds = {"dag": pa.string(), "task": pa.int32(), "duration": pa.int64(), "shorter": pa.int64(), "upstream": pa.int32(), "edge": pa.bool_()}
    return pa.table({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(kinds.items())})


@pytest.mark.parametrize("batch, gathered", [(1, 1), (3, 7), (1000, 20), (1000, 1 << 16)])
def test_graphs_are_cut_at_any_batch_and_large_ones_passed_over(monkeypatch, batch, gathered):
    monkeypatch.setattr(layout, "ROWS", gathered)
    tasks, edges = random_graphs(2, 10)
    tasks |= {("g3x", i): 1 for i in range(400)} | {("zz", i): 1 for i in range(400)}
    got = pa.Table.from_batches(layout.lay_out(iter(rows_of(tasks, edges).to_batches(max_chunksize=batch)), 100, True)).to_pylist()
    assert [r["dag"] for r in got if r["state"] == layout.LARGE] == ["g3x", "zz"]
    by_hand = laid_by_hand({k: d for k, d in tasks.items() if k[0] not in ("g3x", "zz")}, edges)
    assert {(r["dag"], r["task"]): (r["at"], r["tail"], r["makespan"]) for r in got if r["state"] == layout.FINE} == by_hand
    whole = pa.Table.from_batches(layout.lay_out(iter(rows_of(tasks, edges).to_batches(max_chunksize=batch)), 10_000, False)).to_pylist()
    assert len(whole) == len(tasks) and {r["state"] for r in whole} == {layout.FINE}


def test_sums_beyond_a_long_are_an_error():
    tasks = {("g", 1): 2**62, ("g", 2): 2**62}
    with pytest.raises(ArithmeticError):
        list(layout.lay_out(iter(rows_of(tasks, [("g", 2, 1)]).to_batches()), 100, False))


@pytest.mark.parametrize("large, graphs, most", [(G.LARGE, 25, 9), (4, 4, 4)])
def test_slack_against_brute_force(spark, large, graphs, most):
    tasks, edges = random_graphs(3, graphs, most)
    got = G.slack(*frames(spark, tasks, edges), large).collect()
    by_hand = laid_by_hand(tasks, edges)
    assert len(got) == len(tasks)
    for r in got:
        at, tail, end = by_hand[r.dag, r.task]
        d = tasks[r.dag, r.task]
        assert (r.duration, r.early_start, r.makespan) == (d, at, end)
        assert (r.early_finish, r.slack) == ((None, None) if d is None else (at + d, end - tail - d - at))


def test_slack_takes_ids_and_durations_of_other_types(spark):
    tasks = spark.sql("select struct(g as a, 'x' as b) as dag, struct(t as n) as task, cast(t as double) / 4 as duration from values (1, 1), (1, 2), (2, 1), (2, null) v(g, t)")
    edges = spark.sql("select struct(1 as a, 'x' as b) as dag, struct(2 as n) as task, struct(1 as n) as upstream")
    want = {(1, 1): (0.0, 0.0, 0.75), (1, 2): (0.25, 0.0, 0.75), (2, 1): (0.0, 0.0, 0.25), (2, None): (0.0, None, 0.25)}
    for kind in ("double", "decimal(10,2)"):
        got = G.slack(tasks.withColumn("duration", F.col("duration").cast(kind)), edges).collect()
        assert {(r.dag.a, r.task.n): tuple(None if v is None else float(v) for v in (r.early_start, r.slack, r.makespan)) for r in got} == want


def test_an_edge_from_no_task_is_no_cycle(spark, jobs_of):
    tasks, edges = {("g", 5): 3, **{("h", i): 1 for i in range(40)}}, [("g", 5, 2), *[("h", b, a) for a, b in pairwise(range(40))]]
    got = []
    assert jobs_of("slack of a chain", lambda: got.extend(G.slack(*frames(spark, tasks, edges)).collect())) < 20
    assert {(r.dag, r.task): (r.early_start, r.slack) for r in got} == {("g", 5): (0, 0), **{("h", i): (i, 0) for i in range(40)}}
    for large in (G.LARGE, 2):
        with pytest.raises(ValueError):
            G.slack(*frames(spark, {("k", 1): 1, ("k", 2): 1}, [("k", 1, 2), ("k", 2, 1)]), large)
