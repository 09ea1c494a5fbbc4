from datetime import datetime, timedelta

from pyspark.sql import functions as F

from millrace.sources import streams
from millrace.streaming import operators as S
from millrace.streaming import sinks

SCHEMA = "k string, ts timestamp, v long, p string"


def at(s):
    return datetime(2024, 1, 1) + timedelta(seconds=s)


def feed(spark, folder, *batches):
    """A file stream that reads one batch a trigger, in order."""
    import os

    for i, b in enumerate(batches):
        path = f"{folder}/{i}"
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.parquet(path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
        for name in os.listdir(path):
            os.utime(f"{path}/{name}", (1_700_000_000 + i, 1_700_000_000 + i))
    return streams.files(spark, f"{folder}/*", spark.createDataFrame([], SCHEMA).schema, 1)


def drain(spark, df, mode, name, folder):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{folder}/cp").start()
    try:
        q.processAllAvailable()
        return [tuple(r) for r in spark.sql(f"select * from {name}").collect()]
    finally:
        q.stop()


def test_batches_by_size_and_time(spark, tmp_path):
    rows = [("a", at(i), i, f"p{i}") for i in range(5)]
    df = feed(spark, str(tmp_path / "in"), rows, [("b", at(100), 0, "x")], [("b", at(200), 0, "y")])
    got = drain(spark, S.batches(df, "k", "ts", "p", 2, 10_000), "append", "by_size", tmp_path)
    assert ("a", 2, ["p0", "p1"]) in got and ("a", 2, ["p2", "p3"]) in got and ("a", 1, ["p4"]) in got


def test_debounce_last_input_wins(spark, tmp_path):
    df = feed(spark, str(tmp_path / "in"), [("a", at(0), 0, "x"), ("a", at(3), 0, "y"), ("a", at(60), 0, "z")], [("b", at(500), 0, "w")], [("b", at(900), 0, "w")])
    got = drain(spark, S.debounced(df, "k", "ts", "p", 5_000, 60_000), "append", "bounce", tmp_path)
    first = int(at(3).timestamp() * 1000) + 5_000
    assert ("a", first, 2, "y") in got and any(r[0] == "a" and r[2:] == (1, "z") for r in got)


def test_latest_state_ignores_late_versions(spark, tmp_path):
    df = feed(spark, str(tmp_path / "in"), [("a", at(0), 2, "two")], [("a", at(1), 1, "one")], [("a", at(2), 3, "three")])
    got = drain(spark, S.latest_state(df, "k", "ts", "v", "p"), "update", "state", tmp_path)
    assert got == [("a", 2, "two"), ("a", 3, "three")]


def test_dedupe_windows_and_counts(spark, tmp_path):
    df = feed(spark, str(tmp_path / "in"), [("a", at(0), 1, "x"), ("a", at(1), 1, "x")], [("b", at(2), 1, "x")])
    assert len(drain(spark, S.deduplicated(df, ["k"], "ts", "1 hour"), "append", "dedupe", tmp_path)) == 2
    assert ("b", 1) in drain(spark, S.counts(df, "k"), "update", "counts", tmp_path / "c")
    batch = spark.createDataFrame([("a", at(0), 1, "x"), ("a", at(100), 1, "x"), ("a", at(4000), 1, "x")], SCHEMA)
    assert S.windowed_counts(batch, "ts", "k", "1 minute", "0 seconds").count() == 3
    assert sorted(r.n for r in S.sessions(batch, "ts", "k", "5 minutes", "0 seconds").collect()) == [1, 2]


def test_sinks_run_again_without_doubling(spark, tmp_path):
    batch = spark.createDataFrame([("a", at(0), 1, "x"), ("b", at(1), None, "y")], SCHEMA)
    write = sinks.with_dead_letters(F.col("v") > 0, str(tmp_path / "good"), str(tmp_path / "dead"))
    write(batch, 0), write(batch, 0)
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1
    assert spark.read.parquet(str(tmp_path / "dead")).count() == 1
    keep = sinks.upsert_latest(str(tmp_path / "t"), ["k"], ["v"])
    keep(spark.createDataFrame([("a", at(0), 1, "x")], SCHEMA), 0)
    keep(spark.createDataFrame([("a", at(0), 2, "y"), ("b", at(0), 1, "z")], SCHEMA), 1)
    assert {(r.k, r.p) for r in sinks.read_latest(spark, str(tmp_path / "t"), ["k"], ["v"]).collect()} == {("a", "y"), ("b", "z")}


def test_upserts_are_compacted(spark, tmp_path):
    keep = sinks.upsert_latest(str(tmp_path), ["k"], ["v"], every=2)
    for n in (0, 1, 2, 3, 3, 4):
        keep(spark.createDataFrame([("a", at(0), n, f"p{n}"), (f"k{n}", at(0), 0, "own")], SCHEMA), n)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["delta=2", "delta=3", "delta=4", "snapshot=1", "snapshot=3"]
    got = {(r.k, r.p) for r in sinks.read_latest(spark, str(tmp_path), ["k"], ["v"]).collect()}
    assert got == {("a", "p4")} | {(f"k{n}", "own") for n in range(5)}


def test_latest_state_forgets(spark, tmp_path):
    df = feed(spark, str(tmp_path / "in"), [("a", at(0), 5, "five")], [("b", at(1000), 1, "x")], [("b", at(2000), 2, "y")], [("a", at(3000), 1, "again")])
    got = drain(spark, S.latest_state(df, "k", "ts", "v", "p", forget_ms=60_000), "update", "forgets", tmp_path)
    assert ("a", 5, "five") in got and ("a", 1, "again") in got
