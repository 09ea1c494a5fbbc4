"""Running and ranked views of event sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.sinks import written


def micros(c: Column) -> Column:
    """Microseconds since the epoch of a time with or without a zone (then taken in the session's)."""
    return F.unix_micros(c.cast("timestamp"))


def seconds(c: Column) -> Column:
    return F.unix_seconds(c.cast("timestamp"))


def sweep(intervals: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """(keys, t, running): how many intervals are open after each edge; an end comes before a start at the same time.

    Edges of the same time and kind are summed first, so that a busy moment is one row. Intervals are read once, and stay
    where they are if they are dealt out by ``keys``, or some of them, already.
    """
    edge = lambda c, delta: F.struct(F.col(c).alias("t"), F.lit(delta).alias("delta"))
    edges = intervals.select(*keys, F.inline(F.array(edge(start, 1), edge(end, -1))))
    edges = edges.groupBy(*keys, "t", "delta").agg(F.sum("delta").alias("step"))
    w = Window.partitionBy(*keys).orderBy("t", "delta").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return edges.withColumn("running", F.sum("step").over(w)).select(*keys, "t", "delta", "running")


def peak(intervals: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """(keys, peak, at): the most open intervals and when that many were first open."""
    got = sweep(intervals, keys, start, end)
    return got.groupBy(*keys).agg(F.max("running").alias("peak"), F.min_by("t", F.struct((-F.col("running")).alias("r"), F.col("t").alias("t"))).alias("at"))


def repeats_in_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], what: Column, span: int, out: str = "repeats") -> DataFrame:
    """df with how often the row's own ``what`` stands among the last ``span`` rows, itself included."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(span - 1), 0)
    marked = df.withColumn("_what", what).withColumn("_seen", F.collect_list("_what").over(w))
    return marked.withColumn(out, F.size(F.filter("_seen", lambda x: x == F.col("_what")))).drop("_what", "_seen")


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], starts: Column, out: str = "island") -> DataFrame:
    """df numbered by runs of rows: a new run begins where ``starts`` is true."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def debounce(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], gap_seconds: int) -> DataFrame:
    """(keys, island, first, fire, n, last row's order): bursts closed by a quiet gap; fires a gap after the last event."""
    w = Window.partitionBy(*keys).orderBy(*order)
    far = F.coalesce(micros(F.col(ts)) - micros(F.lag(ts).over(w)) >= gap_seconds * 1_000_000, F.lit(True))
    marked = islands(df.withColumn("_far", far), keys, order, F.col("_far"))
    return marked.groupBy(*keys, "island").agg(F.min(ts).alias("first"), (F.max(ts) + F.make_dt_interval(secs=F.lit(gap_seconds))).alias("fire"), F.count("*").alias("n"), F.max_by(order[-1], F.struct(*order)).alias("last"))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """df with its number, from 1, in the order of each key.

    Rows are dealt out by ranges of key and order and numbered within a range; the sizes of a key's earlier ranges, a row
    for each range, are added. So a key with a large share of the rows is numbered by many tasks.
    """
    parts = written(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    sizes = parts.groupBy(*keys, "_range").agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    within = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    return parts.withColumn("_within", within).join(before, same).withColumn(out, F.col("_within") + F.col("_before")).select(*df.columns, out)


def count_batches(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """df with ``batch``: arrival order cut into batches of ``size`` for each key."""
    return numbered(df, keys, order, "_no").withColumn("batch", F.floor((F.col("_no") - 1) / size)).drop("_no")


def carried(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str) -> DataFrame:
    """df with the last non-null value so far."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))
