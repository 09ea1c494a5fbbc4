"""Joins that event histories need beyond plain equality."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.sinks import written


def asof_last(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, right_ts: str, out: str) -> DataFrame:
    """left with ``out``: the latest right_ts of the same keys at or before ts, or null.

    One shuffle by key: both sides are stacked and the last right time is carried forward.
    """
    cols = left.columns
    a = left.select(*cols, F.col(ts).alias("_t"), F.lit(None).cast(right.schema[right_ts].dataType).alias("_r"), F.lit(1).alias("_side"))
    names = {f.name: f.dataType for f in left.schema}
    b = right.select(*[F.col(c) if c in keys else F.lit(None).cast(names[c]).alias(c) for c in cols], F.col(right_ts).alias("_t"), F.col(right_ts).alias("_r"), F.lit(0).alias("_side"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return a.unionByName(b).withColumn(out, F.last("_r", ignorenulls=True).over(w)).where("_side = 1").drop("_t", "_r", "_side")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that comes last in ``order``: one aggregate, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    got = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return got.select(*keys, "_r.*").select(*df.columns)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rn") -> DataFrame:
    """The first k rows of each key; ``order`` must be total for a fixed result."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= k)


def without(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other, list(on), "left_anti")


def only_with(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other.select(*on).distinct(), list(on), "left_semi")


def with_counts(catalog: DataFrame, key: str, **counted: DataFrame) -> DataFrame:
    """catalog with a count column for each frame of the same key; absent keys count 0."""
    out = catalog
    for name, df in counted.items():
        out = out.join(df.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def coverage_gap(demand: DataFrame, polls: DataFrame, queues: str, queue: str, paused: DataFrame | None = None) -> DataFrame:
    """Demanded queues that no live worker's list of queues holds and that are not paused."""
    live = polls.select(F.explode(queues).alias(queue)).distinct()
    gap = demand.select(queue).distinct().join(live, queue, "left_anti")
    return gap.join(paused, queue, "left_anti") if paused is not None else gap


def run_tree(runs: DataFrame, roots: DataFrame, id_col: str, parent: str, max_depth: int) -> DataFrame:
    """(root, id, depth) below the given roots, by a join for each level, until a level is empty; no run is visited twice
    in a tree of single parents, and ``max_depth`` ends cycles. Levels are written out, so their number of rows is not limited."""
    edges = written(runs.select(F.col(id_col).alias("_id"), F.col(parent).alias("_parent")).where("_parent <> _id"))
    level = written(roots.select(F.col(id_col).alias("root"), F.col(id_col).alias("id"), F.lit(0).alias("depth")))
    found = level
    for depth in range(1, max_depth + 1):
        level = written(level.join(edges, F.col("_parent") == F.col("id")).select("root", F.col("_id").alias("id"), F.lit(depth).alias("depth")))
        if level.isEmpty():
            break
        found = found.union(level)
    return found


def next_of(a: str, b: str, after_a, after_b) -> Column:
    """(a, b) > (after_a, after_b), as keyset paging needs it."""
    return (F.col(a) > F.lit(after_a)) | ((F.col(a) == F.lit(after_a)) & (F.col(b) > F.lit(after_b)))


def previous_of(a: str, b: str, before_a, before_b) -> Column:
    return (F.col(a) < F.lit(before_a)) | ((F.col(a) == F.lit(before_a)) & (F.col(b) < F.lit(before_b)))


def page(df: DataFrame, order: Sequence[Column], size: int) -> DataFrame:
    """A page and the row after it, by which a caller sees that there is more."""
    return df.orderBy(*order).limit(size + 1)


def nested(rows: DataFrame) -> DataFrame:
    """(root, tree): the rows (root, id, parent, depth) of trees as one text for each root, as 1(4(16,17),5).

    From the deepest level up, the texts of a node's children are set into its own, in the order of their ids.
    """
    rows = written(rows)
    deepest = rows.agg(F.max("depth")).first()[0]
    if deepest is None:
        return rows.select("root", F.lit("").alias("tree"))
    below = None
    for depth in range(deepest, -1, -1):
        own = rows.where(F.col("depth") == depth).withColumn("text", F.col("id").cast("string"))
        if below is not None:
            inside = below.groupBy("root", F.col("parent").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("c"))
            own = own.join(inside, ["root", "id"], "left").withColumn("text", F.concat("text", F.coalesce(F.concat(F.lit("("), F.array_join(F.transform("c", lambda x: x.text), ","), F.lit(")")), F.lit(""))))
        below = written(own.select("root", "id", "parent", "text"))
    return below.select("root", F.col("text").alias("tree"))


def merged_page(shards: Sequence[DataFrame], order: Sequence[str], after: Sequence, size: int) -> DataFrame:
    """The page after a place in the order over all shards; each task keeps its own first rows before they are merged."""
    every = reduce(DataFrame.unionByName, shards)
    return page(every.where(next_of(*order, *after)), [F.asc(c) for c in order], size)
