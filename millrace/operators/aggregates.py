"""Grouped counts, sums and censuses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.windows import numbered, seconds
from millrace.sources.sinks import written

LONG_MAX = 2**63 - 1


def grouped_count(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    return df.groupBy(*dims).agg(F.count("*").alias("n"))


def top_n_other(counts: DataFrame, key: str, n: int, count: str = "n", other: str = "_other") -> DataFrame:
    """The n largest groups, ties by key, and one row for the rest; the counts still add up."""
    return top_n_rest(counts, key, n, [F.sum(count).alias(count)], count, other)


def top_n_rest(groups: DataFrame, key: str, n: int, rest: Sequence[Column], count: str = "n", other: str = "_other") -> DataFrame:
    """The n largest groups, ties by key, and one row of the aggregates ``rest`` over the others, if there are any.

    Each task keeps its own n largest, so no task sees all groups, and the n keys are few enough to be broadcast.
    """
    groups = written(groups)
    top = groups.orderBy(F.desc(count), F.asc(key)).limit(n)
    keys = F.broadcast(top.select(F.col(key).alias("_top")))
    others = groups.join(keys, F.col(key).eqNullSafe(F.col("_top")), "left_anti")
    summed = others.agg(F.count("*").alias("_groups"), *rest).where("_groups > 0").drop("_groups").withColumn(key, F.lit(other))
    return top.unionByName(summed.select(*groups.columns))


def saturating_sum(c: Column) -> Column:
    """A sum that stays at the largest long instead of overflowing; 0 for no rows."""
    total = F.coalesce(F.sum(c.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return F.least(total, F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")


def money(c: Column) -> Column:
    """An exact sum of values with two decimals, whatever the order of rows."""
    return F.sum(c.cast("decimal(18,2)")).cast("double")


def sample_ids(order: Column, id_col: Column, n: int) -> Column:
    """Up to n ids in order, as one comma-joined text."""
    return F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct(order.alias("o"), id_col.alias("i")))), 1, n), lambda s: s.i.cast("string")), ",")


def shapes(events: DataFrame, run: str, order: Sequence[str], kind: str) -> DataFrame:
    """(run, shape): the kinds of a run's events in order, joined by '>'."""
    w = F.array_sort(F.collect_list(F.struct(*order, kind)))
    return events.groupBy(run).agg(F.array_join(F.transform(w, lambda s: s[kind]), ">").alias("shape"))


def shape_census(events: DataFrame, run: str, order: Sequence[str], kind: str) -> DataFrame:
    """(shape, n, share) for each distinct shape."""
    counts = shapes(events, run, order, kind).groupBy("shape").agg(F.count("*").alias("n"))
    return counts.crossJoin(counts.agg(F.sum("n").alias("total"))).select("shape", "n", (F.col("n") / F.col("total")).alias("share"))


def buckets(df: DataFrame, ts: str, width_seconds: int) -> DataFrame:
    """df with ``bucket``: the epoch second at which its span of that width begins, rounded down before 1970 too."""
    return df.withColumn("bucket", F.floor(seconds(F.col(ts)) / width_seconds) * width_seconds)


def herd(df: DataFrame, ts: str, who: str, width_seconds: int, least: int) -> DataFrame:
    """(bucket, fires, schedules) where at least so many different schedules fire in one bucket."""
    got = buckets(df, ts, width_seconds).groupBy("bucket").agg(F.count("*").alias("fires"), F.countDistinct(who).alias("schedules"))
    return got.where(F.col("schedules") >= least)


def pivot(df: DataFrame, item: str, config: str, score: str, configs: Sequence) -> DataFrame:
    """A column of mean scores for each config; missing scores do not enter the mean."""
    return df.groupBy(item).pivot(config, list(configs)).agg(F.avg(score))


def first_difference(a: Column, b: Column) -> Column:
    """0-based place of the first difference of two arrays; the shorter length if one begins the other; null if equal."""
    both = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    at = F.array_position(both, False) - 1
    return F.when(at >= 0, at)


def nearest_ranks(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(key, a column for each share, n): the least value that so large a share of a key's values do not exceed.

    Exact: rows are sorted over ranges, so a key with most of the rows is spread over many tasks. Null values do not count.
    """
    ranked = written(numbered(df.where(F.col(value).isNotNull()).select(key, value), [key], [value], "_no").select(key, value, "_no"))
    sizes = ranked.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("n"))
    at = lambda p: F.max(F.when(F.col("_no") == F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n"))), F.col(value)))
    return ranked.join(sizes, F.col(key).eqNullSafe(F.col("_key"))).groupBy(key).agg(*[at(p).alias(name) for name, p in shares.items()], F.max("n").alias("n"))
