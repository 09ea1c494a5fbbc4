"""Closed forms of throttles and retries, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket_level(tokens: Column, elapsed_seconds: Column, rate: Column, burst: Column) -> Column:
    """Tokens in a bucket after that time, up to the burst."""
    return F.least(burst, tokens + elapsed_seconds * rate)


def retry_delay(attempt: Column, first: float, factor: float, most: float) -> Column:
    """Delay before the next try after attempt 1, 2, ...: exponential, cut off at the most."""
    return F.least(F.lit(most), F.lit(first) * F.pow(F.lit(factor), attempt - 1))


def reachable_attempts(limit: int, first: float, factor: float, most: float, run_seconds: Column, deadline: Column) -> Column:
    """How many of ``limit`` attempts can begin before the deadline, each running so long and then waiting its delay."""
    step = lambda s, i: F.when(s.on & (s.at < deadline), F.struct((s.at + run_seconds + retry_delay(i, first, factor, most)).alias("at"), (s.n + 1).alias("n"), F.lit(True).alias("on"))).otherwise(F.struct(s.at.alias("at"), s.n.alias("n"), F.lit(False).alias("on")))
    start = F.struct(F.lit(0.0).alias("at"), F.lit(0).alias("n"), F.lit(True).alias("on"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(limit)), start, step, lambda s: s.n)


def fair_key(weight: Column, draw: Column) -> Column:
    """Key of weighted random order: the largest comes first; weights of zero come last."""
    return F.when(weight > 0, F.pow(draw, F.lit(1.0) / weight)).otherwise(F.lit(-1.0))


def aged_priority(priority: Column, waited_seconds: Column, aging_seconds: int) -> Column:
    return priority + F.floor(waited_seconds / aging_seconds)
