"""Predicates over runs, events and attributes, as Columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The ten states of a run, and which of them are over.
ACTIVE = ("RUNNING", "PAUSED", "MIGRATING")
TERMINAL = ("COMPLETED", "FAILED", "CANCELLED", "TIMED_OUT", "CONTINUED_AS_NEW", "TERMINATED", "MIGRATED")


def always() -> Column:
    return F.lit(True)


def optional(**wanted) -> Column:
    """column == value for each value that is given; those of None match everything."""
    out = always()
    for name, value in wanted.items():
        if value is not None:
            out = out & (F.col(name) == F.lit(value))
    return out


def one_of(col: str, values: Sequence) -> Column:
    """col in values; an empty list matches everything."""
    return F.col(col).isin(list(values)) if values else always()


def state_group(col: str, group: str, terminal: Sequence[str] = TERMINAL) -> Column:
    """``active`` (not in ``terminal``), ``terminal`` or ``all``."""
    over = F.col(col).isin(list(terminal))
    try:
        return {"active": ~over, "terminal": over, "all": always()}[group]
    except KeyError:
        raise ValueError(f"unknown state group {group!r}") from None


def between(col: str, after=None, before=None) -> Column:
    """Both bounds inclusive; None leaves a side open."""
    out = always()
    if after is not None:
        out = out & (F.col(col) >= F.lit(after))
    if before is not None:
        out = out & (F.col(col) <= F.lit(before))
    return out


def half_open(col: str, start, stop) -> Column:
    return (F.col(col) >= F.lit(start)) & (F.col(col) < F.lit(stop))


def json_path(key: str) -> str:
    """The path of a top-level key, whatever characters but single quotes it holds."""
    if "'" in key:
        raise ValueError("a key with a single quote has no path")
    return f"$['{key}']"


def attribute(json_col: str, key: str, op: str, value=None) -> Column:
    """Comparison of a top-level attribute of a JSON object.

    Numbers compare only with JSON numbers and strings only with JSON strings; a missing attribute fails every operator.
    """
    path = json_path(key)
    if op == "exists":
        return F.get_json_object(json_col, path).isNotNull()
    if op == "in":
        out = F.lit(False)
        for v in value:
            out = out | attribute(json_col, key, "eq", v)
        return out
    ops = {"eq": "__eq__", "ne": "__ne__", "gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}
    if op not in ops:
        raise ValueError(f"unknown operator {op!r}")
    raw = F.try_variant_get(F.try_parse_json(F.col(json_col)), path, "variant")
    kind = F.schema_of_variant(raw)
    if isinstance(value, bool):
        got, right = F.try_variant_get(raw, "$", "boolean"), kind == "BOOLEAN"
    elif isinstance(value, (int, float)):
        got, right = F.try_variant_get(raw, "$", "double"), kind.rlike("^(BIGINT|DOUBLE|DECIMAL)")
    else:
        got, right = F.try_variant_get(raw, "$", "string"), kind == "STRING"
    return F.coalesce(right & getattr(got, ops[op])(F.lit(value)), F.lit(False))


def contains_attributes(json_col: str, wanted: dict) -> Column:
    """The object holds every wanted attribute with that value."""
    out = always()
    for key, value in wanted.items():
        out = out & attribute(json_col, key, "eq", value)
    return out


def all_of(*parts: Column) -> Column:
    out = always()
    for p in parts:
        out = out & p
    return out


def any_of(*parts: Column) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def meets(labels: str, requirements: dict[str, str | Sequence[str]]) -> Column:
    """A label map meets every requirement: a value, or one of several. A missing label fails."""
    out = always()
    for key, want in requirements.items():
        have = F.element_at(F.col(labels), F.lit(key))
        out = out & F.coalesce(have.isin([want] if isinstance(want, str) else list(want)), F.lit(False))
    return out


def guarded_int(c: Column, limit: int = 2**32 - 1) -> Column:
    """Digits only and within the limit, else null."""
    number = F.when(c.rlike("^[0-9]{1,18}$"), c.cast("long"))
    return F.when(number <= limit, number)


def breached(deadline: str, completed: str, paused: Column, now) -> Column:
    """The deadline passed before the run ended, or before now if it has not ended; paused runs do not breach."""
    return (F.col(deadline) < F.coalesce(F.col(completed), F.lit(now))) & ~paused


def at_least(events: DataFrame, run: str, n: int) -> DataFrame:
    """Runs with n events or more."""
    return events.groupBy(run).agg(F.count("*").alias("n_events")).where(F.col("n_events") >= n)


def changed(a: Column, b: Column) -> Column:
    """Different, where null equals null."""
    return ~a.eqNullSafe(b)
