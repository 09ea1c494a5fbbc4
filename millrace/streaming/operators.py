"""Structured Streaming forms of the stateful operators. Each takes a streaming (or batch) DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def deduplicated(df: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed them."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def not_expired(df: DataFrame, ts: str, expires: str) -> DataFrame:
    """Rows that start before they expire; rows that never expire stay."""
    return df.where(F.col(expires).isNull() | (F.col(expires) > F.col(ts)))


def counts(df: DataFrame, key: str) -> DataFrame:
    """Running counts by key, for update mode: each trigger gives the keys whose count changed."""
    return df.groupBy(key).agg(F.count("*").alias("n"))


def windowed_counts(df: DataFrame, ts: str, key: str, width: str, late: str) -> DataFrame:
    return df.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sessions(df: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    return df.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def latest_state(df: DataFrame, key: str, ts: str, version: str, value: str, late: str = "0 seconds", forget_ms: int | None = None) -> DataFrame:
    """(key, version, value) whenever a key's newest version changes; older versions that come late change nothing.

    With ``forget_ms`` a key is forgotten once the watermark has passed its last row by so long, so that state follows the
    live keys; a version that comes later still counts as new.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = state.get[:2] if state.exists else None
        last = state.get[2] if state.exists else 0
        was = best
        for pdf in frames:
            row = pdf.loc[pdf[version].idxmax()]
            last = max(last, int(pdf[ts].max().timestamp() * 1000))
            if best is None or int(row[version]) > best[0]:
                best = (int(row[version]), None if row[value] is None else str(row[value]))
        if best is not None:
            state.update((*best, last))
            if forget_ms is not None:
                state.setTimeoutTimestamp(max(last + forget_ms, state.getCurrentWatermarkMs() + 1))
        if best is not None and best != was:
            yield pd.DataFrame({key: [k[0]], "version": [best[0]], "value": [best[1]]})

    kind = df.schema[key].dataType.simpleString()
    timed = df if forget_ms is None else df.withWatermark(ts, late)
    rows = timed.select(key, ts, version, F.col(value).cast("string").alias(value))
    timeout = GroupStateTimeout.NoTimeout if forget_ms is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, version long, value string", "version long, value string, last long", "update", timeout)


def _in_order(frames: Iterator[pd.DataFrame], ts: str, payload: str) -> list[tuple]:
    """A trigger's rows of one key by time, over all the chunks in which they come."""
    return sorted((row for pdf in frames for row in zip(pdf[ts], pdf[payload])), key=lambda x: (x[0], str(x[1])))


def batches(df: DataFrame, key: str, ts: str, payload: str, size: int, wait_ms: int, late: str = "0 seconds") -> DataFrame:
    """(key, n, payloads): arrival order, flushed at ``size`` payloads or ``wait_ms`` of event time after the first."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        first = state.get[1] if state.exists else None
        out = []
        if state.hasTimedOut:
            out.append(held)
            held, first = [], None
        else:
            for t, p in _in_order(frames, ts, payload):
                first = int(t.timestamp() * 1000) if first is None else first
                held.append(str(p))
                if len(held) >= size:
                    out.append(held)
                    held, first = [], None
        if held:
            state.update((held, first))
            state.setTimeoutTimestamp(max(first + wait_ms, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame({key: [k[0]] * len(out), "n": [len(x) for x in out], "payloads": out})

    kind = df.schema[key].dataType.simpleString()
    rows = df.withWatermark(ts, late).select(key, ts, payload)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n int, payloads array<string>", "held array<string>, first long", "append", GroupStateTimeout.EventTimeTimeout)


def debounced(df: DataFrame, key: str, ts: str, payload: str, gap_ms: int, most_ms: int, late: str = "0 seconds") -> DataFrame:
    """(key, fire_ms, n, payload): one firing for each burst, at the last input plus the gap or the first plus the cap."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, fire, n, last = state.get if state.exists else (None, None, 0, None)
        out = []
        if state.hasTimedOut:
            out.append((fire, n, last))
            first = None
        else:
            for t, p in _in_order(frames, ts, payload):
                now = int(t.timestamp() * 1000)
                if first is not None and now >= fire:
                    out.append((fire, n, last))
                    first = None
                if first is None:
                    first, n = now, 0
                n, last, fire = n + 1, str(p), min(now + gap_ms, first + most_ms)
        if first is not None:
            state.update((first, fire, n, last))
            state.setTimeoutTimestamp(max(fire, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame({key: [k[0]] * len(out), "fire_ms": [x[0] for x in out], "n": [x[1] for x in out], "payload": [x[2] for x in out]})

    kind = df.schema[key].dataType.simpleString()
    rows = df.withWatermark(ts, late).select(key, ts, payload)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, fire_ms long, n int, payload string", "first long, fire long, n int, last string", "append", GroupStateTimeout.EventTimeTimeout)
