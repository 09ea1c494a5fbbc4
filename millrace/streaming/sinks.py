"""Micro-batch sinks: dead letters beside valid rows, and idempotent appends."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.joins import latest


def with_dead_letters(valid: Column, good_path: str, dead_path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: valid rows to one folder, the rest to another, each batch in a folder of its own number.

    A batch that is run again overwrites its folder, so rows are never written twice. Rows whose check is null are dead.
    """

    def write(batch: DataFrame, number: int) -> None:
        ok = F.coalesce(valid, F.lit(False))
        batch.persist()
        try:
            batch.where(ok).write.mode("overwrite").parquet(f"{good_path}/batch={number}")
            batch.where(~ok).write.mode("overwrite").parquet(f"{dead_path}/batch={number}")
        finally:
            batch.unpersist()

    return write


def upsert_latest(path: str, keys: list[str], order: list[str], every: int = 50) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the newest row of each key, as a delta for each batch; ``read_latest`` gives the table.

    A batch writes its own rows only. Every so many batches the deltas are merged into a snapshot, and what the
    snapshot before it stood for is deleted; that snapshot stays, for a batch that is run again. A batch that is run again overwrites what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, keys, order).write.mode("overwrite").parquet(f"{path}/delta={number}")
        if (number + 1) % every == 0:
            spark = batch.sparkSession
            read_latest(spark, path, keys, order, number).write.mode("overwrite").parquet(f"{path}/snapshot={number}")
            for kind, n in _folders(spark, path):
                if n < number - every or kind == "delta" and n == number - every:
                    _remove(spark, f"{path}/{kind}={n}")

    return write


def read_latest(spark: SparkSession, path: str, keys: list[str], order: list[str], until: int | None = None) -> DataFrame:
    """The table that ``upsert_latest`` keeps: the last snapshot and the deltas after it, up to a batch if one is named."""
    there = [(kind, n) for kind, n in _folders(spark, path) if until is None or n <= until]
    # A snapshot of the batch itself is that of an earlier try.
    snapshot = max((n for kind, n in there if kind == "snapshot" and n != until), default=-1)
    parts = [f"{path}/delta={n}" for kind, n in sorted(there) if kind == "delta" and n > snapshot]
    frames = [spark.read.parquet(p) for p in parts + ([f"{path}/snapshot={snapshot}"] if snapshot >= 0 else [])]
    return latest(reduce(DataFrame.unionByName, frames), keys, order)


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _folders(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    store, at = _hadoop(spark, path)
    names = [f.getPath().getName() for f in store.listStatus(at)] if store.exists(at) else []
    # A folder counts once its writer has finished it.
    done = [n for n in names if "=" in n and store.exists(_hadoop(spark, f"{path}/{n}/_SUCCESS")[1])]
    return [(n.split("=")[0], int(n.split("=")[1])) for n in done]


def _remove(spark: SparkSession, path: str) -> None:
    store, at = _hadoop(spark, path)
    store.delete(at, True)
