"""Batch sinks of run histories."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def archive(events: DataFrame, ts: str, path: str, run: str) -> None:
    """Events as Parquet by day and run, so that old days can be dropped as folders; a run that is tried again replaces its own."""
    rows = events.withColumns({"day": F.to_date(ts), "run": F.lit(run)})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "run").parquet(path)


def append_together(parts: dict[str, DataFrame], path: str, batch: str) -> None:
    """Rows of several kinds, such as ledger rows and the events they stem from, appended by one job: none without the other.

    Each kind is a folder under its batch, and a batch that is tried again replaces its own. Kinds lack the columns that
    only others have (null); columns of one name must have one type.
    """
    kinds = [df.withColumns({"batch": F.lit(batch), "kind": F.lit(kind)}) for kind, df in parts.items()]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kinds)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "kind").parquet(path)


def chrome_trace(spans: DataFrame, name: str, track: str, start_us: str, end_us: str) -> DataFrame:
    """(value): one JSON trace event for each span, to be written as text."""
    event = F.struct(F.col(name).cast("string").alias("name"), F.lit("X").alias("ph"), F.col(start_us).alias("ts"), (F.col(end_us) - F.col(start_us)).alias("dur"), F.lit(1).alias("pid"), F.col(track).alias("tid"))
    return spans.select(F.to_json(event).alias("value"))


def mermaid(edges: DataFrame, graph: str, task: str, upstream: str) -> DataFrame:
    """(graph, text): each graph's edges as a flow chart."""
    lines = F.array_sort(F.collect_set(F.concat(F.lit("  "), F.col(upstream).cast("string"), F.lit(" --> "), F.col(task).cast("string"))))
    return edges.groupBy(graph).agg(F.concat(F.lit("graph TD\n"), F.array_join(lines, "\n")).alias("text"))


def dot(edges: DataFrame, graph: str, task: str, upstream: str) -> DataFrame:
    """(graph, text): each graph's edges in the DOT language, in the order of their text."""
    name = lambda c: F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('\\"')), F.lit('"'))
    lines = F.array_sort(F.collect_set(F.concat(F.lit("  "), name(upstream), F.lit(" -> "), name(task), F.lit(";"))))
    return edges.groupBy(graph).agg(F.concat(F.lit("digraph {\n"), F.array_join(lines, "\n"), F.lit("\n}")).alias("text"))


def gantt(schedule: DataFrame, graph: str, task: str, start: str, duration: str) -> DataFrame:
    """(graph, text): each graph's tasks as a Gantt chart, by their start and name; times are seconds from the graph's begin."""
    line = F.concat(F.lit("  "), F.col(task).cast("string"), F.lit(" :"), F.col(start).cast("string"), F.lit(", "), F.col(duration).cast("string"), F.lit("s"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), F.col(task).alias("t"), line.alias("line")))), lambda x: x.line)
    return schedule.groupBy(graph).agg(F.concat(F.lit("gantt\n  dateFormat X\n"), F.array_join(lines, "\n")).alias("text"))


def orphans(files: DataFrame, references: DataFrame, path: str, modified: str, older_than) -> DataFrame:
    """Stored files that no row refers to and that are older than a grace period."""
    return files.where(F.col(modified) < F.lit(older_than)).join(references.select(path).distinct(), path, "left_anti")


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet under spark.checkpoint.dir and read back; where that is not set, only a local master may use a temporary folder."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    path = f"{base.rstrip('/')}/millrace-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
