"""JSON documents as rows of their leaves, and what changed between two versions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.sinks import written


def leaves(df: DataFrame, keys: Sequence[str], document: str) -> DataFrame:
    """(keys, path, value): every value of a document that is not an object, as JSON, under its keys joined by dots.

    A level of nesting at a time, until no object is left. Arrays are values as a whole; empty objects, nulls in place
    of a document and what is not JSON give no rows.
    """
    parsed = F.try_parse_json(F.col("value"))
    level = df.select(*keys, F.lit("").alias("path"), F.col(document).cast("string").alias("value")).where(F.schema_of_variant(parsed).startswith("OBJECT"))
    found = []
    while True:
        inner = level.withColumn("_v", parsed).lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_v").outer()).select(F.col("key").alias("_key"), F.col("value").alias("_value")))
        path = F.when(F.col("path") == "", F.col("_key")).otherwise(F.concat_ws(".", "path", "_key"))
        level = written(inner.select(*keys, path.alias("path"), F.to_json("_value").alias("value"), F.schema_of_variant("_value").startswith("OBJECT").alias("_open")))
        found.append(level.where("not _open").drop("_open"))
        level = level.where("_open").drop("_open")
        if level.isEmpty():
            return reduce(DataFrame.union, found)


def changes(versions: DataFrame, keys: Sequence[str], before: str, after: str) -> DataFrame:
    """(keys, path, before, after, change): the leaves in which two documents of a row differ; keys must name a row."""
    old, new = (leaves(versions, keys, c).withColumnRenamed("value", name) for c, name in ((before, "before"), (after, "after")))
    both = old.join(new, [*keys, "path"], "full").where(~F.col("before").eqNullSafe(F.col("after")))
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return both.select(*keys, "path", "before", "after", kind.alias("change"))
