"""Streaming sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def files(spark: SparkSession, folder: str, schema: StructType, per_trigger: int = 1000) -> DataFrame:
    """New Parquet files of a folder, so many a trigger at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def kafka(spark: SparkSession, servers: str, topics: str, per_trigger: int = 1_000_000) -> DataFrame:
    """Messages (key, value, topic, partition, offset, timestamp, headers); Spark keeps the offsets in the checkpoint."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topics, "maxOffsetsPerTrigger": per_trigger, "includeHeaders": "true"}
    return spark.readStream.format("kafka").options(**options).load()
