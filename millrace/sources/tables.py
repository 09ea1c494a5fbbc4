"""Batch sources: a folder of Parquet tables, and JDBC tables read in ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """Tables of a folder by name, each read when it is asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")


def jdbc(spark: SparkSession, url: str, table: str, by: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """A database table in ``parts`` ranges of a numeric column, so that executors read it side by side."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=by, lowerBound=lower, upperBound=upper, numPartitions=parts)
    return reader.options(**options).load()
