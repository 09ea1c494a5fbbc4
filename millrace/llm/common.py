"""What the operators share: the cluster's shared folder, and results written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

from millrace.operators.arrow import map_arrow  # noqa: F401  the operators take it from here


def shared_dir(spark: SparkSession) -> str:
    """A new path under the folder that the cluster names in spark.checkpoint.dir.

    Only where that setting is empty on a local master a temporary folder takes its place; on a cluster it must be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/millrace-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back.

    Later steps survive the loss of any executor without running the earlier ones again, and see plain scans.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; lower() would also change letters beyond ASCII."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


#: Bytes up to which a table is broadcast.
BROADCAST_BYTES = 256 << 20


def small(df: DataFrame, bound: int) -> DataFrame:
    """Marks df for broadcast if it has at most ``bound`` rows and BROADCAST_BYTES by count; beyond that it joins by shuffle."""
    wide = [f.name for f in df.schema if isinstance(f.dataType, (StringType, BinaryType, ArrayType, StructType, MapType))]
    fixed = F.lit(16 * (len(df.columns) - len(wide)))
    size = sum((F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{c}`")))), F.lit(0)) for c in wide), fixed)
    n, size = df.limit(bound + 1).agg(F.count("*"), F.sum(size.cast("long"))).first()
    return F.broadcast(df) if n <= bound and (size or 0) <= BROADCAST_BYTES else df
