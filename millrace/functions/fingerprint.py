"""Order-sensitive fingerprints of event sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the 64-bit FNV-1a hash: the offset, which is also the hash of nothing, and the prime.
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3


TWO_64 = 1 << 64


def fnv1a(data: Column) -> Column:
    """The FNV-1a hash of a binary column in 16 hex digits, by exact arithmetic on decimals, a byte at a time."""
    exact = lambda n: F.lit(str(n)).cast("decimal(20,0)")
    digits = F.hex(data)
    byte = F.transform(F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2))).otherwise(F.array().cast("array<int>")), lambda i: F.conv(F.substr(digits, i, F.lit(2)), 16, 10).cast("int"))

    def step(h: Column, b: Column) -> Column:
        low = (h % 256).cast("int")
        mixed = (h - low + low.bitwiseXOR(b)).cast("decimal(20,0)")
        return (mixed * F.lit(str(FNV_PRIME)).cast("decimal(14,0)") % exact(TWO_64)).cast("decimal(20,0)")

    h = F.aggregate(byte, exact(FNV_OFFSET), step)
    half = lambda x: F.lpad(F.lower(F.hex(x.cast("long"))), 8, "0")
    return F.concat(half(F.floor(h / exact(1 << 32))), half(h % exact(1 << 32)))


def sequence_fingerprints(shapes: DataFrame, shape: str, out: str) -> DataFrame:
    """shapes with the FNV-1a hash, in hex, of a sequence of names, each followed by a zero byte.

    ``shape`` holds the names in order, joined by '>'. Each different sequence is hashed once.
    """
    named = F.when(F.col(shape) == "", F.lit("")).otherwise(F.concat(F.replace(F.col(shape), F.lit(">"), F.lit("\0")), F.lit("\0")))
    different = shapes.select(shape).distinct().withColumn(out, fnv1a(F.encode(named, "utf-8")))
    return shapes.join(different, shape)
