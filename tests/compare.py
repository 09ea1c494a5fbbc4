"""Results of Spark and DuckDB as sorted rows of plain values."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if "float" in type(v).__name__:
        return repr(round(float(v), 6)) if float(v) % 1 else str(int(v))
    return str(v)


def rows(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted(tuple(plain(v) for v in r) for r in pdf.itertuples(index=False))
