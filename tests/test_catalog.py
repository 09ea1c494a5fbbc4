import pytest

from millrace.plans import catalog
from tests.compare import connect, rows


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_duckdb(spark, data, name):
    ours = catalog.QUERIES[name](spark, data).toPandas()
    theirs = connect(data).sql(catalog.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_fnv1a_of_known_values(spark):
    from pyspark.sql import functions as F

    from millrace.functions.fingerprint import FNV_OFFSET, fnv1a

    got = spark.createDataFrame([("",), ("a",), ("foobar",)], "s string").select(fnv1a(F.encode("s", "utf-8"))).collect()
    assert [int(r[0], 16) for r in got] == [FNV_OFFSET, 0xAF63DC4C8601EC8C, 0x85944171F73967E8]
