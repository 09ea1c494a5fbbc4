from pyspark.sql import functions as F

from millrace.operators import windows as W
from millrace.plans import catalog
from millrace.plans.histories import tree_tasks
from millrace.sources.tables import Tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_schedule_profile_is_one_shuffle(spark, data):
    assert plan_of(catalog.QUERIES["schedule_profile"](spark, data)).count("Exchange hashpartitioning") == 1


def test_sweep_reads_intervals_once(spark, data):
    rows = Tables(spark, data).events.select("user_id", F.col("event_id").alias("s"), (F.col("event_id") + 2).alias("e"))
    assert plan_of(W.sweep(rows, ["user_id"], "s", "e")).count("Scan parquet") == 1


def test_sweep_takes_ends_of_another_type(spark):
    got = W.sweep(spark.sql("select 'g' as g, 1 as s, cast(3 as long) as e"), ["g"], "s", "e").collect()
    assert sorted(tuple(r) for r in got) == [("g", 1, 1, 1), ("g", 3, -1, 0)]
