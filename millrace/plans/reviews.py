"""Queries that review and export: document changes, graphs as text, merged histories, batches and scalar forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import documents
from millrace.operators import graph as G
from millrace.operators import joins as J
from millrace.operators import windows as W
from millrace.plans.histories import tree_tasks
from millrace.plans.registry import SQL, event_k, query
from millrace.sources import sinks


@query("""
with d as (select event_id, user_id, ts, '"' || event_type || '"' as type, props->>'$.k' as k, case when cast(props->>'$.k' as bigint) % 3 = 0 then '"' || event_type || '"' end as note from events),
l as (select *, lag(event_id) over w as prior, lag(type) over w as type0, lag(k) over w as k0, lag(note) over w as note0 from d window w as (partition by user_id order by ts, event_id)),
p as (select event_id, unnest(['type', 'body.k', 'body.note']) as path, unnest([type0, k0, note0]) as before, unnest([type, k, note]) as after from l where prior is not null)
select event_id, path, before, after, case when before is null then 'added' when after is null then 'removed' else 'changed' end as change from p where before is distinct from after""")
def document_changes(t):
    k = event_k().cast("long")
    body = F.struct(k.alias("k"), F.when(k % 3 == 0, F.col("event_type")).alias("note"))
    rows = t.events.select("event_id", "user_id", "ts", F.to_json(F.struct(F.col("event_type").alias("type"), body.alias("body"))).alias("after"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    versions = rows.withColumn("before", F.lag("after").over(w)).where("before is not null")
    return documents.changes(versions.select("event_id", "before", "after"), ["event_id"], "before", "after")


@query()
def graph_exports(t):
    tasks, edges = tree_tasks(t)
    # Rows are dealt out by graph before their lines are made: lines are longer, and the join needs no shuffle then.
    charts = sinks.gantt(G.slack(tasks, edges).repartition("dag"), "dag", "task", "early_start", "duration").withColumnRenamed("text", "gantt")
    edges = edges.join(tasks.select("dag", F.col("task").alias("upstream")), ["dag", "upstream"], "left_semi")
    return sinks.dot(edges.repartition("dag"), "dag", "task", "upstream").withColumnRenamed("text", "dot").join(charts, "dag")


@query()
def schedule_profile(t):
    # One shuffle by graph serves both schedules: their sums, running sums and peaks stay within a graph.
    # As many parts as are set, not fewer by their size: each interval becomes two times twice.
    plan = G.slack(*tree_tasks(t))
    plan = plan.repartition(int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")), "dag")
    times = lambda late, start, end: F.struct(F.lit(late).alias("late"), F.col(start).alias("start"), F.col(end).alias("end"))
    both = plan.select("dag", F.inline(F.array(times(False, "early_start", "early_finish"), times(True, "late_start", "late_finish"))))
    of = lambda late, c: F.max(F.when(F.col("late") == late, F.col(c)))
    columns = [of(late, c).alias(f"{name}_{c}") for late, name in ((False, "early"), (True, "late")) for c in ("peak", "at")]
    return W.peak(both, ["dag", "late"], "start", "end").groupBy("dag").agg(*columns)


@query("""
with recursive n as (select l_orderkey as dag, l_linenumber as task, cast(max(l_quantity) as bigint) as d from lineitem group by 1, 2),
a as (select dag, task, task as before from n union all select a.dag, a.task, n.task from a join n on n.dag = a.dag and n.task = a.before // 2 where a.before > 1),
f as (select a.dag, x.task as changed, a.task, sum(n.d) as finish, sum(case when n.task = x.task then n.d // 2 else n.d end) as sooner from a join n on n.dag = a.dag and n.task = a.before join n x on x.dag = a.dag group by 1, 2, 3),
g as (select dag, changed as task, cast(max(finish) - max(sooner) as bigint) as gain from f group by 1, 2)
select dag, task, d as duration, gain, row_number() over (partition by dag order by gain desc, task) as place from g join n using (dag, task)""")
def whatif_gains(t):
    rows = G.gains(*tree_tasks(t), F.floor(F.col("duration") / 2).cast("long"))
    place = F.row_number().over(Window.partitionBy("dag").orderBy(F.desc("gain"), "task"))
    return rows.select("dag", "task", "duration", "gain", place.cast("long").alias("place"))


@query("""
select user_id % 4 as shard, event_type as sampler, arg_max(cast(props->>'$.k' as bigint), (ts, event_id)) as sample, max(ts) as sampled_at from events group by 1, 2""")
def gauge_samples(t):
    rows = t.events.select((F.col("user_id") % 4).alias("shard"), F.col("event_type").alias("sampler"), event_k().cast("long").alias("k"), "ts", "event_id")
    newest = rows.groupBy("shard", "sampler").agg(F.max_by("k", F.struct("ts", "event_id")).alias("sample"), F.max("ts").alias("sampled_at"))
    return sinks.written(newest)


@query("""
select event_id, user_id, event_type, ts from events where event_type <> 'click' or ts >= timestamp '2024-01-10'""")
def decision_purge(t):
    old = (F.col("event_type") == "click") & (F.col("ts") < F.lit("2024-01-10").cast("timestamp"))
    return t.events.where(~old).select("event_id", "user_id", "event_type", "ts")


def _graph_sql() -> dict[str, str]:
    from millrace.plans import catalog

    plan = catalog.SQL["dag_slack"]
    peak = lambda name, start: f"""
{name}e as (select dag, {start} as t, 1 as d from s union all select dag, {start} + duration, -1 from s),
{name}g as (select dag, t, d, sum(d) as step from {name}e group by 1, 2, 3),
{name}r as (select dag, t, sum(step) over (partition by dag order by t, d rows unbounded preceding) as running from {name}g),
{name}p as (select dag, cast(max(running) as bigint) as {name}_peak from {name}r group by 1),
{name}a as (select dag, min(t) as {name}_at, any_value({name}_peak) as {name}_peak from {name}r join {name}p using (dag) where running = {name}_peak group by 1)"""  # noqa: E731
    return {
        "schedule_profile": f"with s as ({plan}), {peak('early', 'early_start')}, {peak('late', 'early_start + slack')} select * from earlya join latea using (dag)",
        "graph_exports": f"""with s as ({plan}), n as (select distinct l_orderkey as dag, l_linenumber as task from lineitem),
e as (select n.dag, '  "' || (n.task // 2) || '" -> "' || n.task || '";' as line from n join n u on u.dag = n.dag and u.task = n.task // 2 where n.task > 1),
d as (select dag, 'digraph {{' || chr(10) || string_agg(line, chr(10) order by line) || chr(10) || '}}' as dot from e group by 1),
g as (select dag, 'gantt' || chr(10) || '  dateFormat X' || chr(10) || string_agg('  ' || task || ' :' || early_start || ', ' || duration || 's', chr(10) order by early_start, task) as gantt from s group by 1)
select * from d join g using (dag)""",
    }


SQL |= _graph_sql()


@query("""
select user_id % 4 as shard, event_id, event_type, ts from events where ts > timestamp '2024-01-02' or (ts = timestamp '2024-01-02' and event_id > 0) order by ts, event_id limit 501""")
def history_export(t):
    shards = [t.events.where(F.col("user_id") % 4 == i).select(F.lit(i).cast("long").alias("shard"), "event_id", "event_type", "ts") for i in range(4)]
    return J.merged_page(shards, ["ts", "event_id"], ["2024-01-02 00:00:00", 0], 500)


@query("""
with recursive w as (select o_orderkey as root, o_orderkey as id, cast(null as bigint) as parent, 0 as depth from orders where o_orderkey < 4
 union all select w.root, o.o_orderkey, w.id, w.depth + 1 from w join orders o on o.o_orderkey // 4 = w.id and o.o_orderkey <> w.id where w.depth < 2),
two as (select root, parent, string_agg(id, ',' order by id) as inside from w where depth = 2 group by 1, 2),
one as (select w.root, string_agg(w.id || coalesce('(' || inside || ')', ''), ',' order by w.id) as inside from w left join two on two.root = w.root and two.parent = w.id where depth = 1 group by 1)
select w.root, w.id || coalesce('(' || inside || ')', '') as tree from w left join one using (root) where depth = 0""")
def lineage_nested(t):
    runs = t.orders.select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_orderkey") / 4).alias("parent"))
    rows = J.run_tree(runs, t.orders.where("o_orderkey < 4").select(F.col("o_orderkey").alias("id")), "id", "parent", 2)
    return J.nested(rows.withColumn("parent", F.when(F.col("depth") > 0, F.floor(F.col("id") / 4))))


@query("""
with r as (select *, (row_number() over (order by o_orderdate, o_orderkey) - 1) // 500 as batch from orders)
select cast(batch as bigint) as batch, count(*) as n, min(o_orderkey) as least_key, max(o_orderdate) as until from r group by 1""")
def bounded_batches(t):
    cut = W.count_batches(t.orders.select("o_orderkey", "o_orderdate"), [], ["o_orderdate", "o_orderkey"], 500)
    return cut.groupBy("batch").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least_key"), F.max("o_orderdate").alias("until"))


@query("""
with c as (select o_custkey, o_orderkey, o_orderdate, cast(round(o_totalprice * 100) as bigint) // (1 + o_custkey % 3) as charge from orders),
s as (select *, cast(sum(charge) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding) as bigint) as finish, cast(sum(charge) over (partition by o_custkey) as bigint) as pass from c)
select o_custkey, o_orderkey, finish - charge as start, charge, pass - (select min(pass) from s) as ahead from s""")
def fair_charges(t):
    charge = F.floor(F.round(F.col("o_totalprice") * 100).cast("long") / (1 + F.col("o_custkey") % 3))
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", charge.alias("charge"))
    passes = rows.groupBy("o_custkey").agg(F.sum("charge").alias("pass"))
    least = passes.agg(F.min("pass").alias("least"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    started = rows.withColumn("start", F.coalesce(F.sum("charge").over(w), F.lit(0)))
    return started.join(passes, "o_custkey").crossJoin(least).select("o_custkey", "o_orderkey", "start", "charge", (F.col("pass") - F.col("least")).alias("ahead"))


@query("""
select o_orderkey, cast(epoch(o_orderdate) as bigint) as seconds, cast(epoch(o_orderdate) as bigint) // 604800 * 604800 as cohort, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as rfc3339,
 greatest(0, least(cast(epoch(o_orderdate) as bigint), 900000000)) as clamped,
 ((o_orderkey * 977) // 86400) || 'd' || ((o_orderkey * 977) % 86400 // 3600) || 'h' || ((o_orderkey * 977) % 3600 // 60) || 'm' || ((o_orderkey * 977) % 60) || 's' as spent,
 coalesce(nullif(o_orderstatus, 'P'), 'none') as state from orders""")
def time_scalars(t):
    at, n = W.seconds(F.col("o_orderdate")), F.col("o_orderkey") * 977
    part = lambda x: F.floor(x).cast("string")
    spent = F.concat(part(n / 86400), F.lit("d"), part(n % 86400 / 3600), F.lit("h"), part(n % 3600 / 60), F.lit("m"), part(n % 60), F.lit("s"))
    return t.orders.select(
        "o_orderkey", at.alias("seconds"), (F.floor(at / 604800) * 604800).alias("cohort"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("rfc3339"),
        F.greatest(F.lit(0), F.least(at, F.lit(900_000_000))).alias("clamped"), spent.alias("spent"), F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("none")).alias("state"),
    )


@query("""
with j as (select event_id, cast(props->>'$.k' as bigint) as k, to_json(range(0, cast(props->>'$.k' as bigint) % 5 + 1)) as items from events)
select event_id, k, cast(json_array_length(items) as bigint) as n, cast(list_sum(cast(items as bigint[])) as bigint) as total, cast(items->>'$[1]' as bigint) as second from j""")
def json_scalars(t):
    rows = t.events.select("event_id", event_k().cast("long").alias("k")).withColumn("items", F.to_json(F.sequence(F.lit(0), F.col("k") % 5)))
    each = F.from_json("items", "array<bigint>")
    return rows.select("event_id", "k", F.json_array_length("items").cast("long").alias("n"), F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.get_json_object("items", "$[1]").cast("long").alias("second"))
