"""More queries of the catalog: single histories, gauges, lints, throttles, graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import fingerprint, forecast
from millrace.operators import aggregates as A
from millrace.operators import filters as P
from millrace.operators import graph as G
from millrace.operators import joins as J
from millrace.operators import windows as W
from millrace.plans.registry import SQL, event_k, query
from millrace.sources.sinks import written


@query("""
select l_orderkey, l_linenumber, l_shipdate, o_totalprice from lineitem join orders on l_orderkey = o_orderkey where l_linestatus = 'O' and o_orderpriority = '1-URGENT'
order by l_shipdate, o_totalprice desc, l_orderkey, l_linenumber limit 100""")
def handoff_list(t):
    runs = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    open_ = t.lineitem.where("l_linestatus = 'O'").select("l_orderkey", "l_linenumber", "l_shipdate").join(runs, "l_orderkey")
    return open_.orderBy(F.asc("l_shipdate"), F.desc("o_totalprice"), "l_orderkey", "l_linenumber").limit(100)


@query("select c_custkey, c_name, c_acctbal < 0 as deleted from customer where c_custkey > 40 and c_acctbal >= -500 order by c_custkey limit 1000")
def entity_list(t):
    rows = t.customer.where((F.col("c_custkey") > 40) & (F.col("c_acctbal") >= -500)).orderBy("c_custkey").limit(1000)
    return rows.select("c_custkey", "c_name", (F.col("c_acctbal") < 0).alias("deleted"))


@query("select event_id, case when json_type(props, '$.k') in ('UBIGINT', 'BIGINT') then cast(props->>'$.k' as bigint) end as k from events where event_type = 'purchase'")
def typed_payloads(t):
    number = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return t.events.where("event_type = 'purchase'").select("event_id", F.when(P.attribute("props", "k", "gte", -1e18), number).alias("k"))


@query("""
select o_custkey, count(*) as n from orders group by 1 having bool_and(o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM')) and bool_or(o_orderstatus = 'F')""")
def all_requirements_met(t):
    sets = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.collect_set("o_orderpriority").alias("p"), F.collect_set("o_orderstatus").alias("s"))
    urgent = F.forall("p", lambda x: x.isin("1-URGENT", "2-HIGH", "3-MEDIUM"))
    return sets.where(urgent & F.exists("s", lambda x: x == "F")).select("o_custkey", "n")


@query("select p_partkey, p_name, substr(p_name, 7) as rest from part where p_name like 'small%' and not p_type like 'ECON%'")
def canary_rows(t):
    rows = t.part.where(F.col("p_name").startswith("small") & ~F.col("p_type").startswith("ECON"))
    return rows.select("p_partkey", "p_name", F.substring("p_name", 7, 1000).alias("rest"))


@query("select page_id, cast(strlen(html) as bigint) as bytes, strlen(html) > 2000 as large from pages")
def payload_sizes(t):
    size = F.octet_length("html").cast("long")
    return t.pages.select("page_id", size.alias("bytes"), (size > 2000).alias("large"))


@query("select s_suppkey, regexp_full_match(s_name, '[A-Za-z]+#[0-9]{9}') and length(s_name) <= 64 as valid, s_acctbal between 0.001 and 1000 as weight_ok from supplier")
def key_checks(t):
    valid = F.col("s_name").rlike("^[A-Za-z]+#[0-9]{9}$") & (F.length("s_name") <= 64)
    return t.supplier.select("s_suppkey", valid.alias("valid"), F.col("s_acctbal").between(0.001, 1000).alias("weight_ok"))


@query("""
with q as (select distinct o_orderpriority as queue from orders), k as (select distinct o_orderstatus as kind from orders),
c as (select o_orderpriority as queue, o_orderstatus as kind, count(*) as n from orders where o_totalprice > 400000 group by 1, 2)
select q.queue, k.kind, coalesce(n, 0) as n from q cross join k left join c on c.queue = q.queue and c.kind = k.kind""")
def queue_heads(t):
    # Both sides are the few different names of queues and kinds.
    heads = t.orders.select(F.col("o_orderpriority").alias("queue")).distinct().crossJoin(t.orders.select(F.col("o_orderstatus").alias("kind")).distinct())
    counts = t.orders.where("o_totalprice > 400000").groupBy(F.col("o_orderpriority").alias("queue"), F.col("o_orderstatus").alias("kind")).agg(F.count("*").alias("n"))
    return heads.join(counts, ["queue", "kind"], "left").select("queue", "kind", F.coalesce("n", F.lit(0)).alias("n"))


@query("""
with r as (select l_orderkey, cast(sum(cast(l_quantity as bigint)) as bigint) as tokens from lineitem group by 1), a as (select cast(sum(tokens) as bigint) as total from r)
select l_orderkey, tokens, total from r cross join a where tokens > 200""")
def run_against_fleet(t):
    runs = t.lineitem.groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("tokens"))
    return runs.where("tokens > 200").crossJoin(runs.agg(F.sum("tokens").alias("total")))


@query("select event_type as name, count(*) as n, min(ts) as first_ts from events where value >= 50 group by 1")
def buffered_signals(t):
    return t.events.where("value >= 50").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))


@query("""
select l_orderkey, count(*) filter (where l_returnflag <> 'R') as succeeded, count(*) filter (where l_returnflag = 'R') as failed,
 count(*) filter (where l_returnflag = 'R') * 3 <= count(*) as tolerated from lineitem group by 1""")
def fan_out_results(t):
    failed = F.count_if(F.col("l_returnflag") == "R")
    return t.lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") != "R").alias("succeeded"), failed.alias("failed"), (failed * 3 <= F.count("*")).alias("tolerated"))


@query("""
with b as (select cast(floor(epoch(ts) / 86400) * 86400 as bigint) as bucket, event_type, user_id, row_number() over (partition by user_id, event_type, floor(epoch(ts) / 86400) order by ts, event_id) as try from events)
select bucket, count(*) as attempts, count(*) filter (where try > 1) as retries, count(*) filter (where event_type = 'error') as failures, round(count(*) / count(*) filter (where try = 1), 6) as ratio from b group by 1""")
def storm_buckets(t):
    rows = A.buckets(t.events, "ts", 86400)
    w = Window.partitionBy("user_id", "event_type", "bucket").orderBy("ts", "event_id")
    rows = rows.withColumn("try", F.row_number().over(w))
    return rows.groupBy("bucket").agg(F.count("*").alias("attempts"), F.count_if(F.col("try") > 1).alias("retries"), F.count_if(F.col("event_type") == "error").alias("failures"), F.round(F.count("*") / F.count_if(F.col("try") == 1), 6).alias("ratio"))


@query("""
with r as (select o_orderpriority as queue, o_orderkey, cast(substr(o_orderpriority, 1, 1) as bigint) + cast(floor((epoch(timestamp '2001-09-01') - epoch(o_orderdate)) / 864000) as bigint) as priority, o_orderdate from orders where o_orderstatus = 'P')
select queue, o_orderkey, priority, row_number() over (partition by queue order by priority desc, o_orderdate, o_orderkey) as rn from r qualify rn <= 32""")
def claim_candidates(t):
    waited = W.seconds(F.lit("2001-09-01 00:00:00")) - W.seconds(F.col("o_orderdate"))
    aged = forecast.aged_priority(F.substring("o_orderpriority", 1, 1).cast("long"), waited, 864000).cast("long")
    rows = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderpriority").alias("queue"), "o_orderkey", aged.alias("priority"), "o_orderdate")
    got = J.top_k(rows, ["queue"], [F.desc("priority"), F.asc("o_orderdate"), F.asc("o_orderkey")], 32)
    return got.select("queue", "o_orderkey", "priority", F.col("rn").cast("long").alias("rn"))


@query("select o_orderpriority as queue, arg_min(o_orderkey, (round(o_totalprice / 1000), o_orderdate, o_orderkey)) as pick from orders where o_orderstatus = 'P' group by 1")
def fair_pick(t):
    rank = F.struct(F.round(F.col("o_totalprice") / 1000).alias("lag"), F.col("o_orderdate").alias("due"), F.col("o_orderkey").alias("i"))
    return t.orders.where("o_orderstatus = 'P'").groupBy(F.col("o_orderpriority").alias("queue")).agg(F.min_by("o_orderkey", rank).alias("pick"))


@query("""
with p as (select c_custkey, max(o_orderdate) filter (where o_orderstatus = 'F') as last_pass, min(o_orderdate) as oldest from customer left join orders on o_custkey = c_custkey group by 1)
select c_custkey, last_pass, oldest from p order by last_pass nulls first, oldest nulls first, c_custkey limit 25""")
def due_agents(t):
    rows = t.customer.select("c_custkey").join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    passes = rows.groupBy("c_custkey").agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("last_pass"), F.min("o_orderdate").alias("oldest"))
    return passes.orderBy(F.asc_nulls_first("last_pass"), F.asc_nulls_first("oldest"), "c_custkey").limit(25)


@query("select l_orderkey as run from lineitem where l_shipdate > timestamp '2001-10-20' union select o_orderkey from orders where o_orderdate > timestamp '2001-07-25'")
def expiries(t):
    late = t.lineitem.where("l_shipdate > timestamp '2001-10-20'").select(F.col("l_orderkey").alias("run"))
    return late.unionByName(t.orders.where("o_orderdate > timestamp '2001-07-25'").select(F.col("o_orderkey").alias("run"))).distinct()


@query("""
with r as (select user_id, event_id, epoch_us(ts) as came, row_number() over (partition by user_id order by ts, event_id) as rn from events),
s as (select user_id, event_id, came, rn * 3600000000 + max(came - rn * 3600000000) over (partition by user_id order by rn rows unbounded preceding) as start_us from r)
select user_id, event_id, cast(start_us as bigint) as start_us, start_us - came > 10800000000 as dropped from s""")
def start_throttle(t):
    # First in, first out at one start an hour: a start waits for the one before it, which is a running maximum.
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t.events.select("user_id", "event_id", "ts", W.micros(F.col("ts")).alias("at"), (F.row_number().over(w) * F.lit(3_600_000_000)).alias("slot"))
    ahead = F.max(F.col("at") - F.col("slot")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("start_us", F.col("slot") + ahead)
    return rows.select("user_id", "event_id", "start_us", (F.col("start_us") - F.col("at") > 10_800_000_000).alias("dropped"))


@query("""
select s.user_id, s.event_id from events s where s.event_type = 'click' and s.value > 5 and not exists
(select 1 from events e where e.event_type = 'view' and e.user_id = s.user_id and e.props->>'$.k' = s.props->>'$.k')""")
def outbox_pending(t):
    rows = t.events.withColumn("request", event_k())
    asked = rows.where((F.col("event_type") == "click") & (F.col("value") > 5))
    return J.without(asked, rows.where("event_type = 'view'").select("user_id", "request").distinct(), ["user_id", "request"]).select("user_id", "event_id")


@query("""
select user_id, count(*) filter (where event_type = 'error') as failures, count(*) filter (where value < 0.5) as short_timers, count(*) filter (where event_type = 'error') > 12 as failing from events group by 1""")
def history_lint(t):
    errors = F.count_if(F.col("event_type") == "error")
    return t.events.groupBy("user_id").agg(errors.alias("failures"), F.count_if(F.col("value") < 0.5).alias("short_timers"), (errors > 12).alias("failing"))


@query("""
select l_orderkey as dag, count(*) as fan_out, count(*) - count(distinct l_linenumber) as duplicate_names, count(*) filter (where l_discount = 0) as without_retry from lineitem group by 1
having count(*) > 6 or count(*) > count(distinct l_linenumber)""")
def graph_lint(t):
    got = t.lineitem.groupBy(F.col("l_orderkey").alias("dag")).agg(F.count("*").alias("fan_out"), (F.count("*") - F.countDistinct("l_linenumber")).alias("duplicate_names"), F.count_if(F.col("l_discount") == 0).alias("without_retry"))
    return got.where("fan_out > 6 or duplicate_names > 0")


@query("""
with s as (select o_custkey, string_agg(o_orderstatus, '>' order by o_orderdate, o_orderkey) as shape from orders where o_orderdate >= timestamp '2001-01-01' group by 1),
c as (select shape, count(*) as n from s group by 1)
select o_custkey, n as seen, n * 20 <= (select count(*) from s) as rare from s join c using (shape)""")
def shape_judge(t):
    runs = A.shapes(t.orders.where("o_orderdate >= timestamp '2001-01-01'"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus")
    census = runs.groupBy("shape").agg(F.count("*").alias("seen"))
    return runs.join(census, "shape").crossJoin(census.agg(F.sum("seen").alias("total"))).select("o_custkey", "seen", (F.col("seen") * 20 <= F.col("total")).alias("rare"))


@query("""
with p as (select user_id, event_id, cast(props->>'$.k' as bigint) as after, lag(cast(props->>'$.k' as bigint)) over (partition by user_id order by ts, event_id) as before from events where event_type = 'view')
select user_id, event_id, before, after from p where before is not null and before is distinct from after""")
def payload_changes(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t.events.where("event_type = 'view'").select("user_id", "event_id", "ts", event_k().cast("long").alias("after"))
    rows = rows.withColumn("before", F.lag("after").over(w))
    return rows.where(F.col("before").isNotNull() & P.changed(F.col("before"), F.col("after"))).select("user_id", "event_id", "before", "after")


@query("select user_id, sha256(string_agg(event_type || ':' || event_id, ',' order by event_id)) as fingerprint, count(*) as n from events group by 1")
def history_fingerprints(t):
    parts = F.array_sort(F.collect_list(F.struct("event_id", "event_type")))
    text = F.array_join(F.transform(parts, lambda e: F.concat(e.event_type, F.lit(":"), e.event_id.cast("string"))), ",")
    return t.events.groupBy("user_id").agg(F.sha2(text, 256).alias("fingerprint"), F.count("*").alias("n"))


@query("""
with s as (select o_custkey, string_agg(o_orderstatus, '>' order by o_orderdate, o_orderkey) as shape from orders group by 1),
d as (select distinct shape, flatten(list_transform(string_split(shape, '>'), lambda x: [ascii(x), 0])) as bytes from s),
f as (select shape, list_reduce(list_prepend(14695981039346656037::hugeint, list_transform(bytes, lambda x: x::hugeint)),
  lambda h, b: ((h - h % 256 + xor((h % 256)::int, b::int)) * 1099511628211) % 18446744073709551616) as h from d)
select o_custkey, shape, lower(lpad(hex(h::ubigint), 16, '0')) as fingerprint from s join f using (shape)""")
def shape_fingerprints(t):
    runs = A.shapes(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus")
    return fingerprint.sequence_fingerprints(runs, "shape", "fingerprint").select("o_custkey", "shape", "fingerprint")


@query("""
select p_brand, l_orderkey, l_linenumber from lineitem join part on l_partkey = p_partkey where l_returnflag = 'R'
qualify row_number() over (partition by p_brand order by l_shipdate, l_orderkey, l_linenumber, l_partkey) <= 25""")
def reconcile_candidates(t):
    rows = t.lineitem.where("l_returnflag = 'R'").join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return J.top_k(rows, ["p_brand"], [F.asc(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")], 25).select("p_brand", "l_orderkey", "l_linenumber")


@query("""
select o_custkey, max(o_orderdate) + interval 200 day as next_fire, count(*) filter (where o_orderstatus = 'P') as running from orders group by 1
having max(o_orderdate) + interval 200 day < timestamp '2001-09-01' and count(*) filter (where o_orderstatus = 'P') < 5""")
def overdue_schedules(t):
    got = t.orders.groupBy("o_custkey").agg((F.max("o_orderdate") + F.expr("interval 200 days")).alias("next_fire"), F.count_if(F.col("o_orderstatus") == "P").alias("running"))
    return got.where("next_fire < timestamp '2001-09-01' and running < 5")


@query("""
with s as (select o_orderkey, o_orderstatus as state, o_orderdate as started, max(l_shipdate) as completed from orders join lineitem on l_orderkey = o_orderkey group by 1, 2, 3)
select *, cast(epoch(completed) - epoch(started) as bigint) as seconds from s where completed > timestamp '2000-01-01' or (completed = timestamp '2000-01-01' and o_orderkey > 9)
order by completed, o_orderkey limit 200""")
def summaries_page(t):
    items = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("completed"))
    runs = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("state"), F.col("o_orderdate").alias("started")).join(items, "o_orderkey")
    runs = runs.withColumn("seconds", W.seconds(F.col("completed")) - W.seconds(F.col("started")))
    return J.page(runs.where(J.next_of("completed", "o_orderkey", "2000-01-01 00:00:00", 9)), [F.asc("completed"), F.asc("o_orderkey")], 199)


@query("""
with a as (select p_brand || '/' || p_type as path, min(p_size) as kind from part where p_partkey % 2 = 0 group by 1), b as (select p_brand || '/' || p_type as path, min(p_size) as kind from part where p_partkey % 2 = 1 group by 1)
select coalesce(a.path, b.path) as path, a.kind as before, b.kind as after from a full join b on a.path = b.path where a.kind is distinct from b.kind""")
def contract_diff(t):
    side = lambda n, name: t.part.where(F.col("p_partkey") % 2 == n).groupBy(F.concat_ws("/", "p_brand", "p_type").alias("path")).agg(F.min("p_size").alias(name))
    return side(0, "before").join(side(1, "after"), "path", "full").where(P.changed(F.col("before"), F.col("after")))


@query("""
select l_orderkey, count(*) as sessions, max(l_linenumber) as planned, count(*) = max(l_linenumber) as complete from lineitem group by 1""")
def ledger_identity(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("sessions"), F.max("l_linenumber").alias("planned"), (F.count("*") == F.max("l_linenumber")).alias("complete"))


@query("select l_orderkey as root, arg_max(l_linenumber, (l_extendedprice, -l_linenumber, -l_partkey)) as best, max(l_extendedprice) as score from lineitem group by 1")
def best_of_n(t):
    rank = F.struct(F.col("l_extendedprice").alias("a"), (-F.col("l_linenumber")).alias("b"), (-F.col("l_partkey")).alias("c"))
    return t.lineitem.groupBy(F.col("l_orderkey").alias("root")).agg(F.max_by("l_linenumber", rank).alias("best"), F.max("l_extendedprice").alias("score"))


@query("""
with l as (select conv_id, turn, sha256(role || text) as link, lag(sha256(role || text)) over (partition by conv_id order by turn) as previous, lag(turn) over (partition by conv_id order by turn) as before from conversations)
select conv_id, turn, sha256(coalesce(previous, '') || link) as chained, coalesce(turn = before + 1, turn = 0) as unbroken from l""")
def audit_links(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t.conversations.select("conv_id", "turn", F.sha2(F.concat("role", "text"), 256).alias("link"))
    return rows.select("conv_id", "turn", F.sha2(F.concat(F.coalesce(F.lag("link").over(w), F.lit("")), "link"), 256).alias("chained"), F.coalesce(F.col("turn") == F.lag("turn").over(w) + 1, F.col("turn") == 0).alias("unbroken"))


@query("""
with s as (select o_custkey as schedule, unnest(generate_series(o_orderdate, o_orderdate + interval 4 day, interval 2 day)) as fires from orders)
select cast(fires as date) as day, count(*) as fires, count(distinct schedule) as schedules from s group by 1 having count(distinct schedule) >= 20""")
def interval_slots(t):
    slots = t.orders.select(F.col("o_custkey").alias("schedule"), F.explode(F.expr("sequence(cast(o_orderdate as date), cast(o_orderdate as date) + 4, interval 2 days)")).alias("day"))
    return slots.groupBy("day").agg(F.count("*").alias("fires"), F.countDistinct("schedule").alias("schedules")).where("schedules >= 20")


@query("""
with b as (select user_id, ts, event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) over w) >= 7200000000, true) as far from events window w as (partition by user_id order by ts, event_id)),
i as (select *, sum(case when far then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as island from b)
select user_id, min(ts) as start, max(ts) + interval 2 hour as end_ts, count(*) as n from i group by user_id, island""")
def user_sessions(t):
    w = F.session_window(F.col("ts").cast("timestamp"), "2 hours").alias("w")
    return t.events.groupBy("user_id", w).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end_ts"), "n")


@query("select l_suppkey as lock_id, l_orderkey, l_linenumber, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_shipdate) as place from lineitem where l_linestatus = 'O'")
def lock_order(t):
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return t.lineitem.where("l_linestatus = 'O'").select(F.col("l_suppkey").alias("lock_id"), "l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("place"))


def tree_tasks(t):
    """Tasks, and their edges to upstreams of which some are no tasks."""
    tasks = written(t.lineitem.groupBy(F.col("l_orderkey").alias("dag"), F.col("l_linenumber").alias("task")).agg(F.max("l_quantity").cast("long").alias("duration")))
    return tasks, tasks.where("task > 1").select("dag", "task", F.floor(F.col("task") / 2).cast("int").alias("upstream"))


@query("""
with recursive n as (select l_orderkey as dag, l_linenumber as task, cast(max(l_quantity) as bigint) as d from lineitem group by 1, 2),
es as (select dag, task, d, cast(0 as bigint) as es, cast(task as varchar) as path from n where task = 1 or not exists (select 1 from n x where x.dag = n.dag and x.task = n.task // 2)
 union all select n.dag, n.task, n.d, es.es + es.d, es.path || '>' || n.task from es join n on n.dag = es.dag and n.task // 2 = es.task and n.task > 1)
select dag, max(es + d) as makespan, arg_max(path, (es + d, -task)) as critical, cast(sum(d) as bigint) as task_time from es group by 1""")
def critical_paths(t):
    tasks, edges = tree_tasks(t)
    ways = G.longest_paths(tasks, edges.withColumnRenamed("task", "downstream"), "upstream", "downstream", ("path",))
    found = ways.join(tasks, ["dag", "task"]).withColumn("finish", F.col("at") + F.col("duration"))
    # Of several ways as long, that to the smallest task.
    first = F.struct(F.col("finish").alias("f"), (-F.col("task")).alias("t"))
    path = F.array_join(F.transform("path", lambda x: x.cast("string")), ">")
    return found.groupBy("dag").agg(F.max("finish").alias("makespan"), F.max_by(path, first).alias("critical"), F.sum("duration").alias("task_time"))


@query()
def slack_summary(t):
    got = G.slack(*tree_tasks(t))
    return got.groupBy("dag").agg(F.count_if(F.col("slack") == 0).alias("critical_tasks"), F.max("slack").alias("most_slack"), F.max_by("task", F.struct(F.col("slack").alias("s"), (-F.col("task")).alias("t"))).alias("most_flexible"))


def _slack_sql() -> str:
    from millrace.plans import catalog

    return f"with s as ({catalog.SQL['dag_slack']}) select dag, count(*) filter (where slack = 0) as critical_tasks, max(slack) as most_slack, arg_max(task, (slack, -task)) as most_flexible from s group by 1"


SQL["slack_summary"] = _slack_sql()
