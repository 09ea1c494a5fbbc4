"""Queries over the driver's tables, by name, each with the same query as SQL for DuckDB.

Orders stand for runs, line items for their ledger, events for the event log, customers for tenants, parts for queues,
suppliers for workers and conversations for transcripts. Every query reads whole tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import forecast, text
from millrace.operators import aggregates as A
from millrace.operators import filters as P
from millrace.operators import graph as G
from millrace.operators import joins as J
from millrace.operators import windows as W
from millrace.plans.registry import QUERIES, SQL, event_k, query

__all__ = ["QUERIES", "SQL"]

# Counts, filters, pages


@query("""
with c as (select o_orderstatus || '/' || o_orderpriority as k, count(*) as n from orders group by 1),
r as (select *, row_number() over (order by n desc, k) as rn from c)
select case when rn <= 5 then k else '_other' end as k, cast(sum(n) as bigint) as n from r group by 1""")
def count_by_state_topn(t):
    counts = t.orders.groupBy(F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("k")).agg(F.count("*").alias("n"))
    return A.top_n_other(counts, "k", 5)


@query("""
select c_nationkey as shard, o_orderstatus as state, count(*) as n from orders join customer on o_custkey = c_custkey group by 1, 2
union all select -1, o_orderstatus, count(*) from orders join customer on o_custkey = c_custkey group by 2""")
def count_by_shard(t):
    runs = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("shard")), "o_custkey")
    by = A.grouped_count(runs.withColumnRenamed("o_orderstatus", "state"), ["shard", "state"])
    return by.union(by.groupBy("state").agg(F.sum("n").alias("n")).select(F.lit(-1).alias("shard"), "state", "n"))


@query("""
select event_id, user_id, event_type, cast(props->>'$.k' as bigint) as k from events
where cast(props->>'$.k' as bigint) >= 40 and (event_type = 'error' or cast(props->>'$.k' as bigint) in (41, 77)) and not value < 2""")
def filter_attributes(t):
    rows = t.events.where(P.all_of(P.attribute("props", "k", "gte", 40), P.any_of(F.col("event_type") == "error", P.attribute("props", "k", "in", [41, 77])), ~(F.col("value") < 2)))
    return rows.select("event_id", "user_id", "event_type", event_k().cast("long").alias("k"))


@query("""
select o_orderkey, o_orderstatus, o_orderdate from orders
where o_orderstatus in ('O', 'P') and o_orderdate >= timestamp '1996-01-01' and o_orderdate <= timestamp '1997-06-30'""")
def active_runs_between(t):
    active = P.state_group("o_orderstatus", "active", terminal=["F"])
    bounds = P.between("o_orderdate", "1996-01-01 00:00:00", "1997-06-30 00:00:00")
    return t.orders.where(active & bounds).select("o_orderkey", "o_orderstatus", "o_orderdate")


@query("""
select l_orderkey, l_linenumber, l_shipdate, l_quantity from lineitem
where l_shipdate >= timestamp '1997-01-01' and l_shipdate < timestamp '1997-02-01'""")
def ledger_between(t):
    return t.lineitem.where(P.half_open("l_shipdate", "1997-01-01 00:00:00", "1997-02-01 00:00:00")).select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")


@query("""
select o_orderkey, o_orderdate from orders where o_orderdate > timestamp '1996-06-01' or (o_orderdate = timestamp '1996-06-01' and o_orderkey > 500)
order by o_orderdate, o_orderkey limit 51""")
def keyset_page(t):
    rows = t.orders.where(J.next_of("o_orderdate", "o_orderkey", "1996-06-01 00:00:00", 500)).select("o_orderkey", "o_orderdate")
    return J.page(rows, [F.asc("o_orderdate"), F.asc("o_orderkey")], 50)


@query("""
select o_orderkey, o_orderdate from orders where o_orderdate < timestamp '1996-06-01' or (o_orderdate = timestamp '1996-06-01' and o_orderkey < 500)
order by o_orderdate desc, o_orderkey desc limit 51""")
def keyset_page_back(t):
    rows = t.orders.where(J.previous_of("o_orderdate", "o_orderkey", "1996-06-01 00:00:00", 500)).select("o_orderkey", "o_orderdate")
    return J.page(rows, [F.desc("o_orderdate"), F.desc("o_orderkey")], 50)


@query("""
with r as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) as rn,
  count(*) over (partition by user_id) as total, max(event_id) over (partition by user_id) as last_id
  from events where event_type in ('click', 'error'))
select user_id, event_id, event_type, total, last_id, total > 5 as has_next from r where rn <= 5""")
def history_page(t):
    rows = t.events.where(P.one_of("event_type", ["click", "error"]))
    totals = rows.groupBy("user_id").agg(F.count("*").alias("total"), F.max("event_id").alias("last_id"))
    first = J.top_k(rows, ["user_id"], [F.asc("event_id")], 5)
    return first.join(totals, "user_id").select("user_id", "event_id", "event_type", "total", "last_id", (F.col("total") > 5).alias("has_next"))


@query("select user_id, count(*) as n_events from events group by 1 having count(*) >= 60")
def history_at_least_n(t):
    return P.at_least(t.events, "user_id", 60)


@query("select count(*) as n, max(event_id) as last_id, min(ts) as first_ts from events")
def history_totals(t):
    return t.events.agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"), F.min("ts").alias("first_ts"))


@query("""
select o_orderkey, o_orderstatus, o_orderdate + interval 90 day as deadline from orders o left join
(select l_orderkey, max(l_shipdate) as done from lineitem group by 1) l on l_orderkey = o_orderkey
where o_orderstatus <> 'P' and o_orderdate + interval 90 day < coalesce(done, timestamp '1999-01-01')""")
def sla_breaches(t):
    done = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("done"))
    runs = t.orders.join(done, "o_orderkey", "left").withColumn("deadline", F.col("o_orderdate") + F.expr("interval 90 days"))
    late = P.breached("deadline", "done", F.col("o_orderstatus") == "P", "1999-01-01 00:00:00")
    return runs.where(late).select("o_orderkey", "o_orderstatus", "deadline")


@query("""
select s_suppkey, n_name from supplier join nation on s_nationkey = n_nationkey
where n_name in ('NATION_3', 'NATION_7', 'NATION_11') and s_acctbal is distinct from 0""")
def capable_workers(t):
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.withColumn("labels", F.create_map(F.lit("nation"), "n_name", F.lit("name"), "s_name"))
    return rows.where(P.meets("labels", {"nation": ["NATION_3", "NATION_7", "NATION_11"]}) & P.changed(F.col("s_acctbal"), F.lit(0.0))).select("s_suppkey", "n_name")


# Markers and gates


@query("""
with m as (select distinct user_id, event_type, cast(props->>'$.k' as bigint) as version from events
  where regexp_full_match(props->>'$.k', '[0-9]{1,18}'))
select event_type, version, count(*) filter (where c_acctbal >= 0) as active, count(*) filter (where c_acctbal < 0) as terminal,
  min(user_id) as first_run, max(user_id) as last_run
from m join customer on user_id = c_custkey group by 1, 2""")
def version_usage(t):
    marks = t.events.select("user_id", "event_type", P.guarded_int(event_k()).alias("version")).where("version is not null").dropDuplicates()
    runs = t.customer.select(F.col("c_custkey").alias("user_id"), "c_acctbal")
    return marks.join(runs, "user_id").groupBy("event_type", "version").agg(F.count_if(F.col("c_acctbal") >= 0).alias("active"), F.count_if(F.col("c_acctbal") < 0).alias("terminal"), F.min("user_id").alias("first_run"), F.max("user_id").alias("last_run"))


@query("""
with u as (select c_custkey as run, c_mktsegment as name, 'marked' as kind from customer where exists (select 1 from events where user_id = c_custkey and event_type = 'signup')
  union all select c_custkey, c_mktsegment, 'unmarked' from customer where not exists (select 1 from events where user_id = c_custkey and event_type = 'signup')),
r as (select *, row_number() over (partition by name, kind order by run) as rn from u)
select name, kind, count(*) as n, string_agg(run, ',' order by run) filter (where rn <= 10) as sample from r group by 1, 2""")
def retirement_check(t):
    marked = t.events.where("event_type = 'signup'").select(F.col("user_id").alias("run")).distinct()
    runs = t.customer.select(F.col("c_custkey").alias("run"), F.col("c_mktsegment").alias("name"))
    both = J.only_with(runs, marked, ["run"]).withColumn("kind", F.lit("marked")).union(J.without(runs, marked, ["run"]).withColumn("kind", F.lit("unmarked")))
    ranked = J.top_k(both, ["name", "kind"], [F.asc("run")], 10)
    sample = ranked.groupBy("name", "kind").agg(A.sample_ids(F.col("run"), F.col("run"), 10).alias("sample"))
    return both.groupBy("name", "kind").agg(F.count("*").alias("n")).join(sample, ["name", "kind"])


# Joins


@query("""
select e.event_id, e.user_id, e.ts, max(c.ts) as last_click from events e left join events c
on c.user_id = e.user_id and c.event_type = 'click' and c.ts <= e.ts where e.event_type = 'error' group by 1, 2, 3""")
def asof_last_before(t):
    errors = t.events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    clicks = t.events.where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"))
    return J.asof_last(errors, clicks, ["user_id"], "ts", "click_ts", "last_click")


@query("""
select user_id, event_id, ts, event_type, value from events
qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""")
def latest_per_key(t):
    return J.latest(t.events.select("user_id", "event_id", "ts", "event_type", "value"), ["user_id"], ["ts", "event_id"])


@query("""
select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn
from orders qualify rn <= 3""")
def lateral_topk(t):
    return J.top_k(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@query("""
with r as (select l_orderkey, sum(cast(l_quantity as bigint)) as tokens, sum(cast(l_extendedprice as decimal(18,2))) as cost from lineitem group by 1)
select o_custkey, cast(coalesce(sum(tokens), 0) as bigint) as tokens, cast(coalesce(sum(cost), 0) as double) as cost
from orders left join r on l_orderkey = o_orderkey where o_orderstatus <> 'P' group by 1""")
def tenant_spend(t):
    per_run = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_quantity").cast("long")).alias("tokens"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("cost"))
    runs = t.orders.where("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey").join(per_run, "o_orderkey", "left")
    return runs.groupBy("o_custkey").agg(A.saturating_sum(F.col("tokens")).alias("tokens"), F.coalesce(F.sum("cost"), F.lit(0)).cast("double").alias("cost"))


@query("""
select cast(coalesce(sum(cast(l_quantity as bigint)), 0) as bigint) as tokens, count(*) as calls from lineitem join orders on l_orderkey = o_orderkey
where o_orderpriority = '1-URGENT' and o_orderstatus <> 'P'""")
def spend_by_attribute(t):
    runs = t.orders.where(P.optional(o_orderpriority="1-URGENT", o_custkey=None) & (F.col("o_orderstatus") != "P"))
    ledger = t.lineitem.join(runs, F.col("l_orderkey") == F.col("o_orderkey"))
    return ledger.agg(A.saturating_sum(F.col("l_quantity").cast("long")).alias("tokens"), F.count("*").alias("calls"))


@query("""
select p_partkey from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_shipdate >= timestamp '2001-06-01')
and p_size <> 7""")
def coverage_gap(t):
    polls = t.lineitem.where("l_shipdate >= timestamp '2001-06-01'").groupBy("l_suppkey").agg(F.collect_set("l_partkey").alias("queues"))
    paused = t.part.where("p_size = 7").select("p_partkey")
    return J.coverage_gap(t.part, polls, "queues", "p_partkey", paused)


@query("""
select s_suppkey, (select count(*) from lineitem where l_suppkey = s_suppkey and l_linestatus = 'O') as open_tasks,
 (select count(*) from lineitem where l_suppkey = s_suppkey and l_returnflag = 'R') as returned,
 (select count(*) from supplier b where b.s_nationkey = a.s_nationkey and b.s_suppkey <> a.s_suppkey) as peers from supplier a""")
def reachability(t):
    peers = t.supplier.groupBy("s_nationkey").agg((F.count("*") - 1).alias("peers"))
    rows = t.lineitem.withColumnRenamed("l_suppkey", "s_suppkey")
    counted = J.with_counts(t.supplier.select("s_suppkey", "s_nationkey"), "s_suppkey", open_tasks=rows.where("l_linestatus = 'O'"), returned=rows.where("l_returnflag = 'R'"))
    return counted.join(peers, "s_nationkey").select("s_suppkey", "open_tasks", "returned", "peers")


@query("""
select l_orderkey, l_linenumber, l_suppkey from lineitem join orders on l_orderkey = o_orderkey
where l_linestatus = 'O' and o_orderstatus <> 'P' and not exists (select 1 from supplier where s_suppkey = l_suppkey and s_acctbal < 0 and l_returnflag = 'N')
and (select count(*) from lineitem x where x.l_suppkey = lineitem.l_suppkey and x.l_linestatus = 'F') < 400""")
def claimable_backlog(t):
    open_ = t.lineitem.where("l_linestatus = 'O'").join(t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    paused = t.supplier.where("s_acctbal < 0").select(F.col("s_suppkey").alias("paused"))
    kept = open_.join(paused, (F.col("l_suppkey") == F.col("paused")) & (F.col("l_returnflag") == "N"), "left_anti")
    running = t.lineitem.where("l_linestatus = 'F'").groupBy("l_suppkey").agg(F.count("*").alias("running"))
    return kept.join(running, "l_suppkey", "left").where(F.coalesce("running", F.lit(0)) < 400).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("""
select o_custkey, greatest(max(epoch(o_orderdate)) over () - epoch(o_orderdate), 0) as lag_s, o_orderkey from orders
qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1""")
def fairness_lag(t):
    top = t.orders.agg(F.max(W.seconds(F.col("o_orderdate"))).alias("clock"))
    last = J.latest(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return last.crossJoin(top).select("o_custkey", F.greatest(F.col("clock") - W.seconds(F.col("o_orderdate")), F.lit(0)).cast("double").alias("lag_s"), "o_orderkey")


@query("""
with s as (select o_custkey as k, o_orderpriority as q, max(o_orderdate) as last_start from orders group by 1, 2)
select k, q from s where last_start < timestamp '1998-01-01' and not exists (select 1 from orders where o_custkey = k and o_orderpriority = q and o_orderstatus = 'P')
and (select count(*) from s x where x.k = s.k) > 1
and not (q = (select max(q) from s x where x.k = s.k and x.last_start = (select max(last_start) from s y where y.k = s.k)))""")
def prune_victims(t):
    state = t.orders.groupBy(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("q")).agg(F.max("o_orderdate").alias("last_start"))
    pending = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("q"))
    clock = J.latest(state, ["k"], ["last_start", "q"]).select("k", F.col("q").alias("clock_q"))
    alone = state.groupBy("k").agg(F.count("*").alias("n"))
    idle = J.without(state.where("last_start < timestamp '1998-01-01'"), pending.distinct(), ["k", "q"])
    return idle.join(clock, "k").join(alone, "k").where("n > 1 and q <> clock_q").select("k", "q")


@query("""
select source, min(due) as due from (
 select 'order' as source, min(o_orderdate) as due from orders where o_orderstatus = 'P' union all
 select 'line', min(l_shipdate) from lineitem where l_linestatus = 'O' union all
 select 'event', min(ts) from events where event_type = 'error' union all
 select 'retry', min(o_orderdate) + interval 7 day from orders where o_orderstatus = 'O' union all
 select 'returned', min(l_shipdate) from lineitem where l_returnflag = 'R' union all
 select 'signup', min(ts) + interval 1 hour from events where event_type = 'signup') group by 1
union all select 'next', min(due) from (select min(o_orderdate) as due from orders where o_orderstatus = 'P' union all
 select min(l_shipdate) from lineitem where l_linestatus = 'O' union all select min(ts) from events where event_type = 'error' union all
 select min(o_orderdate) + interval 7 day from orders where o_orderstatus = 'O' union all select min(l_shipdate) from lineitem where l_returnflag = 'R' union all
 select min(ts) + interval 1 hour from events where event_type = 'signup')""")
def next_wake(t):
    one = lambda df, name, c: df.agg(F.min(c).alias("due")).select(F.lit(name).alias("source"), "due")
    sources = [(t.orders, "o_orderstatus = 'P'", "order", "o_orderdate"), (t.lineitem, "l_linestatus = 'O'", "line", "l_shipdate"), (t.events, "event_type = 'error'", "event", "ts")]
    later = [(t.orders, "o_orderstatus = 'O'", "retry", F.expr("o_orderdate + interval 7 days")), (t.lineitem, "l_returnflag = 'R'", "returned", "l_shipdate"), (t.events, "event_type = 'signup'", "signup", F.expr("ts + interval 1 hour"))]
    parts = reduce(DataFrame.unionByName, [one(df.where(which), name, c) for df, which, name, c in sources + later])
    return parts.unionByName(one(parts, "next", "due"))


@query("""
with recursive w as (select o_orderkey as root, o_orderkey as id, 0 as depth from orders where o_orderkey < 4
 union all select w.root, o.o_orderkey, w.depth + 1 from w join orders o on o.o_orderkey // 4 = w.id and o.o_orderkey <> w.id where w.depth < 12)
select root, id, depth from w""")
def run_tree(t):
    runs = t.orders.select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_orderkey") / 4).alias("parent"))
    return J.run_tree(runs, t.orders.where("o_orderkey < 4").select(F.col("o_orderkey").alias("id")), "id", "parent", 12)


@query("""
select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as place,
 lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as continued_from from orders""")
def run_chain(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", (F.row_number().over(w) - 1).cast("long").alias("place"), F.lag("o_orderkey").over(w).alias("continued_from"))


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderdate >= timestamp '2001-03-01') and exists (select 1 from nation where n_nationkey = c_nationkey)")
def idle_tenants(t):
    known = J.only_with(t.customer, t.nation.withColumnRenamed("n_nationkey", "c_nationkey"), ["c_nationkey"])
    return J.without(known, t.orders.where("o_orderdate >= timestamp '2001-03-01'").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"]).select("c_custkey")


@query("""
(select n_nationkey as shard, 'expected' as side from nation where n_nationkey not in (select s_nationkey from supplier where s_acctbal > 5000))
union all (select distinct s_nationkey, 'odd' from supplier where s_acctbal > 5000 and s_nationkey not in (select n_nationkey from nation))""")
def shard_differences(t):
    seen = t.supplier.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("shard"))
    expected = t.nation.select(F.col("n_nationkey").alias("shard"))
    return expected.exceptAll(seen.distinct()).withColumn("side", F.lit("expected")).where(F.col("shard").isNotNull()).union(seen.distinct().exceptAll(expected).withColumn("side", F.lit("odd")))


# Aggregates


@query("""
select l_returnflag as name, count(*) as calls, cast(sum(cast(l_quantity as bigint)) as bigint) as tokens_in,
 cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as cost, count(*) filter (where l_discount = 0) as unpriced from lineitem group by 1""")
def ledger_report(t):
    return t.lineitem.groupBy(F.col("l_returnflag").alias("name")).agg(F.count("*").alias("calls"), A.saturating_sum(F.col("l_quantity").cast("long")).alias("tokens_in"), A.money(F.col("l_extendedprice")).alias("cost"), F.count_if(F.col("l_discount") == 0).alias("unpriced"))


@query("""
select p_brand as model, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as cost, count(*) as calls from lineitem
join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey where o_orderstatus <> 'P' or o_orderpriority = '1-URGENT' group by 1""")
def spend_by_model(t):
    runs = t.orders.where("o_orderstatus <> 'P' or o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("model")), "l_partkey").join(runs, "l_orderkey", "left_semi")
    return rows.groupBy("model").agg(A.money(F.col("l_extendedprice")).alias("cost"), F.count("*").alias("calls"))


@query("""
with e as (select event_id, user_id, event_type, ts, max(case when event_type = 'click' then ts end) over (partition by user_id order by ts, event_type = 'purchase', event_id rows unbounded preceding) as started from events)
select user_id, count(*) filter (where event_type = 'click') as starts, count(*) filter (where event_type = 'purchase') as completed,
 count(*) filter (where event_type = 'error' and started is not null) as failed,
 cast(coalesce(sum(epoch_us(ts) - epoch_us(started)) filter (where event_type = 'purchase'), 0) as bigint) as compute_us from e group by 1""")
def usage_report(t):
    rows = W.carried(t.events.withColumn("is_end", F.col("event_type") == "purchase"), ["user_id"], ["ts", "is_end", "event_id"], F.when(F.col("event_type") == "click", F.col("ts")), "started")
    spent = F.when(F.col("event_type") == "purchase", W.micros(F.col("ts")) - W.micros(F.col("started")))
    return rows.groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("starts"), F.count_if(F.col("event_type") == "purchase").alias("completed"), F.count_if((F.col("event_type") == "error") & F.col("started").isNotNull()).alias("failed"), F.coalesce(F.sum(spent), F.lit(0)).alias("compute_us"))


@query("""
select regexp_replace(regexp_replace(regexp_replace(trim(regexp_extract(url, '^[^\\n]*', 0)), '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}', '<UUID>', 'g'), '0x[0-9a-f]+', '<HEX>', 'g'), '[0-9]+', '<NUM>', 'g') as signature,
 count(*) as n, min(page_id) as first_seen, max(page_id) as last_seen from pages group by 1""")
def failure_signature(t):
    return t.pages.groupBy(text.failure_signature(F.col("url")).alias("signature")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_seen"), F.max("page_id").alias("last_seen"))


@query("""
with g as (select source || '/' || lang as k, count(*) as n, min(doc_id) as first_seen, max(doc_id) as last_seen from documents group by 1),
r as (select *, row_number() over (order by n desc, k) as rn from g)
select case when rn <= 10 then k else '_other' end as k, cast(sum(n) as bigint) as n, min(first_seen) as first_seen, max(last_seen) as last_seen,
 cast((select count(*) from documents) as bigint) as total from r group by 1""")
def dead_letter_groups(t):
    groups = t.documents.groupBy(F.concat_ws("/", "source", "lang").alias("k")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_seen"), F.max("doc_id").alias("last_seen"))
    out = A.top_n_rest(groups, "k", 10, [F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")])
    return out.crossJoin(groups.agg(F.sum("n").alias("total")))


@query("select user_id, event_type, count(*) as n from events group by 1, 2")
def shape_histogram(t):
    return A.grouped_count(t.events, ["user_id", "event_type"])


@query("""
with s as (select o_custkey, string_agg(o_orderstatus, '>' order by o_orderdate, o_orderkey) as shape from orders group by 1),
c as (select shape, count(*) as n from s group by 1)
select shape, n, round(n / sum(n) over (), 9) as share from c""")
def shape_census(t):
    return A.shape_census(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus").select("shape", "n", F.round("share", 9).alias("share"))


@query("""
with s as (select o_custkey, list(o_orderstatus order by o_orderdate, o_orderkey) as a from orders group by 1),
c as (select a from s group by 1 order by count(*) desc, array_to_string(a, '>') limit 1)
select o_custkey, (select min(i) - 1 from range(1, greatest(len(s.a), len(c.a)) + 1) r(i) where s.a[i] is distinct from c.a[i]) as diverges_at from s, c""")
def shape_divergence(t):
    order = ["o_orderdate", "o_orderkey"]
    own = A.shapes(t.orders, "o_custkey", order, "o_orderstatus")
    census = own.groupBy("shape").agg(F.count("*").alias("n"))
    dominant = census.orderBy(F.desc("n"), F.asc("shape")).limit(1).select(F.col("shape").alias("dominant"))
    return own.crossJoin(dominant).select("o_custkey", A.first_difference(F.split("shape", ">"), F.split("dominant", ">")).alias("diverges_at"))


@query("""
select cast(floor(epoch(ts) / 3600) * 3600 as bigint) as bucket, count(*) as fires, count(distinct user_id) as schedules from events group by 1 having count(distinct user_id) >= 15""")
def herd_buckets(t):
    return A.herd(t.events, "ts", "user_id", 3600, 15)


@query("""
with b as (select cast(floor(epoch(ts) / 3600) * 3600 as bigint) as bucket, user_id from events),
h as (select bucket from b group by 1 having count(distinct user_id) >= 15)
select user_id, count(distinct bucket) as spots from b where bucket in (select bucket from h) group by 1""")
def herd_offenders(t):
    spots = A.herd(t.events, "ts", "user_id", 3600, 15).select("bucket")
    return A.buckets(t.events, "ts", 3600).join(spots, "bucket", "left_semi").groupBy("user_id").agg(F.countDistinct("bucket").alias("spots"))


@query("""
select c_nationkey, round(avg(c_acctbal) filter (where c_mktsegment = 'BUILDING'), 6) as building, round(avg(c_acctbal) filter (where c_mktsegment = 'MACHINERY'), 6) as machinery,
 round(avg(c_acctbal) filter (where c_mktsegment = 'HOUSEHOLD'), 6) as household from customer group by 1""")
def pivot_scores(t):
    got = A.pivot(t.customer, "c_nationkey", "c_mktsegment", "c_acctbal", ["BUILDING", "MACHINERY", "HOUSEHOLD"])
    return got.select("c_nationkey", *[F.round(F.col(c), 6).alias(c.lower()) for c in ("BUILDING", "MACHINERY", "HOUSEHOLD")])


@query("""
select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.99) as p99, count(value) as n from events group by 1""")
def latency_percentiles(t):
    return A.nearest_ranks(t.events, "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("""
select o_orderpriority as queue, count(*) as depth, min(o_orderdate) as oldest, cast(max(epoch(timestamp '1999-01-01') - epoch(o_orderdate)) as bigint) as oldest_age_s
from orders where o_orderstatus = 'P' group by 1""")
def queue_gauges(t):
    age = W.seconds(F.lit("1999-01-01 00:00:00").cast("timestamp")) - W.seconds(F.col("o_orderdate"))
    return t.orders.where("o_orderstatus = 'P'").groupBy(F.col("o_orderpriority").alias("queue")).agg(F.count("*").alias("depth"), F.min("o_orderdate").alias("oldest"), F.max(age).alias("oldest_age_s"))


@query("""
select p_brand as build, case when l_linestatus = 'O' then 'pending' else 'done' end as kind, l_returnflag as flag, o_orderpriority as queue, count(*) as n
from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey group by 1, 2, 3, 4""")
def stranded_census(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(F.col("p_brand").alias("build"), F.when(F.col("l_linestatus") == "O", "pending").otherwise("done").alias("kind"), F.col("l_returnflag").alias("flag"), F.col("o_orderpriority").alias("queue")).agg(F.count("*").alias("n"))


# Windows and batches


@query("""
with e as (select o_orderpriority as k, o_orderdate as t, 1 as d from orders union all
 select o_orderpriority, o_orderdate + to_days(cast(o_orderkey % 30 + 1 as integer)), -1 from orders),
g as (select k, t, d, sum(d) as step from e group by 1, 2, 3),
r as (select k, t, d, sum(step) over (partition by k order by t, d rows unbounded preceding) as running from g)
select k, cast(max(running) as bigint) as peak, min(t) filter (where running = (select max(running) from r x where x.k = r.k)) as at from r group by 1""")
def concurrency_peak(t):
    spans = t.orders.select(F.col("o_orderpriority").alias("k"), F.col("o_orderdate").alias("s"), F.expr("o_orderdate + make_dt_interval(cast(o_orderkey % 30 + 1 as int))").alias("e"))
    return W.peak(spans, ["k"], "s", "e")


@query("""
with b as (select user_id, event_id, ts, event_type, coalesce(epoch_us(ts) - epoch_us(lag(ts) over w) >= 14400000000, true) as far from events window w as (partition by user_id order by ts, event_id)),
i as (select *, sum(case when far then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as island from b)
select user_id, cast(island as bigint) as island, min(ts) as first, max(ts) + interval 4 hour as fire, count(*) as n, arg_max(event_id, (ts, event_id)) as last from i group by 1, 2""")
def debounce_batch(t):
    return W.debounce(t.events, ["user_id"], "ts", ["ts", "event_id"], 4 * 3600)


@query("""
with r as (select *, cast((row_number() over (partition by event_type order by ts, event_id) - 1) // 20 as bigint) as batch from events)
select event_type, batch, count(*) as n, min(ts) as first, string_agg(event_id, ',' order by ts, event_id) as payloads from r group by 1, 2""")
def count_batches(t):
    cut = W.count_batches(t.events, ["event_type"], ["ts", "event_id"], 20)
    order = F.array_sort(F.collect_list(F.struct("ts", "event_id")))
    return cut.groupBy("event_type", "batch").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.array_join(F.transform(order, lambda s: s.event_id.cast("string")), ",").alias("payloads"))


@query("""
with x as (select event_id, user_id, event_type, list(event_type) over (partition by user_id order by ts, event_id rows 29 preceding) as seen from events)
select event_id, user_id, event_type, cast(len(list_filter(seen, lambda x: x = event_type)) as bigint) as repeats from x""")
def loop_guard(t):
    got = W.repeats_in_last(t.events, ["user_id"], ["ts", "event_id"], F.col("event_type"), 30)
    return got.select("event_id", "user_id", "event_type", F.col("repeats").cast("long").alias("repeats"))


@query("""
with j as (select user_id, event_id, ts, event_type in ('click', 'view') as joinable, sum(case when event_type in ('click', 'view') then 0 else 1 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as island from events),
n as (select *, (row_number() over (partition by user_id, island order by ts, event_id) - 1) // 4 as part from j where joinable)
select user_id, cast(island as bigint) as island, cast(part as bigint) as part, count(*) as calls, min(event_id) as first_call from n group by 1, 2, 3""")
def fan_out_plan(t):
    runs = W.islands(t.events.withColumn("joinable", F.col("event_type").isin("click", "view")), ["user_id"], ["ts", "event_id"], ~F.col("joinable"))
    parts = W.count_batches(runs.where("joinable"), ["user_id", "island"], ["ts", "event_id"], 4).withColumnRenamed("batch", "part")
    return parts.groupBy("user_id", "island", "part").agg(F.count("*").alias("calls"), F.min("event_id").alias("first_call"))


@query("""
with x as (select user_id, event_id, ts, event_type, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as under from events where event_type in ('signup', 'error'))
select user_id, event_id, ts, under from x where event_type = 'error'""")
def name_carry_forward(t):
    rows = t.events.where(P.one_of("event_type", ["signup", "error"]))
    got = W.carried(rows, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "signup", F.col("event_id")), "under")
    return got.where("event_type = 'error'").select("user_id", "event_id", "ts", "under")


@query("select conv_id, turn, role from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 2")
def keep_newest(t):
    return J.top_k(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], [F.desc("turn")], 2).select("conv_id", "turn", "role")


# Read models of single runs


@query("""
select l_orderkey, l_returnflag as item, min(l_shipdate) as started, max(case when l_linestatus = 'F' then l_shipdate end) as ended, count(*) as tries from lineitem group by 1, 2""")
def timeline(t):
    return t.lineitem.groupBy("l_orderkey", F.col("l_returnflag").alias("item")).agg(F.min("l_shipdate").alias("started"), F.max(F.when(F.col("l_linestatus") == "F", F.col("l_shipdate"))).alias("ended"), F.count("*").alias("tries"))


@query("""
select user_id, event_id, ts from events s where event_type = 'signup' and not exists (select 1 from events e where e.user_id = s.user_id and e.event_type = 'purchase' and e.ts >= s.ts)""")
def open_items(t):
    ends = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("last_end"))
    return t.events.where("event_type = 'signup'").join(ends, "user_id", "left").where("last_end is null or last_end < ts").select("user_id", "event_id", "ts")


@query("""
select c_custkey from customer where c_acctbal >= 0 and exists (select 1 from events where user_id = c_custkey) and not exists (select 1 from events where user_id = c_custkey and ts >= timestamp '2024-01-29')""")
def stalled_runs(t):
    active = t.customer.where("c_acctbal >= 0").select("c_custkey")
    last = t.events.groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("ts").alias("last_ts"))
    return active.join(last, "c_custkey").where("last_ts < timestamp '2024-01-29'").select("c_custkey")


@query("""
with causes as (select o_orderkey, 1 as rank, 'paused' as cause from orders where o_orderstatus = 'P' union all
 select o_orderkey, 2, 'no work' from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey) union all
 select l_orderkey, 3, 'open work' from lineitem where l_linestatus = 'O')
select o_orderkey, arg_min(cause, rank) as verdict, count(distinct cause) as causes from causes join orders using (o_orderkey) group by 1""")
def stall_diagnosis(t):
    cause = lambda df, rank, name: df.select("o_orderkey", F.lit(rank).alias("rank"), F.lit(name).alias("cause"))
    items = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    found = cause(t.orders.where("o_orderstatus = 'P'"), 1, "paused").union(cause(J.without(t.orders, items.select("o_orderkey"), ["o_orderkey"]), 2, "no work")).union(cause(J.only_with(t.orders, items.where("l_linestatus = 'O'"), ["o_orderkey"]), 3, "open work"))
    return found.groupBy("o_orderkey").agg(F.min_by("cause", "rank").alias("verdict"), F.countDistinct("cause").alias("causes"))


@query("""
with h as (select user_id, count(*) as n, cast(sum(strlen(props)) as bigint) as bytes from events group by 1)
select c_custkey, n, bytes, n >= 80 as over_ceiling from customer join h on user_id = c_custkey where c_acctbal >= 0""")
def history_ceiling(t):
    sizes = t.events.groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum(F.octet_length("props")).alias("bytes"))
    return t.customer.where("c_acctbal >= 0").select("c_custkey").join(sizes, "c_custkey").withColumn("over_ceiling", F.col("n") >= 80)


@query("""
select l_suppkey, max(l_shipdate) as last_seen, date_diff('day', max(l_shipdate), timestamp '2000-01-01') > 30 as stale, arg_max(l_returnflag, (l_shipdate, l_orderkey, l_linenumber)) as last_beat from lineitem group by 1""")
def worker_liveness(t):
    got = t.lineitem.groupBy("l_suppkey").agg(F.max("l_shipdate").alias("last_seen"), F.max_by("l_returnflag", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("last_beat"))
    return got.withColumn("stale", F.datediff(F.lit("2000-01-01").cast("date"), F.col("last_seen")) > 30)


@query("""
select l_orderkey, l_linenumber, l_suppkey from lineitem where l_linestatus = 'O' and l_suppkey not in (select l_suppkey from lineitem where l_shipdate >= timestamp '2001-10-25')""")
def orphaned_tasks(t):
    live = t.lineitem.where("l_shipdate >= timestamp '2001-10-25'").select("l_suppkey").distinct()
    return J.without(t.lineitem.where("l_linestatus = 'O'"), live, ["l_suppkey"]).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("""
select o_custkey, min(o_orderkey) filter (where o_orderstatus = 'P') as next_waiter, count(*) filter (where o_orderstatus = 'P') as waiting
from orders group by 1 having max(o_orderdate) < timestamp '1998-06-01'""")
def expired_leases(t):
    waiting = F.col("o_orderstatus") == "P"
    got = t.orders.groupBy("o_custkey").agg(F.min(F.when(waiting, F.col("o_orderkey"))).alias("next_waiter"), F.count_if(waiting).alias("waiting"), F.max("o_orderdate").alias("last"))
    return got.where("last < timestamp '1998-06-01'").drop("last")


@query("""
select user_id, event_id, ts, case when event_type = 'error' then 'retry' when value < 5 then 'deadline' when value < 10 then 'heartbeat' else 'none' end as lane from events where event_type <> 'view'""")
def timeout_lanes(t):
    lane = F.when(F.col("event_type") == "error", "retry").when(F.col("value") < 5, "deadline").when(F.col("value") < 10, "heartbeat").otherwise("none")
    return t.events.where("event_type <> 'view'").select("user_id", "event_id", "ts", lane.alias("lane"))


@query("""
with d as (select distinct cast(o_orderdate as date) as day from orders), b as (select day from d where isodow(day) < 6)
select d.day, (select min(b.day) from b where b.day >= d.day) as next_business, (select max(b.day) from b where b.day <= d.day) as previous_business from d""")
def business_day_shift(t):
    days = t.orders.select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    business = F.when(F.weekday("day") < 5, F.col("day"))
    # The calendar has a row for each day, whatever the size of the tables.
    ahead, behind = Window.orderBy("day").rowsBetween(0, Window.unboundedFollowing), Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.select("day", F.min(business).over(ahead).alias("next_business"), F.max(business).over(behind).alias("previous_business"))


@query("""
with s as (select o_orderkey % 500 as task, o_orderkey, o_orderstatus, o_totalprice from orders)
select a.o_orderkey as run, coalesce(b.o_orderkey, c.o_orderkey) as other, a.o_orderstatus is distinct from b.o_orderstatus as differs from orders a
left join orders b on b.o_orderkey = a.o_orderkey + 1 left join orders c on c.o_orderkey = a.o_orderkey where a.o_orderstatus is distinct from b.o_orderstatus""")
def neighbour_changes(t):
    a = t.orders.select(F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("a"))
    b = t.orders.select((F.col("o_orderkey") - 1).alias("run"), F.col("o_orderkey").alias("other"), F.col("o_orderstatus").alias("b"))
    got = a.join(b, "run", "left").where(P.changed(F.col("a"), F.col("b")))
    return got.select("run", F.coalesce("other", "run").alias("other"), F.lit(True).alias("differs"))


# Votes, picks and streams in batch form


@query("""
with c as (select user_id, event_type, count(*) as votes from events group by 1, 2)
select user_id, event_type as answer, votes from c qualify row_number() over (partition by user_id order by votes desc, event_type) = 1""")
def vote_mode(t):
    votes = t.events.groupBy("user_id", F.col("event_type").alias("answer")).agg(F.count("*").alias("votes"))
    return J.top_k(votes, ["user_id"], [F.desc("votes"), F.asc("answer")], 1).drop("rn")


@query("""
select user_id, cast(ts as date) as round, event_id, value from events qualify row_number() over (partition by user_id, cast(ts as date) order by value desc, event_id) <= 2""")
def beam_topk(t):
    rows = t.events.select("user_id", F.col("ts").cast("date").alias("round"), "event_id", "value")
    return J.top_k(rows, ["user_id", "round"], [F.desc("value"), F.asc("event_id")], 2).drop("rn")


@query("""
select user_id, arg_min(event_id, (event_type <> 'purchase', value < 5, event_id)) as pick from events where event_type <> 'error' group by 1""")
def rule_pick(t):
    rank = F.struct((F.col("event_type") != "purchase").alias("a"), (F.col("value") < 5).alias("b"), F.col("event_id").alias("c"))
    return t.events.where("event_type <> 'error'").groupBy("user_id").agg(F.min_by("event_id", rank).alias("pick"))


@query("""
with d as (select distinct user_id, cast(props->>'$.k' as bigint) as seq from events),
r as (select *, row_number() over (partition by user_id order by seq) - 1 as rn from d)
select user_id, count(*) as received, count(*) filter (where seq = rn) as contiguous, count(*) filter (where seq <> rn) as above from r group by 1""")
def dedupe_out_of_order(t):
    seen = t.events.select("user_id", event_k().cast("long").alias("seq")).dropDuplicates()
    ranked = seen.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("seq")) - 1)
    return ranked.groupBy("user_id").agg(F.count("*").alias("received"), F.count_if(F.col("seq") == F.col("rn")).alias("contiguous"), F.count_if(F.col("seq") != F.col("rn")).alias("above"))


@query("""
select distinct o_orderkey as source, c_mktsegment as trigger from orders join customer on o_custkey = c_custkey
where o_orderstatus = 'F' and c_mktsegment in ('BUILDING', 'HOUSEHOLD')""")
def trigger_fire_once(t):
    done = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("source"), F.col("o_custkey").alias("c_custkey"))
    watching = t.customer.where(P.one_of("c_mktsegment", ["BUILDING", "HOUSEHOLD"])).select("c_custkey", F.col("c_mktsegment").alias("trigger"))
    return done.join(watching, "c_custkey").select("source", "trigger").dropDuplicates()


@query("""
select o_orderpriority as name, count(*) as removed, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as amount from orders
where o_orderstatus = 'F' and o_orderdate < timestamp '1999-01-01' - to_days(case o_orderpriority when '1-URGENT' then 700 when '5-LOW' then 100 else 365 end) group by 1""")
def retention_purge(t):
    keep = F.coalesce(F.element_at(F.create_map(F.lit("1-URGENT"), F.lit(700), F.lit("5-LOW"), F.lit(100)), F.col("o_orderpriority")), F.lit(365))
    old = t.orders.where(F.col("o_orderstatus") == "F").where(F.col("o_orderdate") < F.lit("1999-01-01 00:00:00").cast("timestamp") - F.make_dt_interval(days=keep))
    return old.groupBy(F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("removed"), A.money(F.col("o_totalprice")).alias("amount"))


@query("select date_trunc('day', ts) as cohort, event_type, count(*) as n, cast(sum(cast(value as decimal(18,2))) as double) as total from events group by 1, 2")
def day_cohorts(t):
    return t.events.groupBy(F.date_trunc("day", "ts").alias("cohort"), "event_type").agg(F.count("*").alias("n"), A.money(F.col("value")).alias("total"))


# Scalars over whole tables


@query("""
select s_suppkey, least(100.0, (s_acctbal % 50) + (s_suppkey % 600) * 0.25) as level, least(60.0, 1.5 * power(2.0, s_suppkey % 9)) as delay,
 s_nationkey + floor((s_suppkey % 7200) / 600) as aged from supplier""")
def throttle_levels(t):
    level = forecast.bucket_level(F.col("s_acctbal") % 50, F.col("s_suppkey") % 600, F.lit(0.25), F.lit(100.0))
    aged = forecast.aged_priority(F.col("s_nationkey"), F.col("s_suppkey") % 7200, 600).cast("double")
    return t.supplier.select("s_suppkey", level.alias("level"), forecast.retry_delay(F.col("s_suppkey") % 9 + 1, 1.5, 2.0, 60.0).alias("delay"), aged.alias("aged"))


@query("""
with d as (select i, coalesce((select sum(least(30.0, power(2.0, x - 1))) from range(1, i) r(x)), 0.0) as waited from range(1, 7) s(i))
select o_orderkey, cast(count(*) filter (where (i - 1) * (o_orderkey % 20) + waited < 60) as integer) as attempts from orders, d group by 1""")
def retry_envelope(t):
    return t.orders.select("o_orderkey", forecast.reachable_attempts(6, 1.0, 2.0, 30.0, (F.col("o_orderkey") % 20).cast("double"), F.lit(60.0)).alias("attempts"))


@query("""
select event_id, sha256(length(event_type) || ':' || event_type || '|' || length(cast(event_id as varchar)) || ':' || event_id) as key,
 substr(sha256('salt' || event_type), 1, 12) as anon from events""")
def idempotency_keys(t):
    return t.events.select("event_id", text.idempotency_key(F.col("event_type"), F.col("event_id").cast("string")).alias("key"), text.anonymous_id(F.col("event_type"), "salt").alias("anon"))


@query("""
with recursive p as (select conv_id, text, row_number() over (partition by conv_id order by turn) as n from conversations),
c as (select conv_id, n, sha256('' || '|' || length(text) || '|' || text) as link from p where n = 1
 union all select p.conv_id, p.n, sha256(c.link || '|' || length(p.text) || '|' || p.text) from c join p on p.conv_id = c.conv_id and p.n = c.n + 1),
m as (select *, max(n) over (partition by conv_id) as top from c)
select conv_id, n as turns, link from m where n = top""")
def transcript_hash_chain(t):
    turns = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", F.size("t").cast("long").alias("turns"), text.hash_chain(F.transform("t", lambda x: x.text)).alias("link"))


@query("""
with x as (select event_id, event_type, cast(props->>'$.k' as double) as w, cast(('0x' || substr(md5(cast(event_id as varchar)), 1, 13)) as bigint) / 4503599627370496.0 as u from events),
y as (select event_type, event_id, case when w > 0 then power(u, 1.0 / w) else -1.0 end as key from x)
select event_type, event_id from y qualify row_number() over (partition by event_type order by key desc, event_id) <= 10""")
def weighted_order(t):
    u = F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    keyed = t.events.select("event_type", "event_id", forecast.fair_key(event_k().cast("double"), u).alias("key"))
    return J.top_k(keyed, ["event_type"], [F.desc("key"), F.asc("event_id")], 10).select("event_type", "event_id")


# Graphs


@query("""
with recursive n as (select l_orderkey as dag, l_linenumber as task, cast(max(l_quantity) as bigint) as d from lineitem group by 1, 2),
es as (select dag, task, d, cast(0 as bigint) as es from n where task = 1 or not exists (select 1 from n x where x.dag = n.dag and x.task = n.task // 2)
 union all select n.dag, n.task, n.d, es.es + es.d from es join n on n.dag = es.dag and n.task // 2 = es.task and n.task > 1),
m as (select dag, max(es + d) as makespan from es group by 1),
lf as (select e.dag, e.task, e.d, e.es, m.makespan, e.task as leaf, m.makespan as lf from es e join m using (dag)
 union all select p.dag, p.task, p.d, p.es, lf.makespan, lf.leaf, lf.lf - lf.d from lf join es p on p.dag = lf.dag and p.task = lf.task // 2 and lf.task > 1)
select dag, cast(task as integer) as task, d as duration, es as early_start, min(lf) - d - es as slack, makespan from lf group by 1, 2, 3, 4, 6""")
def dag_slack(t):
    return G.slack(*histories.tree_tasks(t)).select("dag", "task", "duration", "early_start", "slack", "makespan")


from millrace.plans import histories, reviews  # noqa: E402, F401  register their queries
