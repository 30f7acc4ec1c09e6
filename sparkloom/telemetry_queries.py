"""Queries of telemetry, state and aggregation and their SQL. Users are callers, conversations sessions and traces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import relational as L
from .operators import telemetry as M
from .sources.bindings import lines, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _spans(spark, d):
    t = table(spark, d, "conversations")
    parent = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.select(F.col("conv_id").alias("trace"), F.col("turn").alias("span"), parent.alias("parent"), F.col("role").alias("kind"), F.length("text").cast("long").alias("ms"), (F.col("text") == "").alias("failed"))


_SPANS = "s as (select conv_id as trace, turn as span, lag(turn) over (partition by conv_id order by turn) as parent, role as kind, length(text) as ms, text = '' as failed from conversations)"


@query("""with p as (select * from (values ('click', 0.01, 0.001), ('view', 0.002, 0.0002), ('purchase', 0.05, 0.005)) t(model, price, cached_price)),
u as (select user_id, event_type as model, value as tokens, floor(value / 4) as cached from events)
select user_id, case when count(*) = count(price) then round(sum((tokens - cached) * price + cached * cached_price), 4) end as usd,
  coalesce(array_to_string(list_sort(list(distinct model) filter (where price is null)), ','), '') as unpriced from u left join p using (model) group by user_id""")
def q189_costs(spark, d):
    pricing = spark.createDataFrame([("click", 0.01, 0.001), ("view", 0.002, 0.0002), ("purchase", 0.05, 0.005)], "model string, price double, cached_price double")
    usage = table(spark, d, "events").select("user_id", F.col("event_type").alias("model"), F.col("value").alias("tokens"), F.floor(F.col("value") / 4).alias("cached"))
    return M.costs(usage, F.broadcast(pricing), "user_id")


@query(f"with {_SPANS} select u.kind as caller, s.kind as callee, count(*) as calls, sum(s.ms)::bigint as ms from s join s u on u.trace = s.trace and u.span = s.parent group by all")
def q190_interactions(spark, d):
    return M.interactions(_spans(spark, d))


@query(f"with {_SPANS} select kind, count(*) as calls, sum(ms)::bigint as ms, max(ms)::bigint as slowest, count(*) filter (where failed)::bigint as errors from s group by kind")
def q191_report(spark, d):
    return M.report(_spans(spark, d))


@query(f"with recursive {_SPANS}, w as (select trace, span, 0 as depth from s where parent is null union all select s.trace, s.span, w.depth + 1 from w join s on s.trace = w.trace and s.parent = w.span) select * from w")
def q192_span_depth(spark, d):
    return M.span_depths(_spans(spark, d))


@query("""select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, list_extract(list_sort(list(value)), (floor(count(*) / 2) + 1)::int) as upper_median, min(value) as best, max(value) as worst from events group by event_type""")
def q132_percentiles(spark, d):
    return M.percentiles(table(spark, d, "events"), "event_type", "value")


@query("""with r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events)
select user_id, count(*) as n, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95 from r where k <= 200 group by user_id""")
def q198_rolling_latency(spark, d):
    kept = M.last_n(table(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 200)
    n = kept.groupBy("user_id").agg(F.count("*").alias("n"))
    return n.join(M.percentiles(kept, "user_id", "value").select("user_id", "p50", "p95"), "user_id")


@query("select user_id, (floor(epoch_us(ts) / 3600000000) * 3600)::bigint as window, count(*) as hits, greatest(count(*) - 2, 0) as refused from events group by all")
def q196_rate_limit_aligned(spark, d):
    return M.aligned_windows(table(spark, d, "events"), "user_id", "ts", 3600, 2)


@query("""with recursive e as (select user_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts) as k from events),
w(user_id, k, opened, n, win) as (select user_id, k, t, 1, 1 from e where k = 1 union all
  select e.user_id, e.k, case when e.t - w.opened >= 3600000000 then e.t else w.opened end, case when e.t - w.opened >= 3600000000 then 1 else w.n + 1 end, case when e.t - w.opened >= 3600000000 then w.win + 1 else w.win end
  from w join e on e.user_id = w.user_id and e.k = w.k + 1)
select user_id, count(*) as hits, count(*) filter (where n <= 2) as allowed, max(win)::bigint as windows from w group by user_id""")
def q196_rate_limit_first_hit(spark, d):
    return M.first_hit_windows(table(spark, d, "events"), "user_id", "ts", 3600, 2)


@query("""with b as (select event_type, event_id, coalesce(sum(value) over (partition by ts::date, event_type order by ts, event_id rows between unbounded preceding and 1 preceding), 0) <= 500 as allowed, ts from events)
select event_type, ts::date as day, count(*) as n, count(*) filter (where allowed) as allowed from b group by all""")
def q197_daily_budget(spark, d):
    b = M.budget(table(spark, d, "events"), "event_type", "ts", "value", "event_id", 500.0)
    return b.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum(F.col("allowed").cast("long")).alias("allowed"))


@query("""with b as (select *, floor(value)::bigint as stage, max(floor(value)) over w as high, max((event_type = 'error')::int) over w as done from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding))
select user_id, event_id, stage from b where coalesce(done, 0) = 0 and (high is null or stage > high)""")
def q195_progress_dedupe(spark, d):
    e = table(spark, d, "events").withColumn("stage", F.floor("value").cast("long"))
    return M.progress(e, "user_id", ["ts", "event_id"], "stage", F.col("event_type") == "error").select("user_id", "event_id", "stage")


@query("select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as seq from events")
def q194_progress_log(spark, d):
    return L.numbered(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "seq")


@query("select conv_id, max_by(role, turn) as entity, max(turn) as turn from conversations where role <> 'system' group by conv_id")
def q200_most_recent_entity(spark, d):
    return L.latest(table(spark, d, "conversations").filter("role <> 'system'"), "conv_id", "turn", "role").withColumnRenamed("role", "entity")


@query("""with o as (select distinct o_custkey as repo, l_suppkey as file, 1 as a from lineitem join orders on o_orderkey = l_orderkey where o_orderstatus <> 'O'), n as (select distinct o_custkey as repo, l_suppkey as file, 1 as b from lineitem join orders on o_orderkey = l_orderkey where o_orderstatus <> 'F')
select repo, file, case when a is null then 'added' when b is null then 'removed' else 'kept' end as change from o full join n using (repo, file)""")
def q201_snapshot_diff(spark, d):
    at = lambda c: lines(spark, d).filter(c).select(F.col("o_custkey").alias("repo"), F.col("l_suppkey").alias("file"))
    return M.set_diff(at("o_orderstatus <> 'O'"), at("o_orderstatus <> 'F'"), ["repo", "file"])


@query("""with r as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as k from orders) select o_custkey as repo, count(*) as kept, min(o_orderdate) as oldest from r where k <= 10 group by all""")
def q202_snapshot_retention(spark, d):
    kept = M.last_n(table(spark, d, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 10)
    return kept.groupBy(F.col("o_custkey").alias("repo")).agg(F.count("*").alias("kept"), F.min("o_orderdate").alias("oldest"))


@query("with m as (select max(ts) as now from events) select event_type, count(*) as n from events, m where epoch(date_trunc('second', now)) - epoch(date_trunc('second', ts)) < 604800 and value <= 50 group by event_type")
def q203_cache_freshness(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max("ts")).first()[0]
    return M.fresh(e, "ts", F.lit(now).cast("timestamp"), 604800, "value", 50).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""with r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events)
select user_id, count(*) as runs, string_agg(event_id::varchar, ',' order by k) filter (where k <= 3) as latest, round(avg((event_type = 'error')::int), 6) as failures from r where k <= 20 group by user_id""")
def q204_run_history(spark, d):
    order = [F.desc("ts"), F.desc("event_id")]
    kept = M.last_n(table(spark, d, "events"), "user_id", order, 20).withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)))
    latest = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.struct("k", "event_id")))), lambda x: x["event_id"].cast("string")), ",")
    return kept.groupBy("user_id").agg(F.count("*").alias("runs"), latest.alias("latest"), F.round(F.avg((F.col("event_type") == "error").cast("int")), 6).alias("failures"))


@query("""with p as (select user_id, event_id, value, min(value) over w as low, max(value) over w as high, count(*) over w as n, row_number() over (partition by user_id order by event_id) - 1 as k from events window w as (partition by user_id))
select user_id, event_id, round(case when n = 1 then 0 else k * 100 / (n - 1) end, 4) as x, round(case when high = low then 10 else 20 - (value - low) * 20 / (high - low) end, 4) + 0.0 as y from p""")
def q205_sparkline(spark, d):
    return M.sparkline(table(spark, d, "events"), "user_id", "event_id", "value")


@query("select s_suppkey, s_nationkey, coalesce(n, 0) as symbols, coalesce(q, 0) as loc from supplier left join (select l_suppkey, count(*) as n, sum(l_quantity)::bigint as q from lineitem group by all) on l_suppkey = s_suppkey")
def q071_left_lookup(spark, d):
    own = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("symbols"), F.sum("l_quantity").cast("long").alias("loc"))
    return L.lookup(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), own, ["s_suppkey"], {"symbols": 0, "loc": 0})


@query("select o_orderkey, coalesce(c_name, 'Customer#' || lpad(o_orderpriority[1], 9, '0')) as target, c_custkey is null as unresolved from orders left join customer on c_custkey = o_custkey and c_acctbal > 0")
def q070_endpoint_resolution(spark, d):
    good = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    fallback = F.concat(F.lit("Customer#"), F.lpad(F.substring("o_orderpriority", 1, 1), 9, "0"))
    return L.resolve_endpoints(table(spark, d, "orders"), good, "o_custkey", "c_name", fallback).select("o_orderkey", "target", "unresolved")


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def q074_semi_join(spark, d):
    failed = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return L.having(table(spark, d, "customer").select("c_custkey"), failed, ["c_custkey"])


@query("select p_partkey from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_returnflag = 'R')")
def q075_anti_join(spark, d):
    returned = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return L.lacking(table(spark, d, "part").select("p_partkey"), returned, ["p_partkey"])


@query("""with i as (select distinct l_orderkey, l_suppkey, min(l_partkey) over (partition by l_orderkey, l_suppkey) as target from lineitem where l_returnflag = 'N'),
c as (select l_orderkey, l_suppkey, l_partkey from lineitem where l_returnflag = 'R') select c.l_orderkey, c.l_partkey, target, count(*) as n from c join i using (l_orderkey, l_suppkey) group by all""")
def q077_binding_join(spark, d):
    rows = table(spark, d, "lineitem")
    bound = L.bind(rows.filter("l_returnflag = 'R'").select("l_orderkey", "l_suppkey", "l_partkey"), rows.filter("l_returnflag = 'N'").withColumnRenamed("l_partkey", "p"), ["l_orderkey", "l_suppkey"], "p")
    return bound.groupBy("l_orderkey", "l_partkey", "target").agg(F.count("*").alias("n"))


@query("""with w as (select l_orderkey, l_linenumber * 10 as s, l_linenumber * 10 + l_quantity::int as e, l_partkey from lineitem)
select a.l_orderkey, a.l_partkey as inner_part, b.l_partkey as outer_part, count(*) as n from w a join w b on a.l_orderkey = b.l_orderkey and b.s <= a.s and b.e >= a.e and (b.s <> a.s or b.e <> a.e) group by all""")
def q078_containment_join(spark, d):
    w = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 10).alias("s"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")).alias("e"), "l_partkey")
    return L.containing(w, "l_orderkey", "s", "e", "l_partkey").groupBy("l_orderkey", F.col("inner").alias("inner_part"), F.col("outer").alias("outer_part")).agg(F.count("*").alias("n"))


@query("""with a as (select o_custkey as repo, n_regionkey as cluster, s_nationkey as sn from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join supplier on s_suppkey = l_suppkey)
select cluster, case when n_regionkey = cluster then 'internal' when n_regionkey < cluster then 'inbound' else 'outbound' end as side, count(*) as n from a join nation on n_nationkey = sn group by all""")
def q083_boundary_split(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    of = lambda key, name: nation.select(F.col("n_nationkey").alias(key), F.col("n_regionkey").alias(name))
    rows = lines(spark, d).join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return L.sides(rows.join(of("c_nationkey", "own"), "c_nationkey").join(of("s_nationkey", "other"), "s_nationkey"), F.col("own"), F.col("other"))


@query("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem group by all")
def q129_group_by(spark, d):
    return L.totals(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], {"quantity": F.col("l_quantity"), "revenue": F.col("l_extendedprice") * (1 - F.col("l_discount"))})


@query("select o_custkey, max(o_totalprice) as importance, max_by(o_orderkey, (o_totalprice, o_orderkey)) as best, array_to_string(list_sort(list(distinct o_orderstatus)), '') as statuses from orders group by o_custkey")
def q130_best_row(spark, d):
    return L.best_row(table(spark, d, "orders"), "o_custkey", "o_totalprice", "o_orderkey", "o_orderstatus").withColumnRenamed("all", "statuses")


@query("select o_custkey, bool_and(o_totalprice > 1000) as measured, bool_or(o_orderstatus = 'F') as failed, case when bool_or(o_orderstatus = 'F') then 'failed' when bool_or(o_orderstatus = 'P') then 'partial' else 'completed' end as status from orders group by o_custkey")
def q131_boolean_aggregates(spark, d):
    status = F.col("o_orderstatus")
    return L.judged(table(spark, d, "orders"), "o_custkey", F.col("o_totalprice") > 1000, status == "F", status == "P")


@query("select l_orderkey, array_to_string(list_sort(list(distinct l_suppkey)), ',') as files from lineitem group by l_orderkey")
def q136_distinct_sorted(spark, d):
    return L.distinct_sorted(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey").withColumnRenamed("values", "files")


@query("""with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as k from orders) select o_custkey, o_orderkey, k::int as k from r where k <= 3""")
def q142_top_k(spark, d):
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", k.alias("k")).filter(F.col("k") <= 3)


@query("""with r as (select o_custkey, o_orderkey, o_orderstatus = 'F' as hard, sum((o_orderstatus = 'F')::int) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding) as used from orders) select o_custkey, o_orderkey, used::bigint as used from r where hard and used <= 3""")
def q140_running_budget(spark, d):
    return L.within_budget(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") == "F", 3).select("o_custkey", "o_orderkey", "used")


@query("""with r as (select l_orderkey, l_partkey, l_suppkey, row_number() over (partition by l_orderkey, l_suppkey order by l_extendedprice desc, l_partkey, l_linenumber) as k from lineitem),
s as (select *, row_number() over (partition by l_orderkey order by k, l_suppkey) as place from r) select l_orderkey, l_partkey, l_suppkey, place::int as place from s where place <= 3""")
def q141_round_robin(spark, d):
    rows = L.round_robin(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", [F.desc("l_extendedprice"), "l_partkey", "l_linenumber"], 3)
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "place")


@query("""with r as (select o_orderpriority, o_orderstatus = 'F' as negative, o_orderkey, row_number() over (partition by o_orderpriority, o_orderstatus = 'F' order by o_totalprice desc, o_orderkey) as k from orders) select o_orderpriority, negative, o_orderkey from r where k <= case when negative then 1 else 5 end""")
def q143_quota_sample(spark, d):
    o = table(spark, d, "orders").withColumn("negative", F.col("o_orderstatus") == "F")
    return L.quota(o, "o_orderpriority", "negative", [F.desc("o_totalprice"), "o_orderkey"]).select("o_orderpriority", "negative", "o_orderkey")


@query("""with s as (select l_orderkey, list_sort(list(distinct l_suppkey)) as f from lineitem group by l_orderkey) select l_orderkey, array_to_string(f[1:3], ', ') || case when len(f) > 3 then ' (+' || (len(f) - 3) || ' more)' else '' end as shown from s""")
def q144_bounded_list(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).cast("array<string>").alias("f"))
    return s.select("l_orderkey", L.shown(F.col("f"), 3).alias("shown"))


@query("""with a as (select l_orderkey, list(distinct l_suppkey) filter (where l_returnflag = 'N') as a, list(distinct l_suppkey) filter (where l_returnflag <> 'N') as b from lineitem group by l_orderkey)
select l_orderkey, len(coalesce(list_intersect(a, b), [])) as both, len(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))) as either, len(coalesce(a, [])) - len(coalesce(list_intersect(a, b), [])) as only_a from a""")
def q145_set_operations(spark, d):
    return L.set_sizes(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", F.col("l_returnflag") == "N")


@query("""with r as (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as k from events) select user_id, event_type, event_id from r where k = 1""")
def q146_keep_latest(spark, d):
    return L.keep_first(table(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("""with c as (select user_id, event_type, count(*) as n from events group by all), r as (select *, row_number() over (partition by user_id order by n desc, event_type) as k from c) select user_id, event_type as dominant, n from r where k = 1""")
def q148_mode(spark, d):
    return L.mode(table(spark, d, "events"), "user_id", "event_type")


@query("select conv_id, turn, lead(turn) over (partition by conv_id order by turn) - 1 as end_turn from conversations")
def q139_next_row(spark, d):
    return L.until_next(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn").withColumnRenamed("until", "end_turn")


@query("""select o_custkey, o_orderkey, max(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and 1 preceding) as covered from orders""")
def q138_running_max(spark, d):
    return L.covered(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_custkey", "o_orderkey", "covered")


@query("""with v as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as version from events), c as (select user_id, max(version) as latest from v group by user_id)
select user_id, event_id, version from v join c using (user_id) where version > latest - 5""")
def q193_versioned_state(spark, d):
    v = table(spark, d, "events").withColumn("version", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    return M.last_n(v, "user_id", [F.desc("version")], 5).select("user_id", "event_id", "version")
