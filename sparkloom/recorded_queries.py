"""Queries of recorded runs, session memory and blackboards, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import recorded as V
from .sources.bindings import table

QUERIES, SQL = {}, {}
TOOLS = ["search_code", "get_callers", "blast_radius"]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


#: A reply for each turn of a conversation: noise, a call of one of four tools (one isn't there), or an answer with citations.
_SAY = """case (conv_id + 3 * k) % 7 when 0 then 'I think { ' || role when 6 then 'Done: {"action":"answer","answer":"' || role || '","answered":' || ((conv_id + k) % 4 <> 1) || ',"citedChunkIds":["c' || (k - 1) || '","c' || (k - 2) || '","none"],"citedFileIds":["f' || (conv_id % 3) || '"]} ok'
  else '{"action":"tool","tool":"' || (case (conv_id * k) % 5 when 0 then 'search_code' when 1 then 'get_callers' when 2 then 'blast_radius' when 3 then 'invented' else 'search_code' end) || '","args":{"q":"}"}}' end"""
_RUN = f"t as (select conv_id as run, conv_id, role, (row_number() over (partition by conv_id order by turn))::int as k from conversations), said as (select run, conv_id, k, {_SAY} as text, k % 2 = 0 as empty from t)"


@query(rf"""with recursive {_RUN}, o as (select *, case when text like '%{{"action%' then regexp_extract(text, '\{{"action.*\}}') end as j from said),
x as (select run, conv_id, k, empty, case when j is null then 'unparseable' else json_extract_string(j, '$.action') end as kind, json_extract_string(j, '$.tool') as tool, coalesce(json_extract_string(j, '$.answered') = 'true', false) as ok,
  case when json_extract_string(j, '$.action') = 'answer' then ['c' || (k - 1), 'c' || (k - 2), 'none'] else [] end as cc, case when json_extract_string(j, '$.action') = 'answer' then ['f' || (conv_id % 3)] else [] end as cf from o),
f(run, turns, calls, failures, stop, chunks, files, kept, dropped, offered, spent) as (
  select distinct run, 0, 0, 0, '', []::varchar[], []::varchar[], []::varchar[], []::varchar[], []::int[], []::varchar[] from x
  union all
  select f.run, turns + 1, calls + (kind = 'tool' and not forced)::int, failures + (kind = 'unparseable')::int,
    case when kind = 'unparseable' and failures + 1 > 2 then 'parse-failure' when kind = 'answer' then case when ok and len(list_intersect(cc, chunks)) + len(list_intersect(cf, files)) > 0 then 'answered' else 'refused' end else '' end,
    case when kind = 'tool' and not forced and known then list_append(chunks, 'c' || k) else chunks end, case when kind = 'tool' and not forced and known then list_append(files, 'f' || (k % 3)) else files end,
    case when kind = 'answer' then list_concat(list_intersect(cc, chunks), list_intersect(cf, files)) else kept end,
    case when kind = 'answer' then list_concat(list_filter(cc, lambda c: not list_contains(chunks, c)), list_filter(cf, lambda c: not list_contains(files, c))) else dropped end,
    list_append(offered, case when forced then 0 else len(list_filter(['search_code', 'get_callers', 'blast_radius'], lambda n: len(list_filter(spent, lambda s: s = n)) < 2))::int end),
    case when kind = 'tool' and not forced and known and empty then list_append(spent, tool) else spent end
  from (select f.*, x.kind, x.tool, x.ok, x.cc, x.cf, x.k, x.empty, x.k >= 6 or f.calls >= 4 as forced, coalesce(list_contains(['search_code', 'get_callers', 'blast_radius'], x.tool), false) as known from f join x on x.run = f.run and x.k = f.turns + 1 where f.stop = '' and f.turns < 6) f),
last as (select * from f qualify row_number() over (partition by run order by turns desc) = 1)
select run, turns, calls, failures, case when stop <> '' then stop when calls >= 4 then 'tool-call-limit' else 'turn-limit' end as stop, array_to_string(list_sort(list_distinct(kept)), ',') as kept, array_to_string(list_sort(list_distinct(dropped)), ',') as dropped, array_to_string(offered, ',') as offered from last""")
def q155_agent_replay(spark, d):
    t = table(spark, d, "conversations").withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    said = t.select(F.col("conv_id").alias("run"), F.col("k").alias("turn"), F.expr(_SAY).alias("text"))
    none = F.col("k").cast("string")
    results = t.select(F.col("conv_id").alias("run"), F.col("k").alias("turn"), (F.col("k") % 2 == 0).alias("empty"), F.array(F.concat(F.lit("c"), none)).alias("chunks"), F.array(F.concat(F.lit("f"), (F.col("k") % 3).cast("string"))).alias("files"))
    out = V.replay(said, results, TOOLS, most_calls=4)
    text = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",").alias(c)
    return out.select("run", "turns", "calls", "failures", "stop", text("kept"), text("dropped"), F.array_join(F.transform("trace", lambda x: x["offered"].cast("string")), ",").alias("offered"))


#: A session for each user: an event is a turn on one of a few analyses, whose answer repeats its kind.
_TURNS = """turns as (select user_id as session, event_id as seq, ts, (value / 60)::int as analysis, repeat(event_type, (event_id % 150)::int) as answer, [event_id % 90, event_id % 7] as chunks,
  [{'kind': 'file', 'value': 'f' || (event_id % 40)}, {'kind': 'symbol', 'value': event_type}] as entities from events),
b as (select *, coalesce(lag(analysis) over w <> analysis, true) or epoch_us(ts) - epoch_us(lag(ts) over w) >= $seconds::bigint * 1000000 as new from turns window w as (partition by session order by ts, seq)),
r as (select *, sum(new::int) over (partition by session order by ts, seq) as run from b),
k as (select *, max(run) over (partition by session) as last, max(ts) over (partition by session) as seen from r),
alive as (select *, row_number() over (partition by session order by ts, seq) as turn from k where run = last and epoch_us((select max(ts) from events)) - epoch_us(seen) < $seconds::bigint * 1000000),
n as (select session, max(turn) as n from alive group by session),
told as (select session, any_value(analysis) as analysis, string_agg(turn::varchar || ':' || (case when length(answer) <= 600 then length(answer) else 600 end), ',' order by turn) as turns from alive join n using (session) where turn > n - 8 group by session),
e as (select session, -turn as t, unnest(entities) as e, unnest(range(2)) as pos from alive),
named as (select session, e.kind as kind, e.value as value, min((t, pos)) as p from e group by all),
placed as (select *, row_number() over (partition by session order by p, kind, value) as place from named),
c as (select session, turn, unnest(chunks) as chunk, unnest(range(2)) as pos from alive), cs as (select session, chunk, max((turn, pos)) as p from c group by all),
cp as (select *, row_number() over (partition by session order by p desc) as back from cs)
select session, any_value(analysis) as analysis, any_value(turns) as turns, (select string_agg(value, ',' order by place) from placed x where x.session = told.session and place <= 20) as entities,
  (select string_agg(chunk::varchar, ',' order by p) from cp y where y.session = told.session and back <= 200) as chunks from told group by session"""


def _sessions(spark, d, seconds: int):
    e = table(spark, d, "events")
    kind = lambda k, v: F.struct(F.lit(k).alias("kind"), v.alias("value"))
    turns = e.select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.rint(F.col("value") / 60).cast("int").alias("analysis"), F.expr("repeat(event_type, cast(event_id % 150 as int))").alias("answer"),
        F.array(F.col("event_id") % 90, F.col("event_id") % 7).alias("chunks"), F.array(kind("file", F.concat(F.lit("f"), (F.col("event_id") % 40).cast("string"))), kind("symbol", F.col("event_type"))).alias("entities"),
    )
    now = e.agg(F.max("ts").cast("timestamp")).first()[0]
    out = V.sessions(turns, F.lit(now), seconds)
    turn = F.array_join(F.transform("turns", lambda t: F.concat(t["turn"].cast("string"), F.lit(":"), F.length(t["answer"]).cast("string"))), ",")
    return out.select("session", "analysis", turn.alias("turns"), F.array_join(F.transform("entities", lambda x: x["value"]), ",").alias("entities"), F.array_join(F.transform("chunks", lambda x: x.cast("string")), ",").alias("chunks"))


@query("with " + _TURNS.replace("$seconds", "10000000"))
def q199_session_memory(spark, d):
    return _sessions(spark, d, 10_000_000)


@query("with " + _TURNS.replace("$seconds", str(V.SESSION_SECONDS)))
def q222_session_ttl(spark, d):
    return _sessions(spark, d, V.SESSION_SECONDS)


#: A board for each customer: orders are writes, what was shipped is read.
_BOARD = """w as (select o_custkey as board, o_orderdate as "at", o_orderkey as seq, o_orderpriority as writer, 'status ' || o_orderstatus as reason, o_totalprice as state from orders),
r as (select o_custkey as board, l_shipdate as "at", min(l_orderkey) as seq, l_returnflag as reader, case when count(*) > 1 then count(*) || ' lines' end as note from lineitem join orders on o_orderkey = l_orderkey where l_linenumber <= 2 group by o_custkey, l_shipdate, l_returnflag),
v as (select *, row_number() over (partition by board order by "at", seq) as version, count(*) over (partition by board) as total from w),
u as (select r.*, row_number() over (partition by board order by "at", seq, reader) as place, (select count(*) from w where w.board = r.board and w."at" <= r."at") as version from r)"""


def _board(spark, d):
    o = table(spark, d, "orders")
    w = o.select(F.col("o_custkey").alias("board"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("writer"), F.concat(F.lit("status "), "o_orderstatus").alias("reason"), F.col("o_totalprice").alias("state"))
    l = table(spark, d, "lineitem").filter("l_linenumber <= 2").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")  # noqa: E741
    n = F.count("*")
    r = l.groupBy(F.col("o_custkey").alias("board"), F.col("l_shipdate").alias("at"), F.col("l_returnflag").alias("reader")).agg(F.min("l_orderkey").alias("seq"), F.when(n > 1, F.concat(n.cast("string"), F.lit(" lines"))).alias("note"))
    return w, r


@query(f"""with {_BOARD} select u.board, u."at" as day, u.seq, reader, note, u.version, v.state from u left join v on v.board = u.board and v.version = u.version and v.version > v.total - 5""")
def q193_read_as_of(spark, d):
    return V.as_of(*_board(spark, d), 5).withColumnRenamed("at", "day")


@query(f"""with {_BOARD}, lines as (select board, version, 0 as side, 0 as place, '  v' || version || ' by ' || writer || ': ' || reason as line from v where version > total - 5
  union all select u.board, u.version, 1, place, '      read by ' || reader || coalesce(' (' || note || ')', '') from u join v on v.board = u.board and v.version = u.version and v.version > v.total - 5),
h as (select board, total as w, coalesce((select count(*) from r where r.board = x.board), 0) as n from (select distinct board, total from v) x)
select board, w || ' writes, ' || n || ' reads' || case when w > 5 then ', versions before ' || (w - 4) || ' trimmed' else '' end || chr(10) || (select string_agg(line, chr(10) order by version, side, place) from lines l where l.board = h.board) as history from h""")
def q163_blackboard_history(spark, d):
    return V.history(*_board(spark, d), 5)
