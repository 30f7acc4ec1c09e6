"""Queries of selection and replay operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .agent_queries import _part_files
from .graph_queries import _BASE, _CYCLIC, _DEGREE, _METRICS, _REACH
from .operators import graph as G
from .operators import reach as H
from .operators import selection as S
from .operators import telemetry as M
from .retrieval_queries import _POSTINGS, chunks, questions
from .sources.bindings import EDGES_SQL, NODES_SQL, edges, nodes, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"with {_POSTINGS} select query_id, id, score, rank::int as rank from lexical where rank <= 10")
def q151_search_code(spark, d):
    return S.search_code(chunks(spark, d), questions(spark, d), 25)


@query("with s as (select distinct md5(o_orderkey::varchar) as sha from orders), p as (select distinct case when c_custkey % 2 = 0 then md5(c_custkey::varchar)[1:8] else c_name[1:9] end as prefix from customer), m as (select prefix, min(sha) as sha, count(*) as n from p join s on s.sha[1:8] = prefix group by prefix) select prefix, case when n = 1 then sha end as sha from p left join m using (prefix)")
def q082_sha_prefix(spark, d):
    shas = table(spark, d, "orders").select(F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("sha"))
    prefix = F.when(F.col("c_custkey") % 2 == 0, F.substring(F.md5(F.col("c_custkey").cast("string").cast("binary")), 1, 8)).otherwise(F.substring("c_name", 1, 9))
    return S.match_prefix(table(spark, d, "customer").select(prefix.alias("prefix")).distinct(), shas)


@query(f"""with {EDGES_SQL}, {NODES_SQL}, f as (select repo as cluster, kind as specialist, evidence as finding, line as importance, src as file from edges union select repo, kind, evidence, line, dst * 2 from edges),
m as (select f.*, n.file is not null as ok from f left join nodes n on n.repo = f.cluster and n.file = f.file), p as (select cluster, specialist, finding, importance, count(*) filter (where ok) as grounded, count(*) filter (where not ok) as dropped from m group by all),
r as (select *, row_number() over (partition by cluster, specialist order by importance desc, finding) as place from p where grounded > 0) select * from r where place <= 3""")
def q160_specialist_grounding(spark, d):
    f = edges(spark, d).select(F.col("repo").alias("cluster"), F.col("kind").alias("specialist"), F.col("evidence").alias("finding"), F.col("line").alias("importance"), F.array("src", F.col("dst") * 2).alias("files"))
    return S.ground_findings(f, nodes(spark, d).withColumnRenamed("repo", "cluster"))


@query("""with j as (select c_custkey as cluster, s as specialist from customer, (select unnest(['F', 'O', 'P', 'X']) as s)), o as (select o_custkey as cluster, o_orderstatus as specialist, count(*) as findings from orders group by all)
select cluster, specialist, coalesce(findings, 0) as findings, case when findings is null then 'empty' else 'ok' end as status from j left join o using (cluster, specialist)""")
def q162_fan_out(spark, d):
    outputs = table(spark, d, "orders").select(F.col("o_custkey").alias("cluster"), F.col("o_orderstatus").alias("specialist"))
    return S.fan_out(table(spark, d, "customer").select(F.col("c_custkey").alias("cluster")), ["F", "O", "P", "X"], outputs)


@query(f"""with {EDGES_SQL}, {NODES_SQL}, o as (select repo, file, min(position) as old from (select repo, src as file, line as position from edges union all select repo, dst * 2, line + 1 from edges) group by all)
select repo, file, old, row_number() over (partition by repo order by old, file)::int as position from o where exists (select 1 from nodes n where n.repo = o.repo and n.file = o.file)""")
def q167_renumbered_order(spark, d):
    e = edges(spark, d)
    order = e.select("repo", F.col("src").alias("file"), F.col("line").alias("position")).union(e.select("repo", F.col("dst") * 2, F.col("line") + 1))
    return S.renumber(order, nodes(spark, d))


@query(f"""{_BASE}, {_REACH}, {_CYCLIC}, {_DEGREE}, {_METRICS}, k as (select repo, 'key' as section, file, row_number() over (partition by repo order by centrality desc, file) as place from metrics where centrality > 0),
i as (select repo, 'impact' as section, file, row_number() over (partition by repo order by blast_radius desc, file) as place from metrics where blast_radius > 0),
c as (select repo, 'cycle' as section, component as file, row_number() over (partition by repo order by count(*) desc, component) as place from cyclic group by repo, component),
e as (select repo, 'entry' as section, file, row_number() over (partition by repo order by file) as place from nodes where folder < 3)
select * from k where place <= 30 union all select * from i where place <= 10 union all select * from c where place <= 15 union all select * from e where place <= 50""")
def q168_fact_selection(spark, d):
    e, n = edges(spark, d), nodes(spark, d)
    return S.select_facts(G.file_metrics(G.degrees(n, e), H.reach_counts(e)), H.in_cycle(e), n.filter("folder < 3"))


@query("""with f as (select lower(replace(p_brand, '#', '')) as brand, p_type as tag, count(*) as n from part group by all), t as (select brand, arg_min(tag, (-n, tag)) as tag, sum(n)::bigint as files from f group by brand) select brand, case when files > 1 then 'src/' || brand else 'src/' || brand end as prefix, tag, files from t""")
def q165_domain_lanes(spark, d):
    files = _part_files(spark, d).join(table(spark, d, "part").select("p_partkey", F.col("p_type").alias("tag")), "p_partkey")
    return S.domain_lanes(files.withColumn("brand", F.element_at(F.split("path", "/"), 2)), "brand")


#: A document for each customer: its orders stay, lists of its lines by kind may go; of every fifth document the list of routes is lost.
_DOC = """l as (select o_custkey as doc, l_returnflag as f, array_to_string(list_sort(list(l_partkey)), ',') as value from lineitem join orders on o_orderkey = l_orderkey group by all),
x as (select doc, case f when 'A' then 'cpgEdges' when 'N' then 'routes' else 'edges' end as field, case f when 'A' then 1 when 'N' then 2 else 3 end as place, value from l
  union all select o_custkey, 'core', null, array_to_string(list_sort(list(o_orderkey)), ',') from orders group by o_custkey),
s as (select *, strlen(value) as size, sum(strlen(value)) over (partition by doc) - coalesce(sum(case when place is not null then strlen(value) else 0 end) over (partition by doc order by place nulls last, field rows between unbounded preceding and 1 preceding), 0) > 150 and place is not null as gone from x)"""


@query(f"""with {_DOC}, m as (select doc, string_agg(field, ',' order by place) filter (where gone) as shed, sum(size)::bigint as bytes, coalesce(sum(size) filter (where not gone), 0)::bigint as kept_bytes from s group by doc)
select doc, shed, bytes, kept_bytes, kept_bytes > 150 as too_large, case when doc % 5 = 0 and list_contains(string_split(shed, ','), 'routes') then 'routes' else '' end as missing,
  (select sum(size) from s where s.doc = m.doc and not (gone and doc % 5 = 0 and field = 'routes'))::bigint as back_bytes from m where shed is not null or kept_bytes > 150""")
def q015_overflow(spark, d):
    l = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")  # noqa: E741
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x.cast("string")), ",").alias("value")
    kind = lambda *v: F.when(F.col("l_returnflag") == "A", v[0]).when(F.col("l_returnflag") == "N", v[1]).otherwise(v[2])
    lists = l.groupBy(F.col("o_custkey").alias("doc"), "l_returnflag").agg(listed("l_partkey")).select("doc", kind("cpgEdges", "routes", "edges").alias("field"), kind(1, 2, 3).alias("place"), "value")
    core = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc")).agg(listed("o_orderkey")).select("doc", F.lit("core").alias("field"), F.lit(None).cast("int").alias("place"), "value")
    stored, side, told = S.split_overflow(lists.union(core), 150)
    back, missing = S.rehydrate(stored, side.filter("not (doc % 5 = 0 and field = 'routes')"), told)
    size = back.groupBy("doc").agg(F.sum(F.octet_length("value")).alias("back_bytes"))
    shed = F.when(F.size("shed") > 0, F.array_join("shed", ","))
    return told.join(missing, "doc", "left").join(size, "doc").select("doc", shed.alias("shed"), "bytes", "kept_bytes", "too_large", F.coalesce(F.array_join("missing", ","), F.lit("")).alias("missing"), "back_bytes")


@query("select vec_id as id, len(embedding) as dim from embeddings")
def q063_one_space(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit("m").alias("model"), F.col("embedding").alias("v"))
    return S.same_space(v, "m", 64).select("id", F.size("v").cast("long").alias("dim"))


@query("select p_partkey, p_partkey % 2 = 0 as member from part")
def q227_sandbox(spark, d):
    files = _part_files(spark, d).select("p_partkey", "path")
    asked = files.select(F.when(F.col("p_partkey") % 2 == 0, F.col("path")).otherwise(F.concat("path", F.lit("x"))).alias("path"), F.lit("abc").alias("commit"))
    out = S.sandbox(files, asked, "abc")
    return out.select(F.regexp_extract("path", r"f(\d+)\.", 1).cast("long").alias("p_partkey"), "member")
