"""Queries of the graph operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import graph as G
from .operators import ordered_graph as O
from .operators import reach as H
from .operators import support as U
from .sources.bindings import EDGES_SQL, NODES_SQL, edges, nodes

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        name = f.__name__
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


#: All pairs by nodes, not by walks: a round adds the pairs that no round before it has, so each has its least depth.
_REACH = """
steps as (select distinct repo, src, dst from edges where src <> dst),
reach(repo, src, dst, depth) using key (repo, src, dst) as (
  select repo, src, dst, 1 from steps
  union
  select w.repo, w.src, s.dst, min(w.depth + 1) from reach w join steps s on s.repo = w.repo and s.src = w.dst left join recurring.reach k on k.repo = w.repo and k.src = w.src and k.dst = s.dst
  where s.dst <> w.src and k.depth is null group by all)"""
_DEGREE = """
degree as (
  select n.repo, n.file, loc, symbols, folder, coalesce(i, 0)::bigint as fan_in, coalesce(o, 0)::bigint as fan_out, coalesce(i, 0)::bigint + coalesce(o, 0)::bigint as degree
  from nodes n left join (select repo, dst as file, count(*) as i from edges group by all) using (repo, file)
       left join (select repo, src as file, count(*) as o from edges group by all) using (repo, file))"""
_BASE = f"with recursive {EDGES_SQL.strip()}, {NODES_SQL.strip()}"


@query(f"with {EDGES_SQL} select repo, src, dst, kind, line, evidence, max(confidence) as confidence, 1 as weight from edges group by repo, src, dst, kind, line, evidence")
def q084_build_graph(spark, d):
    return G.build_graph(edges(spark, d))


@query(f"""with {EDGES_SQL}, cpg as (select repo, src, dst, kind, count(*) as n from edges group by all)
select repo, src, dst, 'import' as type, 1::bigint as weight from cpg where kind = 'import' union all
select repo, src, dst, case kind when 'call' then 'call' else 'extends' end, n from cpg where kind <> 'import'""")
def q085_unified_graph(spark, d):
    return G.unified_graph(edges(spark, d))


@query(f"with {EDGES_SQL} select repo, src, dst, kind, count(*) as count, min(line) as line from edges group by all")
def q086_code_property_graph(spark, d):
    return G.code_property_graph(edges(spark, d))


@query(f"with {EDGES_SQL} select case kind when 'inheritance' then 'extends' else kind end as type, count(*) as n from edges group by all")
def q087_edge_types(spark, d):
    return edges(spark, d).groupBy(G.edge_type(F.col("kind")).alias("type")).agg(F.count("*").alias("n"))


@query(f"""with {EDGES_SQL}, {NODES_SQL}, {_DEGREE} select repo, file, fan_out as dependencies, fan_in as dependents from degree where degree > 0""")
def q088_direct_dependents(spark, d):
    return G.direct(edges(spark, d))


@query(f"{_BASE}, {_REACH} select repo, src, dst, depth from reach where depth <= 4")
def q089_closure_to_depth_4(spark, d):
    return G.closure(edges(spark, d), max_depth=4)


@query(f"{_BASE}, {_REACH} select repo, src, dst, depth from reach")
def q089_closure(spark, d):
    return G.closure(edges(spark, d))


@query(f"""{_BASE}, steps as (select distinct repo, src, dst from edges where src <> dst and confidence >= 0.8),
walk(repo, src, dst, depth) as (
  select repo, src, dst, 1 from steps where (repo, src) in (select (repo, min(file)) from nodes group by repo)
  union select w.repo, w.src, s.dst, w.depth + 1 from walk w join steps s on s.repo = w.repo and s.src = w.dst where s.dst <> w.src and w.depth < 40)
select repo, src, dst, min(depth) as depth from walk group by all""")
def q089_closure_from_first_file(spark, d):
    first = nodes(spark, d).groupBy("repo").agg(F.min("file").alias("src"))
    return G.closure(G.allowed(edges(spark, d), 0.8), starts=first)


@query(f"""{_BASE}, {_REACH}, {_DEGREE}, i as (select repo, dst as file, count(*) as dependents from reach group by all), o as (select repo, src as file, count(*) as dependencies from reach group by all)
select repo, file, fan_in, fan_out, degree, coalesce(dependents, 0)::bigint as dependents, coalesce(dependencies, 0)::bigint as dependencies from degree left join i using (repo, file) left join o using (repo, file)""")
def q090_degree_centrality(spark, d):
    e = edges(spark, d)
    return G.centrality(G.degrees(nodes(spark, d), e), H.reach_counts(e)).select("repo", "file", "fan_in", "fan_out", "degree", "dependents", "dependencies")


_CYCLIC = """
cyclic as (
  select repo, file, least(file, min(dst)) as component from (
    select x.repo, x.src as file, x.dst from reach x join reach y on y.repo = x.repo and y.src = x.dst and y.dst = x.src
    union all select repo, src, dst from edges where src = dst) group by repo, file)"""


#: A search against the edges from each file t, level by level in the order in which it comes to files (pos).
_VIA = """
one as (select repo, src, dst, arg_min(confidence, (kind, line, evidence, confidence)) as c from edges where src <> dst group by all),
via(repo, t, u, depth, pos, c) using key (repo, t, u) as (
  select repo, dst, src, 1, row_number() over (partition by repo, dst order by src), c from one
  union
  select repo, t, u, depth, row_number() over (partition by repo, t order by pos, u), c from (
    select v.repo, v.t, s.src as u, min(v.depth) + 1 as depth, min(v.pos) as pos, arg_min(s.c, v.pos) as c
    from via v join one s on s.repo = v.repo and s.dst = v.u left join recurring.via k on k.repo = v.repo and k.t = v.t and k.u = s.src where s.src <> v.t and k.depth is null group by v.repo, v.t, s.src))"""


@query(f"""{_BASE}, {_REACH}, {_CYCLIC}, {_VIA},
i as (select repo, dst as file, count(*) as direct, sum(confidence) as own from edges group by all),
f as (select repo, t as file, count(*) as affected, max(depth) as max_depth, sum(c) as via from via group by all),
x as (select repo, file, coalesce(direct, 0) as direct, coalesce(affected, 0) as affected, coalesce(max_depth, 0) as max_depth,
        round(case when coalesce(direct, 0) + coalesce(affected, 0) = 0 then 1 else (coalesce(via, 0) + coalesce(own, 0)) / (coalesce(direct, 0) + coalesce(affected, 0)) end, 6) as confidence, component is not null as cyclic
      from nodes left join i using (repo, file) left join f using (repo, file) left join cyclic using (repo, file))
select repo, file, direct, confidence, affected, max_depth,
  concat_ws(',', case when affected > 10 then 'wide' end, case when direct > 5 then 'many-incoming' end, case when confidence < 0.7 then 'low-confidence' end, case when cyclic then 'cycle' end) as reasons from x""")
def q091_blast_radius(spark, d):
    e = edges(spark, d)
    return G.blast_radius(nodes(spark, d), e, H.dependents_by_edge(e), H.in_cycle(e))


@query(f"{_BASE}, {_REACH}, {_CYCLIC} select * from cyclic")
def q092_in_cycle(spark, d):
    return H.in_cycle(edges(spark, d))


@query()
def q092_cycles(spark, d):
    return O.cycles(edges(spark, d))


@query(f"""with {EDGES_SQL}, {NODES_SQL} select repo, file, loc, symbols, folder from nodes n
where not exists (select 1 from edges e where e.repo = n.repo and n.file in (e.src, e.dst))""")
def q093_isolated_files(spark, d):
    return G.isolated(nodes(spark, d), edges(spark, d))


@query(f"""{_BASE}, {_REACH}, {_DEGREE},
x as (select degree.*, coalesce(affected, 0) as affected from degree left join (select repo, dst as file, count(*) as affected from reach group by all) using (repo, file)),
y as (select repo, file, concat_ws(',', case when fan_in >= 5 then 'fan-in' end, case when fan_out >= 8 then 'fan-out' end, case when degree >= 10 then 'degree' end, case when affected >= 10 then 'blast-radius' end) as reasons from x)
select * from y where reasons <> ''""")
def q094_high_coupling(spark, d):
    e = edges(spark, d)
    return G.high_coupling(G.degrees(nodes(spark, d), e), H.reach_counts(e))


@query()
def q095_communities(spark, d):
    return O.communities(edges(spark, d))


@query(f"""with {EDGES_SQL}, p as (select repo, src as a, dst as b from edges), q as (select * from p union all select repo, b, a from p where a <> b)
select repo, a, b, count(*) as weight from q group by all""")
def q096_undirected_projection(spark, d):
    return G.undirected(edges(spark, d))


@query(f"""with {EDGES_SQL}, {NODES_SQL}, p as (select repo, src as a, dst as b from edges), q as (select repo, a, b from p union all select repo, b, a from p),
w as (select q.repo, x.folder as ca, y.folder as cb from q join nodes x on x.repo = q.repo and x.file = a join nodes y on y.repo = q.repo and y.file = b),
e as (select repo, ca, count(*) as total, count(*) filter (where ca = cb) as inside from w group by all),
s as (select repo, sum(total) as m, sum(inside) as i, sum(total * total) as t from e group by repo)
select repo, round(i / m - t / (m * m), 9) as modularity, i / 2 as internal, (m - i)::double as external from s""")
def q097_modularity_of_folders(spark, d):
    return G.modularity(edges(spark, d), nodes(spark, d).select("repo", "file", F.col("folder").alias("cluster")))


@query(f"""{_BASE}, {_REACH}, {_CYCLIC}, {_DEGREE},
x as (select degree.*, coalesce(affected, 0) as affected from degree left join (select repo, dst as file, count(*) as affected from reach group by all) using (repo, file)),
r as (select *, row_number() over (partition by repo order by degree desc, file) as k from x)
select repo, count(*) as files, count(*) filter (where degree = 0) as isolated, round(avg(degree), 6) as mean_degree, string_agg(file::varchar, ',' order by k) filter (where k <= 5) as top,
  coalesce((select count(*) from edges e where e.repo = r.repo), 0) as edges, coalesce((select count(*) from cyclic c where c.repo = r.repo), 0) as cyclic,
  count(*) filter (where fan_in >= 5 or fan_out >= 8 or degree >= 10 or affected >= 10) as coupled from r group by repo""")
def q099_graph_summary(spark, d):
    e = edges(spark, d)
    degree = G.degrees(nodes(spark, d), e)
    return G.summary(degree, e, H.in_cycle(e), G.high_coupling(degree, H.reach_counts(e)))


@query(f"""with {EDGES_SQL}, {NODES_SQL}, {_DEGREE}, k as (select * from (select *, row_number() over (partition by repo order by degree desc, file) as r from degree) where r <= 10)
select repo, count(*) as nodes, (select count(*) from edges e where e.repo = k.repo and exists (select 1 from k a where a.repo = e.repo and a.file = e.src) and exists (select 1 from k b where b.repo = e.repo and b.file = e.dst)) as links from k group by repo""")
def q100_capped_graph(spark, d):
    e = edges(spark, d)
    keep, inside = G.capped(G.degrees(nodes(spark, d), e), e, 10)
    return keep.groupBy("repo").agg(F.count("*").alias("nodes")).join(inside.groupBy("repo").agg(F.count("*").alias("links")), "repo", "left").fillna(0, ["links"])


_METRICS = """
metrics as (
  select repo, file, degree as centrality, fan_in, fan_out, coalesce(b, 0) as blast_radius, loc + symbols + degree as complexity
  from degree left join (select repo, dst as file, count(*) as b from reach group by all) using (repo, file))"""


@query(f"{_BASE}, {_REACH}, {_DEGREE}, {_METRICS} select * from metrics")
def q101_file_metrics(spark, d):
    e = edges(spark, d)
    return G.file_metrics(G.degrees(nodes(spark, d), e), H.reach_counts(e))


@query(f"""{_BASE}, {_REACH}, {_CYCLIC}, {_DEGREE}, {_METRICS},
n as (select repo, count(*) as n, count(*) filter (where centrality = 0) as alone from metrics group by repo),
g as (select repo, component, count(*) as size from cyclic group by all),
x as (select repo, 'cycle' as issue, case when size >= 4 then 'high' else 'medium' end as severity, component as file from g
union all select repo, 'blast-radius', case when blast_radius / n >= 0.5 then 'high' else 'medium' end, file from metrics join n using (repo) where n >= 8 and blast_radius / n >= 0.25
union all select repo, 'coupling', 'low', file from metrics where centrality >= 20
union all select repo, 'isolated', 'low', null from n where alone > 0 and alone * 2 >= n)
select *, row_number() over (partition by repo order by case severity when 'high' then 0 when 'medium' then 1 else 2 end, issue, file nulls last)::int as place from x""")
def q102_issues(spark, d):
    e = edges(spark, d)
    return G.issues(G.file_metrics(G.degrees(nodes(spark, d), e), H.reach_counts(e)), H.in_cycle(e))


@query(f"""{_BASE}, {_REACH}, {_CYCLIC}, {_DEGREE}, {_METRICS},
x as (select repo, count(*) as n, max(blast_radius) as widest, count(*) filter (where centrality = 0) as alone, coalesce((select count(distinct component) from cyclic c where c.repo = m.repo), 0) as cycles from metrics m group by repo),
y as (select *, floor(100 - 40 * least(1, 10 * cycles / n) - 35 * least(1, widest / n) - 15 * least(1, alone / n) + 0.5)::int as health from x)
select repo, cycles, widest, alone, health, case when health >= 90 then 'A' when health >= 80 then 'B' when health >= 70 then 'C' when health >= 60 then 'D' else 'F' end as grade from y""")
def q103_health(spark, d):
    e = edges(spark, d)
    return G.health(G.file_metrics(G.degrees(nodes(spark, d), e), H.reach_counts(e)), H.in_cycle(e))


@query(f"""with {NODES_SQL} select repo, count(*) as files, sum(loc)::bigint as loc, sum(symbols)::bigint as symbols, count(distinct folder) as folders, array_to_string(list_sort(list(distinct folder)), ',') as folder_list from nodes group by repo""")
def q104_repo_summary(spark, d):
    return U.repo_summary(nodes(spark, d))


@query(f"""{_BASE}, {_REACH} select repo, dst as file, count(*) filter (where depth = 1) as tier1, count(*) filter (where depth = 2) as tier2, count(*) filter (where depth = 3) as tier3, count(*) filter (where depth >= 4) as tier4 from reach group by all""")
def q105_hop_tiers(spark, d):
    return G.hop_tiers(H.reach_counts(edges(spark, d)))


@query(f"""with {EDGES_SQL}, {NODES_SQL} select e.repo, case when x.folder % 5 = y.folder % 5 then 'data' when x.folder % 5 > y.folder % 5 then 'control' else 'violation' end as class, count(*) as n
from edges e join nodes x on x.repo = e.repo and x.file = src join nodes y on y.repo = e.repo and y.file = dst group by all""")
def q107_edge_classes(spark, d):
    return G.edge_classes(edges(spark, d), nodes(spark, d))


@query(f"""{_BASE}, {_REACH}, f as (select r.repo, r.dst as file, count(*) as affected, count(*) filter (where x.folder <> y.folder) as abroad
  from reach r join nodes x on x.repo = r.repo and x.file = r.src join nodes y on y.repo = r.repo and y.file = r.dst group by all)
select repo, file, coalesce(affected, 0) as affected, coalesce(abroad, 0) as abroad, coalesce(affected, 0) <= 5 and coalesce(abroad, 0) = 0 as safe from nodes left join f using (repo, file)""")
def q108_safe_to_change(spark, d):
    n = nodes(spark, d)
    return G.safe_to_change(n, H.reach_counts(edges(spark, d), n))


#: The API is what lies in the folders 0 to 4, tests in 20 and above, entry points are files with one symbol.
_API, _TEST, _ENTRY = "folder < 5", "folder >= 20", "symbols = 1"


@query(f"""{_BASE}, {_REACH}, i as (select e.repo, e.dst as file, count(distinct e.src) as importers, bool_or(x.folder <> y.folder) as elsewhere
  from edges e join nodes x on x.repo = e.repo and x.file = e.src join nodes y on y.repo = e.repo and y.file = e.dst group by all),
f as (select r.repo, r.dst as file, count(*) as affected, min(depth) filter (where x.{_API}) as api, count(*) filter (where x.{_TEST}) as tests, min(depth) filter (where x.{_TEST}) as hops
  from reach r join nodes x on x.repo = r.repo and x.file = r.src group by all)
select repo, file, coalesce(importers, 0) + 1 as files_to_edit, case when {_API} then 0 else api end as api_hops, coalesce(tests, 0) as tests, hops as test_hops, coalesce(affected, 0) as affected, coalesce(affected, 0) <= 5 as alone,
  case when coalesce(affected, 0) = 0 then 'nothing depends on it' when affected <= 5 then 'reviewable in one change' else 'stage it' end as advice, {_ENTRY} or coalesce(elsewhere, false) as entry_probable
from nodes left join i using (repo, file) left join f using (repo, file)""")
def q108_change_impact(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    counts = H.reach_counts(e, n, {"api": F.expr(_API), "tests": F.expr(_TEST)})
    return G.change_impact(n, e, counts, F.expr(_API), F.expr(_ENTRY))


@query(f"""with {EDGES_SQL}, {NODES_SQL}, {_DEGREE}, r as (select *, row_number() over (partition by repo order by fan_in desc, file) as k, count(*) over (partition by repo) as n from degree qualify k <= 64),
g as (select *, (case when k = 1 then 0 else ceil((k - 1) / ceil((least(n, 64) - 1) / 5)) end)::int as ring from r),
a as (select *, 2 * pi() * (row_number() over (partition by repo, ring order by k) - 1) / count(*) over (partition by repo, ring) as angle from g)
select repo, file, ring, round(ring * cos(angle), 6) + 0.0 as x, round(ring * sin(angle), 6) + 0.0 as y from a""")
def q109_ring_layout(spark, d):
    return G.ring_layout(G.degrees(nodes(spark, d), edges(spark, d)))


@query(f"""{_BASE}, {_REACH}, {_CYCLIC} select e.repo, coalesce(x.component = y.component, false) as in_cycle, count(*) as n
from edges e left join cyclic x on x.repo = e.repo and x.file = src left join cyclic y on y.repo = e.repo and y.file = dst group by all""")
def q110_view_model(spark, d):
    e = edges(spark, d)
    return G.view_model(nodes(spark, d), e, H.in_cycle(e)).groupBy("repo", "in_cycle").agg(F.count("*").alias("n"))


@query(f"""with {EDGES_SQL}, {NODES_SQL}, c as (select repo, min(file) as file from nodes group by repo)
select distinct e.repo, c.file as centre, case when e.src = c.file then e.dst else e.src end as file from edges e join c on c.repo = e.repo and (c.file = e.src or c.file = e.dst) where e.src <> e.dst""")
def q111_focus(spark, d):
    return G.focus(edges(spark, d), nodes(spark, d).groupBy("repo").agg(F.min("file").alias("file")))
