"""Queries of inventory, citation, enrichment, tool and state operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import text as T
from .graph_queries import _BASE, _CYCLIC, _DEGREE, _METRICS, _REACH
from .operators import evaluation as E
from .operators import graph as G
from .operators import inventory as I
from .operators import ordered_graph as O
from .operators import reach as H
from .operators import relational as L
from .operators import retrieval as R
from .operators import support as U
from .operators import telemetry as M
from .plans import registry as X
from .retrieval_queries import _POSTINGS, chunks, index, questions
from .sources import scan as C
from .sources.bindings import EDGES_SQL, NODES_SQL, edges, nodes, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("select source as repo, count(*) as files, sum(octet_length(encode(text)))::bigint as bytes, count(*) <= 25000 and sum(octet_length(encode(text))) <= 536870912 as accepted from documents group by source")
def q002_size_guard(spark, d):
    return C.measure(table(spark, d, "documents").select(F.col("source").alias("repo"), F.octet_length("text").cast("long").alias("size_bytes")), "repo")


@query("select source as repo, count(*) as files, sum(octet_length(encode(text)))::bigint as bytes, count(*) <= 60 and sum(octet_length(encode(text))) <= 100000 as accepted from documents group by source")
def q003_size_guard_of_own_limits(spark, d):
    return C.measure(table(spark, d, "documents").select(F.col("source").alias("repo"), F.octet_length("text").cast("long").alias("size_bytes")), "repo", 60, 100_000)


def _manifests(spark, d):
    """A package.json for each customer: its segment is a dependency, its balance decides the rest."""
    c = table(spark, d, "customer")
    dep = F.when(F.col("c_nationkey") % 3 == 0, "react").when(F.col("c_nationkey") % 3 == 1, "express").otherwise("left-pad")
    extra = F.when(F.col("c_custkey") % 4 == 0, ', "bin": {"x": "./bin/x.js"}').when(F.col("c_custkey") % 4 == 1, ', "main": "lib/main.js", "exports": {".": {"import": "./lib/a.mjs"}}').when(F.col("c_custkey") % 4 == 2, ', "workspaces": ["p"]').otherwise("")
    content = F.concat(F.lit('{"dependencies": {"'), dep, F.lit('": "1"}, "devDependencies": {"vue": "2"}'), extra, F.lit("}"))
    py = c.filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("repo"), F.lit("pyproject.toml").alias("path"), F.lit("dependencies = ['FastAPI']").alias("content"))
    return c.select(F.col("c_custkey").alias("repo"), F.lit("package.json").alias("path"), content.alias("content")).union(py)


@query("""select c_custkey as repo, 'package.json' as path, 'npm' as ecosystem, case c_nationkey % 3 when 0 then 'React,Vue' when 1 then 'Express,Vue' else 'Vue' end as frameworks, c_custkey % 4 = 0 as bin, c_custkey % 4 = 2 as workspaces, c_custkey % 4 = 1 as library from customer
union all select c_custkey, 'pyproject.toml', 'pip', 'FastAPI', false, false, false from customer where c_custkey % 5 = 0""")
def q043_manifests(spark, d):
    return I.manifests(_manifests(spark, d))


@query("select c_custkey as repo, case c_custkey % 4 when 0 then 'cli' when 1 then 'library' when 2 then 'monorepo' else 'application' end as type from customer")
def q044_project_type(spark, d):
    return I.project_type(I.manifests(_manifests(spark, d)))


@query("select c_custkey as repo, case when c_custkey % 5 = 0 then 'pyproject.toml' else 'package.json' end as path from customer")
def q017_first_manifest(spark, d):
    return I.first_of(_manifests(spark, d), ["setup.py", "pyproject.toml", "package.json"]).select("repo", "path")


@query("""select c_custkey as repo, 'bin/x.js' as file, 'cli-bin' as kind, 'package-json-bin' as evidence from customer where c_custkey % 4 = 0
union all select c_custkey, 'lib/main.js', 'main', 'package-json-main' from customer where c_custkey % 4 = 1 union all select c_custkey, 'lib/a.mjs', 'main', 'package-json-exports' from customer where c_custkey % 4 = 1
union all select c_custkey, 'src/server.ts', 'server', 'filename-convention' from customer where c_custkey % 2 = 0""")
def q042_entry_points(spark, d):
    own = _manifests(spark, d).filter("path = 'package.json'").withColumn("role", F.lit("config"))
    server = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("repo"), F.lit("src/server.ts").alias("path"), F.lit("").alias("content"), F.lit("source").alias("role"))
    other = server.withColumn("path", F.lit("src/other.ts"))
    return I.entry_points(own.union(server).union(other))


@query("select p_partkey, case p_partkey % 6 when 0 then 'function' when 1 then 'function' when 2 then 'interface' when 3 then 'enum' when 4 then 'variable' else 'class' end as kind from part")
def q041_symbol_kind(spark, d):
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", I.symbol_kind(pick("hook", "component", "unknown", "unknown", "unknown", "class"), pick("", "", "export interface A", "const enum B", "x = 1", "class C")).alias("kind"))


@query("select p_partkey, case p_partkey % 7 when 0 then 'data-configuration' when 1 then 'clients-entry' when 2 then 'platform-libraries' when 3 then 'edge-transport' when 4 then 'domain-engine' when 5 then 'unclassified' else 'data-configuration' end as lane from part")
def q106_lanes(spark, d):
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("p_partkey") % 7 + 1).cast("int"))
    path, role = pick("a/config.yaml", "lib/a.test.ts", "src/utils/x.ts", "http/api.ts", "src/zzz/y.ts", "notes/z.txt", "src/server/models/q.ts"), pick("config", "test", "source", "source", "source", "other", "source")
    return table(spark, d, "part").select("p_partkey", I.lane(path, role, F.lit(False)).alias("lane"))


@query("""select doc_id, 'https://h/o/r/blob/abc1234/src/a%20b/' || doc_id || '.ts#L1' || case when doc_id % 3 = 0 then '' else '-L' || (1 + doc_id % 3) end as url,
  'src/a b/' || doc_id || '.ts:1' || case when doc_id % 3 = 0 then '' else '-' || (1 + doc_id % 3) end as label, 'a b/' || doc_id as module from documents""")
def q067_citations(spark, d):
    path = F.concat(F.lit("src/a b/"), F.col("doc_id").cast("string"), F.lit(".ts"))
    start, end = F.lit(1), (1 + F.col("doc_id") % 3).cast("int")
    return table(spark, d, "documents").select("doc_id", I.citation_url(F.lit("https://h/o/r"), F.lit("abc1234"), path, start, end).alias("url"), I.citation_label(path, start, end).alias("label"), I.module_label(path).alias("module"))


@query("select o_custkey, sum(case when o_orderkey % 10 = 0 then 0 else o_orderkey end)::double as tokens, not bool_or(o_orderkey % 10 = 0) as measured from orders group by o_custkey")
def q069_usage(spark, d):
    o = table(spark, d, "orders").withColumn("tokens", F.when(F.col("o_orderkey") % 10 == 0, "n/a").otherwise(F.col("o_orderkey").cast("string")))
    return I.usage(o, "o_custkey")


_RANGES = "r as (select l_orderkey as file, l_partkey as name, l_linenumber * 10 as s, l_linenumber * 10 + l_quantity::int as e, l_returnflag from lineitem)"


def _ranges(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("name"), (F.col("l_linenumber") * 10).cast("int").alias("start"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")).cast("int").alias("end"), "l_returnflag")


@query(f"""with {_RANGES}, c as (select distinct file, s, e from r where l_returnflag = 'R') select c.file, c.s as start, c.e as "end", exists (select 1 from r where r.file = c.file and l_returnflag <> 'R' and r.s <= c.s and r.e >= c.e) as grounded from c""")
def q060_citation_containment(spark, d):
    r = _ranges(spark, d)
    return I.cited_in(r.filter("l_returnflag = 'R'").select("file", "start", "end").distinct(), r.filter("l_returnflag <> 'R'"))


@query(f"""with {_RANGES} select a.file, count(*) as n, count(distinct a.name) as chunks from r a join r b on a.file = b.file and a.l_returnflag = 'N' and b.l_returnflag = 'R' and a.s <= b.e and a.e >= b.s group by a.file""")
def q061_chunk_hits(spark, d):
    r = _ranges(spark, d)
    met = I.hits(r.filter("l_returnflag = 'N'").withColumn("chunk", F.struct("file", "name")), r.filter("l_returnflag = 'R'").withColumn("target", F.col("name")))
    return met.groupBy(F.col("chunk.file").alias("file")).agg(F.count("*").alias("n"), F.count_distinct("chunk.name").alias("chunks"))


@query(f"""with {_RANGES}, c as (select distinct file, name, s, e from r where l_returnflag = 'N'), y as (select distinct file, name, s, e from r where l_returnflag <> 'N'),
a as (select c.file, c.name as chunk, c.s as cs, c.e as ce, y.name, y.s - y.e as w, y.s as s from c join y on y.file = c.file and y.s <= c.s and y.e >= c.e and y.name <> c.name and (y.s <> c.s or y.e <> c.e)),
f as (select file, chunk, cs, ce, name, min((w, s)) as k from a group by all) select file, chunk, string_agg(name::varchar, ' > ' order by k, name::varchar) as scope from f group by file, chunk, cs, ce""")
def q124_scope_chains(spark, d):
    r = _ranges(spark, d)
    c = r.filter("l_returnflag = 'N'").select("file", F.struct("name", "start", "end").alias("chunk"), "start", "end", F.col("name").cast("string").alias("symbol")).distinct()
    out = I.scope_chains(c, r.filter("l_returnflag <> 'N'").select("file", F.col("name").cast("string").alias("name"), "start", "end").distinct())
    return out.select("file", F.col("chunk.name").alias("chunk"), "scope")


@query("""select o_custkey, case when max(o_orderkey) % 4 <> 0 or max(o_orderkey) % 10 = 0 then 'deterministic-only' else 'full' end as mode,
  concat_ws(',', case when max(o_orderkey) % 4 in (1, 3) then 'no-chat-provider' end, case when max(o_orderkey) % 4 in (2, 3) then 'no-embedding-provider' end, case when max(o_orderkey) % 10 = 0 then 'budget-exhausted' end) as degradations from orders group by o_custkey""")
def q217_run_mode(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("k"))
    skipped = F.array_compact(F.array(F.when(F.col("k") % 2 == 1, "synthesize"), F.when(F.col("k") % 4 >= 2, "rag")))
    return o.select("o_custkey", *I.run_mode(skipped, F.col("k") % 10 == 0))


@query(f"""{_BASE}, {_REACH}, {_CYCLIC}, {_DEGREE}, c as (select repo, arg_min(file, (-degree, file)) as central from degree group by repo), e as (select repo, min(file) as entry from nodes where folder < 5 group by repo), r as (select repo, min(file) as cycle from cyclic group by repo),
q as (select c.repo, list_filter(['What breaks if I change ' || central || '?', 'What happens when ' || entry || ' runs?', 'Why is there a cycle through ' || cycle || '?', 'What''s safe to delete?'], lambda x: x is not null) as q from c left join e using (repo) left join r using (repo))
select repo, array_to_string(q[1:3], ' ') as questions from q""")
def q170_suggested_questions(spark, d):
    e, n = edges(spark, d), nodes(spark, d)
    central = G.degrees(n, e).groupBy("repo").agg(F.min_by("file", F.struct(-F.col("degree"), "file")).alias("central"))
    entry = n.filter("folder < 5").groupBy("repo").agg(F.min("file").alias("entry"))
    cycle = H.in_cycle(e).groupBy("repo").agg(F.min("file").alias("cycle"))
    return I.suggested_questions(central.join(entry, "repo", "left").join(cycle, "repo", "left"))


@query(f"""with {EDGES_SQL}, {NODES_SQL}, b as (select e.repo, src, dst, x.folder % 5 as cs, y.folder % 5 as cd from edges e join nodes x on x.repo = e.repo and x.file = src join nodes y on y.repo = e.repo and y.file = dst),
u as (select repo, cs as cluster, 'internal' as side, src, dst from b where cs = cd union all select repo, cd, 'inbound', src, dst from b where cs <> cd union all select repo, cs, 'outbound', src, dst from b where cs <> cd union all select repo, folder % 5, 'file', file, file from nodes),
k as (select *, row_number() over (partition by repo, cluster, side order by src, dst) as k from u) select repo, cluster, side, count(*) as shown, min(src) as first, max(dst) as last from k where k <= case side when 'file' then 25 else 40 end group by all""")
def q159_fact_packs(spark, d):
    n = nodes(spark, d)
    return I.fact_packs(n, edges(spark, d), n.select("repo", "file", (F.col("folder") % 5).alias("cluster")))


@query(f"""{_BASE}, {_REACH}, {_DEGREE}, {_METRICS}, o as (select repo, file, row_number() over (partition by repo order by fan_in desc, file) as p from metrics), k as (select repo, file, row_number() over (partition by repo order by centrality desc, file) as p from metrics),
s as (select repo, file from o where p <= 5 union select repo, file from k where p <= 5), x as (select repo, file from nodes where folder < 6),
r as (select x.repo, avg((s.file is not null)::int) as recall from x left join s using (repo, file) group by x.repo), g as (select o.repo, avg((n.folder <> 3)::int) as resolved from o join nodes n using (repo, file) group by o.repo)
select g.repo, round(coalesce(recall, 1), 6) as recall, round(resolved, 6) as resolved from g left join r using (repo)""")
def q172_synthesis_scores(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    m = G.degrees(n, e)
    place = lambda c: m.withColumn("position", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc(c), "file")))
    return I.synthesis_scores(place("fan_in"), place("degree"), n.filter("folder < 6"), n.filter("folder <> 3"), 5)


@query("""with s as (select p_name as name, 'p' || p_partkey as path from part), q as (select distinct case when p_size % 2 = 0 then p_name else upper(split_part(p_name, ' ', 1)) end as asked from part where p_partkey % 1 = 0),
x as (select asked, name, path, true as exact from q join s on s.name = q.asked), y as (select asked, name, path, false as exact from q join s on contains(lower(s.name), lower(q.asked)) where asked not in (select asked from x)),
k as (select *, row_number() over (partition by asked order by path, name) as k from (select * from x union all select * from y)) select * from k where k <= 25""".replace(" where p_partkey % 1 = 0", ""))
def q150_symbol_search(spark, d):
    p = table(spark, d, "part")
    names = p.select(F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.upper(F.split_part("p_name", F.lit(" "), F.lit(1)))).alias("name")).distinct()
    return I.symbol_search(p.select(F.col("p_name").alias("name"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path")), names)


@query(f"with {EDGES_SQL} select repo, dst as file, count(*) as references, count(*) filter (where kind = 'call') as callers, array_to_string(list_sort(list(distinct src))[1:10], ',') as shown from edges group by all")
def q149_callers_and_references(spark, d):
    return U.references(edges(spark, d))


@query("""with r as (select o_custkey as repo, o_orderkey as snap, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as k from orders), n as (select repo, l_suppkey as file from r join lineitem on l_orderkey = snap where k = 1), o as (select repo, l_suppkey as file from r join lineitem on l_orderkey = snap where k = 2)
select repo, count(distinct file) filter (where a is null) as added, count(distinct file) filter (where b is null) as removed from (select coalesce(n.repo, o.repo) as repo, coalesce(n.file, o.file) as file, n.file as b, o.file as a from n full join o on n.repo = o.repo and n.file = o.file) group by repo""")
def q152_what_changed(spark, d):
    snapshots = table(spark, d, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("snap"), F.col("o_orderdate").alias("at"))
    return U.what_changed(snapshots, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("snap"), F.col("l_suppkey").alias("file")))


#: A scorer in a model's place: the share of the query's words in the text's first 2000 characters.
def _share(queries: list[str], texts: list[str]) -> list[float]:
    return [len(set(q.split()) & set(t.split())) / max(len(set(q.split())), 1) for q, t in zip(queries, texts, strict=True)]


@query(rf"""with {_POSTINGS}, h as (select * from lexical where rank <= 20), w as (select query_id, id, list_distinct(list_filter(string_split_regex(b.text, '\s+'), lambda x: x <> '')) as q, list_distinct(list_filter(string_split_regex(substr(d.text, 1, 2000), '\s+'), lambda x: x <> '')) as t
  from h join benchmark b on b.item_id = query_id join documents d on d.doc_id = id), s as (select query_id, id, round(len(list_intersect(q, t)) / greatest(len(q), 1), 6) as score from w)
select *, row_number() over (partition by query_id order by score desc, id)::int as rank from s""")
def q118_cross_encoder(spark, d):
    c, q = chunks(spark, d), questions(spark, d)
    return X.cross_encoder("share", _share)(R.bm25(index(spark, d), q, 20), q, c)


@query(f"with {_POSTINGS}, h as (select * from lexical where rank <= 10) select query_id, id, 10 - rank as score, rank::int as rank from h")
def q118_identity_rerank(spark, d):
    return R.bm25(index(spark, d), questions(spark, d), 10).select("query_id", "id", (10 - F.col("rank")).cast("long").alias("score"), "rank")


#: The choice step by step: pool (query_id, id, relevance), alike (query_id, id, other, s); a candidate's likeness is that to the most alike of those chosen.
_CHOICE = """
steps(query_id, n, chosen) as (select distinct query_id, 0, []::bigint[] from pool union all
  select query_id, n + 1, list_append(chosen, arg_min(id, (-score, id))) from (
    select s.query_id, s.n, s.chosen, p.id, round(0.7 * any_value(p.relevance) - 0.3 * greatest(0, coalesce(max(a.s), 0)), 9) as score
    from steps s join pool p on p.query_id = s.query_id and not list_contains(s.chosen, p.id) left join alike a on a.query_id = s.query_id and a.id = p.id and list_contains(s.chosen, a.other)
    where s.n < {k} group by all) group by query_id, n, chosen)
select query_id, chosen[n] as id, n::bigint as position from steps where n > 0"""


@query(f"""with recursive {_POSTINGS}, pool as (select query_id, id, case when count(*) over w = 1 then 1 else (count(*) over w - rank) / (count(*) over w - 1) end as relevance from lexical where rank <= 40 window w as (partition by query_id)),
alike as (select a.query_id, a.id, b.id as other, 1 as s from pool a join pool b on b.query_id = a.query_id join documents x on x.doc_id = a.id join documents y on y.doc_id = b.id and y.source = x.source), {_CHOICE.format(k=8)}""")
def q119_mmr(spark, d):
    c = chunks(spark, d)
    hits = R.bm25(index(spark, d), questions(spark, d), 40)
    n = F.count("*").over(Window.partitionBy("query_id"))
    return R.mmr(hits.withColumn("relevance", F.when(n == 1, 1.0).otherwise((n - F.col("rank")) / (n - 1))).join(c.select("id", "group"), "id"), 8)


#: Vectors of every seventh candidate are held back, so that it is compared by its label.
@query(f"""with recursive near as (select q.vec_id as query_id, v.vec_id as id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as score from embeddings q, embeddings v where q.vec_id % 20 = 0),
pool as (select query_id, id, score as relevance from near qualify row_number() over (partition by query_id order by score desc, id) <= 30),
alike as (select a.query_id, a.id, b.id as other, case when a.id % 7 <> 0 and b.id % 7 <> 0 then round(list_cosine_similarity(x.embedding::double[], y.embedding::double[]), 6) else (x.label = y.label)::int end as s
  from pool a join pool b on b.query_id = a.query_id join embeddings x on x.vec_id = a.id join embeddings y on y.vec_id = b.id), {_CHOICE.format(k=8)}""")
def q119_mmr_by_vectors(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").cast("string").alias("group"))
    hits = R.vector_topk(v.select("id", "v"), v.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "v"), 30).withColumn("relevance", F.col("score"))
    return R.mmr(hits.join(v, "id").withColumn("v", F.when(F.col("id") % 7 != 0, F.col("v"))), 8)


@query()
def q098_seeded_order(spark, d):
    place = lambda columns: ((file, k) for k, file in enumerate(O.shuffled(columns[0], 42)))
    return O.by_repo(nodes(spark, d).select("repo", "file"), place, "repo long, file long, place long")


@query("""with f as (select l_orderkey as file, max(l_linenumber) as lines from lineitem where l_returnflag <> 'R' group by all), c as (select l_orderkey as file, l_linenumber as s, l_linenumber + l_suppkey % 3 - 1 as e from lineitem)
select (lines is not null and s >= 1 and e >= s and e <= lines) as grounded, count(*) as n from c left join f using (file) group by all""")
def q123_chunk_grounding(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + F.col("l_suppkey") % 3 - 1).alias("end"), "l_returnflag")
    files = rows.filter("l_returnflag <> 'R'").groupBy("file").agg(F.max("start").alias("lines"))
    return U.ground_chunks(rows, files).groupBy("grounded").agg(F.count("*").alias("n"))


@query("""with x as (select o_custkey as id, o_orderpriority as engine, o_totalprice / 500000 as f1 from orders), a as (select engine, round(avg(f1), 6) as f1 from x group by engine)
select a.engine, b.engine as other, a.f1 >= b.f1 - 1e-9 as holds from a join a b on a.engine < b.engine""")
def q178_parity_gates(spark, d):
    return U.parity(table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("engine")).agg(F.round(F.avg(F.col("o_totalprice") / 500000), 6).alias("f1")))


@query(f"""with {EDGES_SQL}, {NODES_SQL} select n.repo, count(*) as files, (select count(*) from edges e where e.repo = n.repo) as edges, sum(loc)::bigint as loc, min(file) as entry from nodes n group by n.repo""")
def q188_graph_facts(spark, d):
    return U.graph_facts(nodes(spark, d), edges(spark, d))


@query("select o_custkey, count(*) as exported, greatest(count(*) - 5, 0) as dropped, string_agg(o_orderkey::varchar, ',' order by k) filter (where k <= 5) as kept from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as k from orders) group by o_custkey")
def q219_report_ring(spark, d):
    return L.ring(table(spark, d, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], "o_orderkey")


@query("""with h as (select item_id as id, length(text) as n from benchmark) select count(*) as questions, count(*) filter (where n = 0) as negatives, round(avg(n), 6) as mean_length from h""")
def q221_dataset_totals(spark, d):
    return U.dataset_totals(table(spark, d, "benchmark").withColumn("n", F.length("text")))


@query("""with l as (select o_custkey, l_suppkey as entity, 1 as r, min(l_linenumber) as p from lineitem join orders on o_orderkey = l_orderkey where l_returnflag = 'N' group by all union all select o_custkey, l_partkey, 2, min(l_linenumber) from lineitem join orders on o_orderkey = l_orderkey where l_returnflag = 'R' group by all),
f as (select o_custkey, entity, min((r, p)) as k from l group by all), o as (select *, row_number() over (partition by o_custkey order by k, entity) as place from f) select o_custkey, entity, place::int as place from o where place <= 20""")
def q228_entities(spark, d):
    from .sources.bindings import lines
    
    rows = lines(spark, d)
    files = rows.filter("l_returnflag = 'N'").select("o_custkey", F.col("l_suppkey").alias("entity"), F.col("l_linenumber").alias("position"))
    symbols = rows.filter("l_returnflag = 'R'").select("o_custkey", F.col("l_partkey").alias("entity"), F.col("l_linenumber").alias("position"))
    return U.entities(files, symbols, "o_custkey")


@query("""with s as (select l_orderkey, list_sort(list(distinct l_suppkey) filter (where l_returnflag = 'N')) as a, list_sort(list(distinct l_suppkey) filter (where l_returnflag = 'R')) as r from lineitem group by l_orderkey)
select l_orderkey, concat_ws('; ', case when len(a) > 0 then 'added ' || array_to_string(a[1:2], ', ') || case when len(a) > 2 then ' and ' || (len(a) - 2) || ' more' else '' end end, case when len(r) > 0 then 'removed ' || array_to_string(r[1:2], ', ') || case when len(r) > 2 then ' and ' || (len(r) - 2) || ' more' else '' end end) as text from s""")
def q229_describe_diff(spark, d):
    of = lambda f: F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == f, F.col("l_suppkey")))).cast("array<string>")
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(of("N").alias("a"), of("R").alias("r"))
    return s.select("l_orderkey", U.describe_diff(F.col("a"), F.col("r")).alias("text"))


@query("""select conv_id, string_agg(turn || ' ' || role || ': ' || text, chr(10) order by turn) as rendered from conversations group by conv_id""")
def q230_render(spark, d):
    return U.render(table(spark, d, "conversations"), "conv_id", "turn", F.concat(F.col("turn").cast("string"), F.lit(" "), "role", F.lit(": "), "text"))


@query("select user_id, case when bool_or(event_type = 'error' and value > 60) then null else count(*) filter (where event_type = 'click') end as depth from events group by user_id")
def q231_queue_depth(spark, d):
    kind = F.col("event_type")
    return U.queue_depth(table(spark, d, "events"), "user_id", (kind == "error") & (F.col("value") > 60), kind == "click")


@query("select s_suppkey, least(8, greatest(1, floor(s_acctbal / 1000)))::int as concurrency, s_acctbal < 1000 or s_acctbal >= 9000 as warned from supplier")
def q232_concurrency(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", *U.concurrency(F.floor(F.col("s_acctbal") / 1000)))


@query(f"with {NODES_SQL} select repo, case when count(distinct folder) > 1 then 'fan-out' else 'single-shot' end as path from nodes group by repo")
def q233_adaptive_path(spark, d):
    return U.path_choice(nodes(spark, d), "folder")


@query("""with t as (select conv_id, turn, text from conversations where turn in (select max(turn) from conversations c where c.conv_id = conversations.conv_id)) select conv_id, case when regexp_matches(text, '[A-Za-z]') then 'ok' else 'empty' end as status, ceil(length(text) / 4)::bigint as tokens from t""")
def q171_site_rows(spark, d):
    last = table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    return last.select("conv_id", F.when(F.col("text").rlike("[A-Za-z]"), "ok").otherwise("empty").alias("status"), T.estimate_tokens(F.col("text")).alias("tokens"))


#: An order claims its suppliers' lines of parts; a part has as many lines as its size; what came back (R) was retrieved, with room around it.
_CLAIMS = """claims as (select distinct l_orderkey as task, l_partkey * case when l_linenumber % 5 = 0 then 100000 else 1 end as file, case when l_linenumber % 4 <> 0 then l_linenumber * 5 - 5 end as s, case when l_linenumber % 4 <> 0 then l_linenumber * 5 + l_quantity::int % 9 - 4 end as e from lineitem),
files as (select p_partkey as file, case when p_partkey % 6 <> 0 then p_size end as lines from part),
got as (select distinct l_orderkey as task, l_partkey as file, l_linenumber * 5 - 5 as s, l_linenumber * 5 as e from lineitem where l_returnflag = 'R'),
v as (select task, 'files' as verifier, count(*) as claims, count(*) filter (where not exists (select 1 from files f where f.file = c.file)) as bad from (select distinct task, file from claims) c group by task
  union all select task, 'lines', count(*), count(*) filter (where s < 1 or e < s or coalesce(e > lines, false)) from claims left join files using (file) where s is not null and e is not null group by task
  union all select task, 'citations', count(*), count(*) filter (where not exists (select 1 from got g where g.task = c.task and g.file = c.file and (c.s is null or c.s >= g.s) and (c.e is null or c.e <= g.e))) from claims c group by task)"""


@query(f"""with {_CLAIMS}, t as (select distinct l_orderkey as task, unnest(['files', 'lines', 'citations']) as verifier from lineitem)
select task, verifier, coalesce(claims, 0) as claims, coalesce(bad, 0) as bad, round(case when coalesce(claims, 0) = 0 then 1 else 1 - bad / claims end, 6) as score, coalesce(bad, 0) = 0 as passed from t left join v using (task, verifier)""")
def q182_grounding_verifiers(spark, d):
    l, n = table(spark, d, "lineitem"), F.col("l_linenumber")
    task, asked = F.col("l_orderkey").alias("task"), n % 4 != 0
    file = F.col("l_partkey") * F.when(n % 5 == 0, 100000).otherwise(1)
    claims = l.select(task, file.alias("file"), F.when(asked, n * 5 - 5).alias("start"), F.when(asked, n * 5 + F.round("l_quantity").cast("int") % 9 - 4).alias("end"))
    files = table(spark, d, "part").select(F.col("p_partkey").alias("file"), F.when(F.col("p_partkey") % 6 != 0, F.col("p_size")).alias("lines"))
    got = l.filter("l_returnflag = 'R'").select(task, F.col("l_partkey").alias("file"), (n * 5 - 5).alias("start"), (n * 5).alias("end"))
    return I.verify_grounding(claims, claims, files, got)


@query("""with e as (select l_orderkey as id, list(distinct l_suppkey) filter (where l_linestatus = 'O') as expected, list(distinct l_suppkey) as found from lineitem group by l_orderkey)
select id, len(list_intersect(coalesce(expected, []), found)) = len(found) and len(coalesce(expected, [])) = len(found) as exact, (len(found) - len(list_intersect(coalesce(expected, []), found)))::int as fabricated, 0::int as missed from e""")
def q182_grounding_verifier(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.when(F.col("l_linestatus") == "O", F.col("l_suppkey"))).alias("expected"), F.collect_set("l_suppkey").alias("found"))
    return E.verify_sets(s)
