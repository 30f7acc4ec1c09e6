"""Queries of agent data operators, parsing, resolution and control, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import parse as P
from .graph_queries import _BASE, _CYCLIC, _REACH
from .operators import agentops as A
from .operators import graph as G
from .operators import reach as H
from .operators import resolve as S
from .operators import retrieval as R
from .operators import support as U
from .plans import control as C
from .retrieval_queries import _POSTINGS, _TARGETS, chunks, index, questions, targets
from .sources.bindings import EDGES_SQL, NODES_SQL, edges, nodes, table
from .text_queries import tokens_sql

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_COMPLEX = f"""{_BASE}, {_REACH}, {_CYCLIC},
own as (select repo, folder as cluster, count(*) as size, sum(symbols) as symbols from nodes group by all),
b as (select e.repo, x.folder as s, y.folder as d from edges e join nodes x on x.repo = e.repo and x.file = src join nodes y on y.repo = e.repo and y.file = dst),
ends as (select repo, s as cluster, s = d as same from b union all select repo, d, false from b where s <> d),
w as (select repo, cluster, count(*) filter (where not same) as outer_n, count(*) as all_n from ends group by all),
r as (select c.repo, folder as cluster, count(distinct component) as cycles from cyclic c join nodes n on n.repo = c.repo and n.file = c.file group by all),
scored as (select repo, cluster, size, coalesce(cycles, 0) as cycles,
  round(0.3 * least(1, size / 20) + 0.3 * coalesce(outer_n / all_n, 0) + 0.25 * least(1, coalesce(cycles, 0) / 2) + 0.15 * least(1, symbols / size / 12), 6) as score
  from own left join w using (repo, cluster) left join r using (repo, cluster))"""


def _complexity(spark, d):
    e, n = edges(spark, d), nodes(spark, d)
    return A.complexity(n, e, n.select("repo", "file", F.col("folder").alias("cluster")), H.in_cycle(e))


@query(f"{_COMPLEX} select * from scored")
def q157_complexity(spark, d):
    return _complexity(spark, d)


@query(f"""{_COMPLEX}, p as (select *, row_number() over (partition by repo order by score desc, cluster) as place from scored), k as (select * from p where place <= 12)
select repo, cluster, place, case when score >= 0.6 and sum((score >= 0.6)::int) over (partition by repo order by place rows unbounded preceding) <= 3 then 3 else 1 end as candidates from k""")
def q158_routing(spark, d):
    return A.routing(_complexity(spark, d))


_FINDINGS = "findings as (select o_custkey as cluster, o_orderpriority as specialist, case o_orderstatus when 'F' then 3 when 'P' then 2 else 1 end as importance, 'Order ' || o_orderstatus || ' in ' || year(o_orderdate) || ', ORDER' as headline, o_orderkey from orders)"


def _findings(spark, d):
    importance = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "P", 2).otherwise(1)
    headline = F.concat(F.lit("Order "), "o_orderstatus", F.lit(" in "), F.year("o_orderdate").cast("string"), F.lit(", ORDER"))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("cluster"), F.col("o_orderpriority").alias("specialist"), importance.alias("importance"), headline.alias("headline"))


@query(f"""with {_FINDINGS}, k as (select *, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(headline), '[^a-z0-9]+'), lambda w: w <> ''))), ' ') as key from findings),
g as (select cluster, key, max(importance) as importance, array_to_string(list_sort(list(distinct specialist)), ',') as agreed, count(*) as merged from k group by all),
r as (select *, row_number() over (partition by cluster order by importance desc, key) as place from g) select * from r where place <= 5""")
def q164_consolidation(spark, d):
    return A.consolidate(_findings(spark, d))


@query(f"with {_FINDINGS} select cluster, count(*) as findings, count(*) filter (where importance = 3) as high, count(distinct specialist) as specialists from findings group by cluster")
def q163_blackboard_summary(spark, d):
    return U.blackboard(_findings(spark, d))


_KB = f"""kb as (select conv_id * 100 + turn as id, role as kind, text, case role when 'user' then 1.2 else 1 end as weight from conversations),
q as (select item_id as query_id, unnest(list_distinct({tokens_sql('text')})) as token, len(list_distinct({tokens_sql('text')})) as n from benchmark),
e as (select id, kind, weight, unnest(list_distinct({tokens_sql('text')})) as token from kb),
s as (select query_id, id, kind, round(count(*) / any_value(n) * any_value(weight), 6) as score from e join q using (token) group by all)"""


@query(f"with {_KB}, r as (select *, row_number() over (partition by query_id order by score desc, kind, id) as rank from s) select * from r where rank <= 3")
def q128_kb_search(spark, d):
    t = table(spark, d, "conversations")
    entries = t.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("role").alias("kind"), "text", F.when(F.col("role") == "user", 1.2).otherwise(1.0).alias("weight"))
    return A.kb_search(entries, questions(spark, d))


@query("""with t as (select * from (values ('callers', ['the', 'who'], 0, 0), ('search', [], 0, 3), ('blast', ['impact', 'ing'], 1, 0), ('diff', ['xyzzy'], 0, 0), ('old', ['the'], 2, 5), ('refs', ['xyzzy'], 0, 1)) v(tool, triggers, empty, calls)),
p as (select item_id as query_id, tool, calls, len(triggers) = 0 as general, len(list_filter(triggers, lambda x: contains(lower(text), x))) as n from benchmark, t where empty < 2),
r as (select *, row_number() over (partition by query_id order by n desc, calls > 0 desc, general, tool) as place from p where general or n > 0 or calls > 0) select query_id, tool, place from r where place <= 4""")
def q153_tool_curation(spark, d):
    tools = [("callers", ["the", "who"], 0, 0), ("search", [], 0, 3), ("blast", ["impact", "ing"], 1, 0), ("diff", ["xyzzy"], 0, 0), ("old", ["the"], 2, 5), ("refs", ["xyzzy"], 0, 1)]
    return A.curate_tools(questions(spark, d), tools)


@query("""with c as (select l_orderkey, l_linenumber, min(l_partkey) as candidate, round(0.5 * avg(l_discount * 10) + 0.3 * avg(l_quantity / 50) + 0.2 * avg(l_tax * 10), 6) as score from lineitem group by l_orderkey, l_linenumber),
r as (select *, row_number() over (partition by l_orderkey order by score desc, candidate) as k from c) select l_orderkey, candidate, score from r where k = 1""")
def q161_best_of_n(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("candidate"), F.avg(F.col("l_discount") * 10).alias("grounding"), F.avg(F.col("l_quantity") / 50).alias("coverage"), F.avg(F.col("l_tax") * 10).alias("substance"))
    return A.best_of(c, ["l_orderkey"]).select("l_orderkey", "candidate", "score")


_CITED = f"{_POSTINGS}, {_TARGETS}, cited as (select query_id, id from target union select item_id, item_id from benchmark), got as (select * from lexical where rank <= 10), g as (select query_id, count(got.id) as kept, count(*) - count(got.id) as dropped from cited left join got using (query_id, id) group by query_id)"


def _grounded(spark, d):
    q = questions(spark, d)
    cited = targets(spark, d).union(q.select("query_id", F.col("query_id").alias("id")))
    return A.ground(cited, R.bm25(index(spark, d), q, 10))


@query(f"with {_CITED} select *, kept > 0 as answered from g")
def q127_answer_grounding(spark, d):
    return _grounded(spark, d)


@query("""with c as (select distinct l_orderkey as query_id, l_partkey as id from lineitem), r as (select l_orderkey as query_id, l_partkey as id, min({'file': l_suppkey % 5, 'start': l_linenumber // 3, 'end': l_linenumber // 3 + 4}) as pl from lineitem where l_returnflag <> 'N' group by all),
m as (select c.query_id, c.id, r.pl, row_number() over (partition by c.query_id, r.pl is null order by c.id) as k from c left join r using (query_id, id))
select query_id, coalesce(array_to_string(list_sort(list(distinct pl.file || ':' || pl.start || '-' || pl."end") filter (where pl is not null)), ','), '') as citations, coalesce(string_agg(id::varchar, ',' order by id) filter (where pl is null and k <= 2), '') as dropped,
  count(*) filter (where pl is null) as n_dropped, count(pl) > 0 as answered from m group by query_id""")
def q127_grounded_answers(spark, d):
    l, n = table(spark, d, "lineitem"), F.col("l_linenumber")  # noqa: E741
    third = F.floor(n / 3).cast("int")
    cited = l.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("id"))
    got = l.filter("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("id"), (F.col("l_suppkey") % 5).alias("file"), third.alias("start"), (third + 4).alias("end"))
    text = F.transform("citations", lambda x: F.concat(x["file"].cast("string"), F.lit(":"), x["start"].cast("string"), F.lit("-"), x["end"].cast("string")))
    out = A.ground_answers(cited, got, 2)
    return out.select("query_id", F.array_join(F.array_sort(text), ",").alias("citations"), F.array_join(F.transform("dropped", lambda x: x.cast("string")), ",").alias("dropped"), "n_dropped", "answered")


@query(f"with {_CITED} select query_id, round(kept / (kept + dropped), 6) as validity, (kept > 0) = (query_id in (select query_id from target)) as justified from g")
def q175_answer_scores(spark, d):
    return A.answer_scores(_grounded(spark, d), targets(spark, d))


@query("""with p as (select conv_id, role as pillar, sum(ceil(length(text) / 4))::bigint as tokens from conversations group by all)
select conv_id, sum(tokens)::bigint as total, max_by(pillar, (tokens, pillar)) as dominant, round(max(tokens) / sum(tokens), 6) as share from p group by conv_id""")
def q154_context_meter(spark, d):
    return A.meter(table(spark, d, "conversations").withColumnRenamed("role", "pillar"), "conv_id")


_FILE = "'src/' || lower(replace(p_brand, '#', '')) || '/f' || p_partkey || '.ts'"


def _part_files(spark, d):
    """A file for each part, that imports the next part's and exports a function."""
    brand = lambda c: F.lower(F.replace(c, F.lit("#")))
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_name")
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_brand").alias("next_brand"))
    p = p.join(after, "p_partkey", "left")
    k = F.col("p_partkey").cast("string")
    source = F.concat(F.lit('import { g as h, k } from "../'), F.coalesce(brand(F.col("next_brand")), F.lit("none")), F.lit("/f"), (F.col("p_partkey") + 1).cast("string"), F.lit('";\n\n// '), "p_name", F.lit("\nexport function f"), k, F.lit("(x) {\n  return h(x);\n}\nconst Box"), k, F.lit(" = (a) => a;\nexport { Box"), k, F.lit(" as B };\n"))
    return p.select("p_partkey", F.concat(F.lit("src/"), brand(F.col("p_brand")), F.lit("/f"), k, F.lit(".ts")).alias("path"), source.alias("content"))


@query(f"with f as (select p_partkey, {_FILE} as path from part) select a.path as src, b.path as dst, 1 as line from f a join f b on b.p_partkey = a.p_partkey + 1")
def q039_import_resolution(spark, d):
    files = _part_files(spark, d)
    imports = P.js_imports(P.numbered(files)).select(F.col("path").alias("from"), "line", "source")
    return S.dependency_edges([S.resolve_js(imports, files)])


@query(f"""with f as (select p_partkey, {_FILE} as path, coalesce(lower(replace(lead(p_brand) over (order by p_partkey), '#', '')), 'none') as nb from part)
select path, 1 as line, 'static' as kind, '../' || nb || '/f' || (p_partkey + 1) as source, 'h,k' as specifiers, 1.0 as confidence from f""")
def q027_js_imports(spark, d):
    return P.js_imports(P.numbered(_part_files(spark, d))).withColumn("specifiers", F.array_join("specifiers", ","))


@query(f"""with f as (select p_partkey as k, {_FILE} as path from part)
select path, 4 as line, 'f' || k as name, 'function' as kind, true as exported from f union all select path, 7, 'Box' || k, 'component', true from f union all select path, 8, 'B', 'unknown', true from f""".replace("select path, 7, 'Box' || k, 'component', true from f", "select path, 7, 'Box' || k, 'component', false from f"))
def q038_symbols(spark, d):
    lines = P.numbered(_part_files(spark, d))
    return S.merge_symbols(P.js_symbols(lines), P.js_exports(lines)).select("path", "line", "name", "kind", "exported")


@query(f"with f as (select p_partkey, {_FILE} as path from part) select 'f' || p_partkey || '.ts' as name, path from f")
def q081_unique_suffix(spark, d):
    files = _part_files(spark, d)
    return S.unique_suffix(files.select(F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit(".ts")).alias("name")), files)


@query("with f as (select lower(replace(p_brand, '#', '')) as brand, count(*) as n from part group by all) select brand, 'src/' || brand as prefix from f")
def q147_common_prefix(spark, d):
    files = _part_files(spark, d).withColumn("brand", F.element_at(F.split("path", "/"), 2))
    two = files.select("brand", "path").union(files.select("brand", F.concat(F.lit("src/"), "brand", F.lit("/a/b.ts"))))
    return A.common_prefix(two, "brand")


@query(f"""with {EDGES_SQL}, {NODES_SQL}, e as (select repo, min(file) as file from nodes group by repo), k as (select repo, dst as file from edges group by all having count(*) >= 3), i as (select repo, src as file from edges group by all having count(*) >= 4),
u as (select repo, file, 0 as r from e union all select repo, file, 1 from k union all select repo, file, 2 from i), f as (select repo, file, min(r) as rank from u group by all)
select repo, file, rank, row_number() over (partition by repo order by rank, file)::int as position from f""")
def q166_reading_order(spark, d):
    e = edges(spark, d)
    entries = nodes(spark, d).groupBy("repo").agg(F.min("file").alias("file"))
    busy = lambda c, n: e.groupBy("repo", F.col(c).alias("file")).count().filter(F.col("count") >= n)
    return A.reading_order(entries, busy("dst", 3), busy("src", 4))


@query("""select item_id, case when item_id % 2 = 0 and length(text) < 4000 then 'small' when length(text) < 30000 then 'medium' else 'large' end as tier from benchmark""")
def q169_model_tier(spark, d):
    task = F.when(F.col("item_id") % 2 == 0, "extract").otherwise("write")
    return table(spark, d, "benchmark").select("item_id", A.tier(task, F.length("text")).alias("tier"))


@query("select conv_id, turn, case when turn % 3 = 0 then null else '{\"action\": \"tool\", \"tool\": \"t' || turn || '\", \"args\": {\"q\": \"{\"}}' end as object, case when turn % 3 = 0 then 'unparseable' else 'tool' end as kind from conversations")
def q065_action_parse(spark, d):
    body = F.concat(F.lit('{"action": "tool", "tool": "t'), F.col("turn").cast("string"), F.lit('", "args": {"q": "{"}}'))
    raw = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" { no end"))).otherwise(F.concat(F.lit("```json\nso: "), body, F.lit(" }``` "), "text"))
    return table(spark, d, "conversations").select("conv_id", "turn", *U.action(raw))


@query("""with s as (select o_custkey as id, list(distinct case o_orderpriority[1] when '1' then 'ingest' when '2' then 'orient' when '3' then 'map' when '4' then 'inventory' else 'connect' end) || ['analyze'] || case when max(o_orderkey) % 2 = 0 then ['synthesize', 'rag'] else ['rag'] end as p, max(o_orderkey) % 3 = 0 as same from orders group by o_custkey)
select id, case when not list_has_all(p, ['ingest', 'orient', 'map', 'inventory', 'connect', 'analyze']) then 'miss' when list_has_all(p, ['synthesize', 'rag']) and same then 'full-hit' else 'ai-retry' end as action from s""")
def q214_cache_action(spark, d):
    stage = F.element_at(F.array(*map(F.lit, ["ingest", "orient", "map", "inventory", "connect"])), F.substring("o_orderpriority", 1, 1).cast("int"))
    s = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set(stage).alias("p"), F.max("o_orderkey").alias("k"))
    s = s.withColumn("p", F.concat("p", F.array(F.lit("analyze")), F.when(F.col("k") % 2 == 0, F.array(F.lit("synthesize"), F.lit("rag"))).otherwise(F.array(F.lit("rag")))))
    return s.select("id", C.cache_action(F.col("p"), F.col("k") % 3 == 0).alias("action"))


@query("""with recursive e as (select distinct l_orderkey as g, least(l_partkey, l_suppkey) as a, greatest(l_partkey, l_suppkey) as b from lineitem where l_partkey <> l_suppkey),
n as (select g, a as node from e union select g, b from e), w(g, node, layer) as (select g, node, 0 from n union select w.g, e.b, w.layer + 1 from w join e on e.g = w.g and e.a = w.node)
select g as "group", node, max(layer) as layer from w group by all""")
def q215_layers(spark, d):
    pair = table(spark, d, "lineitem").filter("l_partkey <> l_suppkey").select(F.col("l_orderkey").alias("group"), F.least("l_partkey", "l_suppkey").alias("before"), F.greatest("l_partkey", "l_suppkey").alias("node")).distinct()
    every = pair.select("group", F.col("before").alias("node")).union(pair.select("group", "node")).distinct()
    return C.layers(every, pair)


@query("select o_custkey, case when bool_or(o_orderpriority[1] = '1') then 'failed' when bool_or(o_orderpriority[1] = '2') then 'aborted' when bool_or(o_orderpriority[1] = '3') then 'partial' else 'completed' end as status from orders group by o_custkey")
def q216_run_status(spark, d):
    status = F.element_at(F.array(*map(F.lit, ["failed", "aborted", "skipped", "ok", "ok"])), F.substring("o_orderpriority", 1, 1).cast("int"))
    return C.run_status(table(spark, d, "orders").withColumn("s", status), "o_custkey", "s")


@query("""with l as (select user_id, case event_type when 'click' then 'hit' when 'error' then 'failed' else 'discarded' end as o from events)
select user_id, count(*) as launched, count(*) filter (where o = 'hit') as hit, count(*) filter (where o = 'discarded') as discarded, count(*) filter (where o = 'failed') as failed, round(count(*) filter (where o = 'hit') / count(*), 6) as rate from l group by user_id""")
def q218_speculation(spark, d):
    outcome = F.when(F.col("event_type") == "click", "hit").when(F.col("event_type") == "error", "failed").otherwise("discarded")
    return C.speculation(table(spark, d, "events").withColumn("outcome", outcome), "user_id")


@query("""with v as (select vec_id // 2 as id, case when vec_id % 7 = 0 then embedding[1:32] else embedding end as v from embeddings)
select id, 'duplicate-id' as rule from v group by id having count(*) > 1 union all select id, 'dimension' from v where len(v) <> 64""")
def q220_index_validation(spark, d):
    v = F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    return C.index_violations(table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("id"), v.alias("v")), 64)


_REPO = r"^(?:https?://)?[^/@\s]+\.[^/@\s]+/([A-Za-z0-9._-]+)/([A-Za-z0-9._-]+?)(?:\.git)?/?(?:[?#].*)?$"


@query(rf"select page_id, case when regexp_matches(url, '{_REPO}') then regexp_extract(url, '{_REPO}', 1) end as owner, case when regexp_matches(url, '{_REPO}') then regexp_extract(url, '{_REPO}', 2) end as name, false as sha from pages")
def q223_repo_reference(spark, d):
    return table(spark, d, "pages").select("page_id", *C.repo_reference(F.col("url")), C.sha_ok(F.col("url")).alias("sha"))


@query("select conv_id, turn, case when turn % 2 = 0 then 1 else 2 end as notices from conversations")
def q225_degradation_notice(spark, d):
    have = F.array(F.struct(F.when(F.col("turn") % 2 == 0, "store").otherwise("cache").alias("reason"), F.lit("x").alias("text")))
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(C.with_notice(have, F.lit("store"), F.lit("not saved"))).alias("notices"))


@query("select doc_id, (length(text) - length(replace(text, ' the ', '    ')) >= 0) as read, regexp_matches(text, '(?i)\\b(TODO|FIXME)\\b') as todo from documents")
def q030_generic_parse(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    marks = P.todo_warnings(P.numbered(files)).select("path").distinct().withColumn("todo", F.lit(True))
    return files.join(marks, "path", "left").select(F.col("path").cast("long").alias("doc_id"), F.lit(True).alias("read"), F.coalesce("todo", F.lit(False)).alias("todo"))
