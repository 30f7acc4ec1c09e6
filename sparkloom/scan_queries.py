"""Queries of scanning, parsing, stores and extension points, and their SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import parse as P
from .operators import graph as G
from .operators import relational as L
from .operators import retrieval as R
from .operators import telemetry as M
from .plans import registry as X
from .plans.lineage import folder_for
from .retrieval_queries import _POSTINGS, chunks, index, questions
from .sources import scan as C
from .sources import stores as W
from .sources.bindings import EDGES_SQL, edges, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


FOLDERS = ["src", "node_modules/pkg", "docs", "lib/tmp/x", "packages/a", "app", "logs", "src/logs"]
NAMES = ["main.ts", "view.tsx", "run.log", "keep.log", "guide.md", "job.py", "yarn.lock", "x.unknown", "LICENSE"]
RULES = "# own\n*.log\n!keep.log\n/docs/*.md\n**/tmp/\nlogs/\n\n"
_PATHS = f"""f as (select c_custkey as id, c_nationkey as repo, ({FOLDERS!r}::varchar[])[c_custkey % {len(FOLDERS)} + 1] as folder, ({NAMES!r}::varchar[])[c_custkey % {len(NAMES)} + 1] as name, c_comment as content, 1000 * c_custkey as size_bytes from
  (select *, c_name as c_comment from customer)), p as (select *, folder || '/' || name as path from f)"""


def _paths(spark, d):
    """A file for each customer: folder and name by its key; its nation is the repository."""
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("c_custkey") % len(xs) + 1).cast("int"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("repo"), F.concat(pick(FOLDERS), F.lit("/"), pick(NAMES)).alias("path"), F.col("c_name").alias("content"), (1000 * F.col("c_custkey")).cast("long").alias("size_bytes"))


@query(f"with {_PATHS} select id, path from p where folder <> 'node_modules/pkg'")
def q004_hard_ignored(spark, d):
    return _paths(spark, d).filter(~C.hard_ignored(F.col("path"))).select("id", "path")


@query(f"with {_PATHS} select id, path, folder in ('lib/tmp/x', 'logs', 'src/logs') or name = 'run.log' or (folder = 'docs' and name = 'guide.md') as ignored from p")
def q005_ignore_file(spark, d):
    return _paths(spark, d).select("id", "path", C.ignored(F.col("path"), C.ignore_rules(RULES)).alias("ignored"))


@query(f"with {_PATHS}, k as (select *, row_number() over (partition by repo order by path, id) as k from p where size_bytes <= 524288 and folder <> 'node_modules/pkg') select id from k where k <= 3")
def q006_parseable(spark, d):
    files = _paths(spark, d).withColumn("path", F.concat("path", F.lit("/"), F.lpad(F.col("id").cast("string"), 9, "0"), F.lit("-"), F.element_at(F.split("path", "/"), -1)))
    return C.parseable(files, most_files=3, by="repo").select("id")


@query("select unnest(['customer.parquet', 'documents.parquet', 'region.parquet']) as path")
def q007_local_tree(spark, d):
    # a table is one file, or a folder of parts
    whole = C.read_files(spark, d).select(F.regexp_extract("path", "^([^/]+)", 1).alias("path")).distinct()
    return whole.filter(F.col("path").isin("customer.parquet", "documents.parquet", "region.parquet", "none.parquet"))


@query(f"""with {_PATHS}, e as (select id, path, case when name in ('main.ts', 'view.tsx') then 'TypeScript' when name = 'job.py' then 'Python' when name = 'guide.md' then 'Markdown' else 'Unknown' end as language, case when name = 'LICENSE' then '' else lower(regexp_extract(name, '(\\.[^.]+)$', 1)) end as ext from p)
select * from e""")
def q021_language(spark, d):
    return C.describe(_paths(spark, d), "id").select("id", "path", "language", "ext")


@query(f"with {_PATHS} select language, count(*) as files from (select case when name in ('main.ts', 'view.tsx') then 'TypeScript' when name = 'job.py' then 'Python' when name = 'guide.md' then 'Markdown' else 'Unknown' end as language from p) group by language")
def q024_display_language(spark, d):
    return C.describe(_paths(spark, d)).groupBy("language").agg(F.count("*").alias("files"))


@query(f"with {_PATHS}, l as (select id % 40 as repo, bool_or(folder in ('packages/a', 'app')) filter (where folder = 'packages/a') as m, bool_or(folder in ('src', 'src/logs')) as s, bool_or(folder = 'app') as a from p where id % 5 <> 0 or id % 3 = 0 group by all) select repo, case when m then 'monorepo' when s then 'src-rooted' when a then 'app-rooted' else 'flat' end as layout from l")
def q025_layout(spark, d):
    return C.layout(_paths(spark, d).filter("id % 5 <> 0 or id % 3 = 0").withColumn("repo", F.col("id") % 40), "repo")


TS = "import def, { a as b%s } from './m%s';\nexport interface Shape%s {}\ntype Alias%s = string;\nexport class Box%s extends Base%s {}\nconst y = require('pkg%s');\nfunction plain%s() { call%s(1); }\nrouter.post('/u/%s', h);\n"
PY = "import os, sys as system\nfrom .m%s import x\nclass A%s(B%s):\n    def run(self):\n        return call%s(1)\ndef top%s():\n    pass\n@app.get('/p/%s')\ndef shown():\n    pass\n"


def _code(spark, d, text: str, ext: str):
    """A source file for each supplier, with its key in every name."""
    own = table(spark, d, "supplier").select(F.concat(F.lit("src/s"), F.col("s_suppkey").cast("string"), F.lit(ext)).alias("path"), F.col("s_suppkey").cast("string").alias("k"))
    return own.select("path", F.replace(F.lit(text), F.lit("%s"), F.col("k")).alias("content"))


def _rows(ext: str, names: str, *rows: tuple) -> str:
    """The same rows for each supplier; # stands for its key."""
    values = ", ".join("(" + ", ".join(str(v) if isinstance(v, int | bool) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)
    columns = names.split()
    texts = ", ".join(f"replace({c}, '#', s_suppkey::varchar) as {c}" if isinstance(v, str) else c for c, v in zip(columns, rows[0], strict=True))
    return f"select 'src/s' || s_suppkey || '{ext}' as path, {texts} from supplier cross join (values {values}) v({', '.join(columns)})"


@query(_rows(".ts", "line name kind exported", (2, "Shape#", "interface", True), (3, "Alias#", "type", False), (4, "Box#", "class", True), (6, "plain#", "function", False)))
def q028_type_symbols(spark, d):
    return P.js_symbols(P.numbered(_code(spark, d, TS, ".ts"))).select("path", "line", "name", "kind", "exported")


@query(_rows(".py", "line kind name", (1, "import", "os"), (1, "import", "sys"), (2, "import", ".m#"), (3, "class", "A#"), (4, "method", "run"), (6, "function", "top#"), (9, "function", "shown")))
def q029_python_lines(spark, d):
    return P.python_facts(_code(spark, d, PY, ".py"), "lines").select("path", "line", "kind", "name")


@query(_rows(".ts", "line kind source names", (1, "static", "./m#", "def,b#"), (5, "commonjs", "pkg#", "y")))
def q031_import_clauses(spark, d):
    found = P.js_imports(P.numbered(_code(spark, d, TS, ".ts")))
    return found.select("path", "line", "kind", "source", F.array_join("specifiers", ",").alias("names"))


#: Sources of several kinds, one for each supplier by its key, and the facts that are in them: line, kind, name, form, end, scope, names.
_WIDE = ", ".join(f"n{i} as w{i}" for i in range(300))
SOURCES = [
    (".ts", TS, [
        (1, "import", "./m#", "static", 1, "", "def,b#"), (2, "interface", "Shape#", None, 2, "", ""), (2, "export", "Shape#", "interface", 2, "", ""), (3, "type", "Alias#", None, 3, "", ""),
        (4, "class", "Box#", None, 4, "", ""), (4, "export", "Box#", "class", 4, "", ""), (4, "inheritance", "Base#", None, 4, "Box#", ""), (5, "import", "pkg#", "commonjs", 5, "", "y"),
        (6, "function", "plain#", None, 6, "", ""), (6, "call", "call#", None, 6, "plain#", ""), (7, "call", "router.post", None, 7, "", ""), (7, "route", "POST /u/#", None, 7, "", ""),
    ]),
    (".jsx", "import React, {\n  useState as state,\n} from 'react%s';\n// import no from './no';\nexport const Card%s = (props) => {\n  const [open] = state(%s);\n  return <div title=\"it's(1)\" onClick={() => toggle%s('}')}>don't { open ? <b/> : `n${count(open)}` }</div>;\n};\nconst useCard%s = () => ({});\nexport { useCard%s as hook%s } from './hooks%s';\n", [
        (1, "import", "react#", "static", 3, "", "React,state"), (5, "component", "Card#", None, 8, "", ""), (5, "export", "Card#", "function", 5, "", ""), (6, "call", "state", None, 6, "Card#", ""), (7, "call", "toggle#", None, 7, "Card#", ""),
        (7, "call", "count", None, 7, "Card#", ""), (9, "hook", "useCard#", None, 9, "", ""), (10, "export", "hook#", "unknown", 10, "", ""), (10, "reexport", "./hooks#", None, 10, "", ""),
    ]),
    (".js", "const re = /[\"'`]{2}\\/(x)/g, half = a / b / c;\nclass Store%s {\n  static async load(key, again = retry(1)) {\n    if (key) { return fetchAll(key); }\n  }\n  save() { this.put%s(1); }\n}\nmodule.exports = Store%s;\nimport('./late%s').then(run);\n", [
        (1, "variable", "re", "variable", 1, "", ""), (1, "variable", "half", "variable", 1, "", ""), (2, "class", "Store#", None, 7, "", ""), (3, "method", "load", None, 5, "Store#", ""), (3, "call", "retry", None, 3, "Store#.load", ""),
        (4, "call", "fetchAll", None, 4, "Store#.load", ""), (6, "method", "save", None, 6, "Store#", ""), (6, "call", "this.put#", None, 6, "Store#.save", ""), (9, "import", "./late#", "dynamic", 9, "", ""), (9, "call", "then", None, 9, "", ""),
    ]),
    (".mts", f"import {{ {_WIDE} }} from './wide%s';\nexport enum Level%s {{ Low, High }}\nexport default class extends Base%s {{}}\nexport abstract class Shape%s<T> extends Base%s implements Drawn {{\n  constructor(private x: T) {{ super(); }}\n  abstract area(): number;\n}}\n", [
        (1, "import", "./wide#", "static", 1, "", ",".join(f"w{i}" for i in range(300))), (2, "enum", "Level#", None, 2, "", ""), (2, "export", "Level#", "unknown", 2, "", ""), (4, "class", "Shape#", None, 7, "", ""), (4, "export", "Shape#", "class", 4, "", ""),
        (4, "inheritance", "Base#", None, 4, "Shape#", ""), (4, "inheritance", "Drawn", None, 4, "Shape#", ""), (5, "method", "constructor", None, 5, "Shape#", ""), (6, "method", "area", None, 6, "Shape#", ""),
    ]),
]


def _sources(spark, d):
    own = table(spark, d, "supplier").select(F.col("s_suppkey"), F.col("s_suppkey").cast("string").alias("k"))
    parts = []
    for i, (ext, text, _) in enumerate(SOURCES):
        mine = own.filter(F.col("s_suppkey") % len(SOURCES) == i)
        parts.append(mine.select(F.concat(F.lit("src/s"), "k", F.lit(ext)).alias("path"), F.replace(F.lit(text), F.lit("%s"), F.col("k")).alias("content")))
    return reduce(DataFrame.union, parts)


def _sources_sql() -> str:
    show = lambda v: "null" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    values = ", ".join(f"({i}, '{ext}', {', '.join(map(show, r))})" for i, (ext, _, rows) in enumerate(SOURCES) for r in rows)
    of = lambda c: f"replace({c}, '#', s_suppkey::varchar) as {c}"
    return f"""facts as (select 'src/s' || s_suppkey || ext as path, line, kind, {of('name')}, form, "end", {of('scope')}, {of('names')} from supplier join (values {values}) v(i, ext, line, kind, name, form, "end", scope, names) on s_suppkey % {len(SOURCES)} = i)"""


@query(f"""with {_sources_sql()} select path, line, kind, name, form, "end", scope, names from facts where kind not in ('call', 'inheritance', 'route')""")
def q032_javascript_facts(spark, d):
    facts = P.js_facts(_sources(spark, d)).filter(~F.col("kind").isin("call", "inheritance", "route"))
    return facts.select("path", "line", "kind", "name", "form", "end", "scope", F.array_join("specifiers", ",").alias("names"))


@query(_rows(".py", "line kind name", (1, "import", "os"), (1, "import", "sys"), (2, "import", ".m#"), (3, "class", "A#"), (3, "inheritance", "B#"), (4, "method", "run"), (5, "call", "call#"), (6, "function", "top#"), (8, "call", "app.get"), (9, "function", "shown")))
def q033_python_facts(spark, d):
    return P.python_facts(_code(spark, d, PY, ".py")).select("path", "line", "kind", "name")


@query("""select 'src/s' || s_suppkey || '.py' as path, s_suppkey % 3 <> 0 and s_suppkey < 10 as by_tree from supplier""")
def q034_engine_choice(spark, d):
    broken = F.when(F.regexp_extract("path", r"(\d+)", 1).cast("int") % 3 == 0, F.concat("content", F.lit("def broken(:\n"))).otherwise(F.col("content"))
    facts = P.python_facts(_code(spark, d, PY, ".py").withColumn("content", broken), most_chars=len(PY.replace("%s", "1")))
    return facts.groupBy("path").agg(F.bool_or(F.col("kind") == "inheritance").alias("by_tree"))


@query(f"""with {_sources_sql()} select path, line, kind, name, scope from facts where kind in ('import', 'call', 'inheritance', 'route')
union all {_rows(".py", "line kind name scope", (1, "import", "os", ""), (1, "import", "sys", ""), (2, "import", ".m#", ""), (3, "inheritance", "B#", ""), (5, "call", "call#", ""), (8, "call", "app.get", ""))}""")
def q035_property_facts(spark, d):
    mine = F.col("kind").isin("import", "call", "inheritance", "route")
    python = P.python_facts(_code(spark, d, PY, ".py")).filter(mine).select("path", "line", "kind", "name", F.lit("").alias("scope"))
    return P.js_facts(_sources(spark, d)).filter(mine).select("path", "line", "kind", "name", "scope").union(python)


@query(_rows(".ts", "line method route", (7, "POST", "/u/#")) + " union all " + _rows(".py", "line method route", (8, "GET", "/p/#")))
def q036_routes(spark, d):
    return P.routes(P.numbered(_code(spark, d, TS, ".ts").union(_code(spark, d, PY, ".py"))))


@query(f"with {EDGES_SQL} select kind, count(*) as n, min(confidence) as least from edges where confidence >= 0.8 and kind in ('import', 'call') group by kind")
def q062_edge_predicate(spark, d):
    return G.allowed(edges(spark, d), 0.8, ["import", "call"]).groupBy("kind").agg(F.count("*").alias("n"), F.min("confidence").alias("least"))


@query("""select conv_id, turn, case turn % 4 when 0 then '{"a": ' || turn || ', "b": {"c": "}"}}' when 1 then '{}' end as object from conversations""")
def q064_json_object(spark, d):
    n = F.col("turn")
    raw = F.when(n % 4 == 0, F.concat(F.lit('so } ok: {"a": '), n.cast("string"), F.lit(', "b": {"c": "}"}} and {"z": 1}'))).when(n % 4 == 1, F.lit("x {} y")).when(n % 4 == 2, F.lit('{"open": "'))
    return table(spark, d, "conversations").select("conv_id", "turn", P.json_object(raw).alias("object"))


@query("select o_orderkey, case when s >= 90 then 'A' when s >= 80 then 'B' when s >= 70 then 'C' when s >= 60 then 'D' else 'F' end as grade from (select o_orderkey, o_orderkey % 101 as s from orders)")
def q068_grade(spark, d):
    return table(spark, d, "orders").select("o_orderkey", G.grade(F.col("o_orderkey") % 101).alias("grade"))


@query("with s as (select event_id as span_id, case when event_id % 10 > 0 then event_id - event_id % 10 end as parent_id from events), c as (select parent_id as span_id, count(*) as children from s where parent_id is not null group by parent_id) select span_id, coalesce(children, 0) as children from s left join c using (span_id)")
def q076_span_children(spark, d):
    n = F.col("event_id")
    spans = table(spark, d, "events").select(n.alias("span_id"), F.when(n % 10 > 0, n - n % 10).alias("parent_id"))
    return L.children(spans).select("span_id", "children")


@query("""with w as (select l_orderkey as g, l_linenumber * 10 as s, l_linenumber * 10 + l_quantity::int as e, l_partkey as p, l_returnflag as f from lineitem) select a.g as l_orderkey, a.p as a, b.p as b, count(*) as n from w a join w b on a.g = b.g and a.s <= b.e and b.s <= a.e where a.f = 'N' and b.f = 'R' group by all""")
def q079_overlap_join(spark, d):
    w = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 10).alias("s"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")).alias("e"), "l_partkey", "l_returnflag")
    both = L.overlapping(w.filter("l_returnflag = 'N'"), w.filter("l_returnflag = 'R'"), "l_orderkey", "s", "e", "l_partkey")
    return both.groupBy("l_orderkey", F.col("left").alias("a"), F.col("right").alias("b")).agg(F.count("*").alias("n"))


@query("""with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as k, count(*) over (partition by event_type) as n from events where value is not null)
select event_type, max(value) filter (where k = n // 2) as median, min(value) as best, max(value) as worst from r group by event_type""")
def q133_upper_median(spark, d):
    return M.percentiles(table(spark, d, "events").filter("value is not null"), "event_type", "value").select("event_type", F.col("upper_median").alias("median"), "best", "worst")


@query("with r as (select o_custkey as query_id, o_orderkey as id, round(o_totalprice, 2) as score, row_number() over (partition by o_custkey order by round(o_totalprice, 2) desc, o_orderkey) as rank from orders) select query_id, id, rank::int as rank from r where rank <= 4")
def q137_ranking_window(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.round("o_totalprice", 2).alias("score"))
    return R.top(rows, 4).select("query_id", "id", "rank")


@query(f"with {_POSTINGS}, h as (select * from lexical where rank <= 5) select query_id, id, rank::int as rank from h")
def q207_registered_reranker(spark, d):
    c, q = chunks(spark, d), questions(spark, d)
    return X.defaults().rerankers["identity"](R.bm25(index(spark, d), q, 5), q, c).select("query_id", "id", "rank")


@query("select count(*) as vectors, 256 as dim from documents")
def q209_registered_embedder(spark, d):
    out = X.defaults().embedders["hashed"](chunks(spark, d).select("id", "text"))
    return out.agg(F.count("*").alias("vectors"), F.max(F.size("v")).alias("dim"))


@query(f"with {EDGES_SQL}, f as (select min(dst) as file from edges) select 'callers' as tool, count(*) as n from edges where dst = (select file from f) and kind = 'call' union all select 'references', count(*) from edges where dst = (select file from f)")
def q210_registered_tools(spark, d):
    e = edges(spark, d)
    file, tools = e.agg(F.min("dst")).first()[0], X.defaults().tools
    n = lambda name: tools[name]({"edges": e}, file).agg(F.lit(name).alias("tool"), F.count("*").alias("n"))
    return n("callers").union(n("references"))


@query("""with s as (select l_orderkey as id, list(distinct l_suppkey) filter (where l_linestatus = 'O') as e, list(distinct l_suppkey) as f from lineitem group by l_orderkey) select id, len(coalesce(e, [])) = len(f) as exact from s""")
def q211_registered_verifier(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.when(F.col("l_linestatus") == "O", F.col("l_suppkey"))).alias("expected"), F.collect_set("l_suppkey").alias("found"))
    return X.defaults().verifiers["sets"](s).select("id", "exact")


@query("select o_orderstatus as status, count(*) as n from orders where o_totalprice > 1000 group by o_orderstatus")
def q212_registered_stages(spark, d):
    r = X.defaults()
    r.stages = [("select", lambda t: {"large": t["orders"].filter("o_totalprice > 1000")}), ("count", lambda t: {"counts": t["large"].groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))})]
    return r.run({"orders": table(spark, d, "orders")})["counts"]


_CANDIDATES = "c as (select l_orderkey as id, l_linenumber as k, l_discount as grounding, l_tax as coverage, l_quantity / 50 as substance from lineitem)"


@query(f"with {_CANDIDATES}, s as (select id, max(round(0.5 * grounding + 0.3 * coverage + 0.2 * substance, 6)) as score from c group by id) select * from s")
def q213_registered_scorer(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("k"), F.col("l_discount").alias("grounding"), F.col("l_tax").alias("coverage"), (F.col("l_quantity") / 50).alias("substance"))
    return c.withColumn("score", X.defaults().scorers["grounding"]()).groupBy("id").agg(F.max("score").alias("score"))


@query("select 'src/s' || s_suppkey || '.py' as path, 10 as facts from supplier")
def q206_parser_function(spark, d):
    X.register_parser_udtf(spark)
    _code(spark, d, PY, ".py").createOrReplaceTempView("sparkloom_code")
    return spark.sql("select path, count(*) as facts from sparkloom_code, lateral python_facts(path, content) group by path").withColumn("facts", F.col("facts").cast("int"))


def _store(spark):
    return f"{folder_for(spark)}/stores-{uuid.uuid4().hex}"


@query("""select 'v' || vec_id as id, round(case when vec_id % 3 = 0 then 2 else 1 end * embedding[1]::double, 6) as x from embeddings where vec_id % 2 = 0 or vec_id % 3 = 0""")
def q008_vector_upsert(spark, d):
    v = table(spark, d, "embeddings").filter("embedding is not null")
    dim = v.agg(F.max(F.size("embedding"))).first()[0]
    store = W.VectorStore(spark, _store(spark), dim)
    of = lambda rows, times: rows.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x * times).alias("vector"), F.lit("f").alias("file"))
    store.upsert("one", of(v.filter("vec_id % 2 = 0"), 1))
    store.upsert("one", of(v.filter("vec_id % 3 = 0"), 2))
    return store.read("one").select("id", F.round(F.element_at("vector", 1), 6).alias("x"))


@query("select 'd' || doc_id as id, length(text) as n from documents where doc_id % 2 = 0 and doc_id % 3 = 0")
def q009_texts_by_id(spark, d):
    docs = table(spark, d, "documents")
    store = W.TextStore(spark, _store(spark))
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id")
    store.put(docs.filter("doc_id % 2 = 0").select(name, "text"))
    return store.get(docs.filter("doc_id % 3 = 0").select(name)).select("id", F.length("text").cast("long").alias("n"))


@query("select 'kept' as namespace, (select count(*) from customer) as n union all select 'dropped', 0")
def q011_count_and_drop(spark, d):
    store = W.VectorStore(spark, _store(spark), 2)
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.array(F.lit(1.0), F.lit(2.0)).alias("vector"), F.lit("f").alias("file"))
    store.upsert("kept", rows)
    store.upsert("dropped", rows)
    store.drop("dropped")
    return spark.createDataFrame([(n, store.count(n)) for n in ("kept", "dropped")], "namespace string, n long")


@query("select 'store-not-configured' as notice, c_nationkey::varchar as namespace, count(*) as n from customer group by c_nationkey")
def q013_store_selection(spark, d):
    _, texts, notices = W.open_stores(spark, None, _store(spark), 2)
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("text"), F.col("c_nationkey").cast("string").alias("namespace"))
    spaces = [r[0] for r in rows.select("namespace").distinct().collect()]  # one for each nation
    for space in spaces:
        texts.put(rows.filter(F.col("namespace") == space), space)
    return spark.createDataFrame([(notices[0], space, texts.count(space)) for space in spaces], "notice string, namespace string, n long")


def _analyses(spark, d):
    o = table(spark, d, "orders")
    cache = W.AnalysisCache(spark, _store(spark))
    rows = o.select(F.col("o_custkey").cast("string").alias("repo"), F.col("o_orderkey").cast("string").alias("sha"), F.lit(1).alias("version"), F.col("o_orderdate").cast("timestamp").alias("indexed_at"), F.col("o_orderstatus").alias("result"))
    return cache, cache.save(rows.filter("sha % 3 <> 0")), cache.save(rows.withColumn("result", F.lit("second")))


@query("select result, count(*) as n from (select case when o_orderkey % 3 <> 0 then o_orderstatus else 'second' end as result from orders) group by result")
def q014_analysis_cache(spark, d):
    return _analyses(spark, d)[0].read().groupBy("result").agg(F.count("*").alias("n"))


@query("""select o_custkey::varchar as repo, o_orderkey::varchar as sha, o_orderdate::timestamp as indexed_at from orders order by o_orderdate desc, o_custkey::varchar, o_orderkey::varchar limit 50""")
def q016_latest_analyses(spark, d):
    return _analyses(spark, d)[0].latest(80)


@query("""select 'empty-question' as rule, count(*) filter (where item_id % 4 = 0) as n from benchmark having n > 0 union all select 'no-expectation', count(*) filter (where item_id % 3 = 0) from benchmark having count(*) filter (where item_id % 3 = 0) > 0
union all select 'duplicate-id', count(*) filter (where item_id % 5 = 0) from benchmark having count(*) filter (where item_id % 5 = 0) > 0""")
def q018_dataset_rules(spark, d):
    b = table(spark, d, "benchmark")
    n = F.col("item_id")
    q = b.select(n.alias("id"), F.when(n % 4 == 0, "  ").otherwise(F.col("text")).alias("question"), F.when(n % 3 != 0, F.array(F.lit("f"))).alias("expected_files"))
    good = q.select("id", F.lit("again").alias("question"), F.array(F.lit("f")).alias("expected_files")).filter("id % 5 = 0")
    return W.dataset_violations(q.union(good)).groupBy("rule").agg(F.count("*").alias("n"))


@query("select event_type as kind, count(*) as n from events group by all")
def q019_trace_export(spark, d):
    path = _store(spark)
    W.export_trace(table(spark, d, "events").select("event_id", F.col("event_type").alias("kind")), path)
    return spark.read.schema("event_id long, kind string").json(path).groupBy("kind").agg(F.count("*").alias("n"))


@query("select 'm' || p_partkey as model, p_size::double as input, round(p_retailprice, 2) as output from part where p_partkey % 4 <> 0 and p_partkey % 5 <> 0")
def q020_pricing(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    cost = F.when(k % 4 == 0, F.lit("-1")).otherwise(F.col("p_size").cast("string"))
    rest = F.when(k % 5 == 0, F.lit('"cheap"')).otherwise(F.round("p_retailprice", 2).cast("string"))
    return W.pricing(p.select(F.concat(F.lit('{"m'), k.cast("string"), F.lit('": {"input": '), cost, F.lit(', "output": '), rest, F.lit('}, "none": {"input": 1}}')).alias("json")))


@query("""with c as (select l_orderkey as id, l_linenumber as position, l_suppkey as chunk_id from lineitem), r as (select l_orderkey as id, l_suppkey as chunk_id from lineitem where l_returnflag = 'N') select c.id, c.position, exists (select 1 from r where r.id = c.id and r.chunk_id = c.chunk_id) as seen from c""")
def q156_seen_evidence(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("position"), F.col("l_suppkey").alias("chunk_id"), "l_returnflag")
    return L.seen(rows, rows.filter("l_returnflag = 'N'"), ["id", "chunk_id"]).select("id", "position", "seen")

