"""Queries of retrieval and evaluation and their SQL. Chunks are documents, questions are test items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import chunking as K
from .operators import evaluation as E
from .operators import relational as L
from .operators import retrieval as R
from .plans.lineage import cut, kept, spread
from .sources.bindings import lines, table
from .text_queries import tokens_sql, units_sql

QUERIES, SQL = {}, {}
#: Characters of test items up to which they go to all tasks.
FEW_CHARS = 32_000_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def chunks(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("group"))


def questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def index(spark, d):
    """The chunks' index, built by the first query that asks for it."""
    return kept(spark, f"{d}/documents.parquet", "index", lambda: R.build_index(chunks(spark, d)))


def embedded(spark, d):
    return kept(spark, f"{d}/documents.parquet", "embedded", lambda: cut(R.hashed_embedding(chunks(spark, d))))


def targets(spark, d):
    """(query_id, id): documents that hold a test item as it stands, whatever its length. Items of up to FEW_CHARS go to the texts. Of more, those of
    seven words and more are joined by words two to six, which stand whole in each text that holds the item; the others still go to the texts."""
    items, docs = questions(spark, d).filter("text is not null"), chunks(spark, d).select("id", "text")
    if (items.agg(F.sum(F.length("text"))).first()[0] or 0) <= FEW_CHARS:
        return cut(R.holding(docs, items), "targets")
    pick = lambda w, i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(5)])
    w = F.split("text", r"\s+")
    long = items.filter(F.size(w) >= 7).select("query_id", F.col("text").alias("passage"), pick(w, F.lit(1)).alias("key"), F.monotonically_increasing_id().alias("item"))
    rows = spread(docs).withColumn("w", w).filter(F.size("w") >= 5)
    rows = rows.withColumn("keys", F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - 5), lambda i: pick(F.col("w"), i))))
    # outer, as Spark would else ask for keys first, and split a text for each of its words to do so
    hits = rows.select("id", F.explode_outer("keys").alias("key")).join(long, "key").dropDuplicates(["item", "id"]).join(docs, "id")
    short = R.holding(docs, items.filter(F.size(w) < 7))
    return cut(hits.filter(F.col("text").contains(F.col("passage"))).select("query_id", "id").union(short), "targets")


_POSTINGS = f"""
tok as (select doc_id as id, {tokens_sql('text')} as t from documents),
n as (select count(*) as n, avg(len(t)) as mean from tok),
post as (select id, token, count(*) as tf, any_value(dl) as dl from (select id, len(t) as dl, unnest(t) as token from tok) group by all),
df as (select token, count(*) as df from post group by token),
term as (select distinct item_id as query_id, unnest({tokens_sql('text')}) as token from benchmark),
scored as (
  select query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) as score
  from post join term using (token) join df using (token), n group by all),
lexical as (select *, row_number() over (partition by query_id order by score desc, id) as rank from scored)"""
_HASH = "(list_reduce(list_transform(string_split({t}, ''), lambda c: ascii(c)::bigint), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::bigint) % 256)"
_VECTOR = f"""
eb as (select id, b, count(*) as c from (select id, {_HASH.format(t='token')} as b, tf from post, unnest(range(tf)) u) group by all),
en as (select id, b, c / sqrt(sum(c * c) over (partition by id)) as w from eb),
qt as (select item_id as query_id, unnest({tokens_sql('text')}) as token from benchmark),
qb as (select query_id, {_HASH.format(t='token')} as b, count(*) as c from qt group by all),
qn as (select query_id, b, c / sqrt(sum(c * c) over (partition by query_id)) as w from qb),
cosine as (select query_id, id, round(sum(en.w * qn.w), 6) as score from en join qn using (b) group by all),
vector as (select *, row_number() over (partition by query_id order by score desc, id) as rank from cosine)"""


@query(f"with {_POSTINGS} select query_id, id, score, rank::int as rank from lexical where rank <= 10")
def q112_bm25_topk(spark, d):
    return R.bm25(index(spark, d), questions(spark, d), 10)


@query("""with s as (select q.vec_id as query_id, v.vec_id as id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as score from embeddings q, embeddings v where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, id)::int as rank from s) select * from r where rank <= 10""")
def q113_vector_topk(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return R.vector_topk(v, v.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), 10)


@query(f"with {_POSTINGS}, h as (select * from lexical where rank <= 10) select query_id, count(*) filter (where id % 3 <> 0 and id % 5 <> 0)::bigint as kept, count(*) filter (where id % 3 = 0)::bigint as dropped_unknown, count(*) filter (where id % 3 <> 0 and id % 5 = 0)::bigint as dropped_no_text from h group by query_id")
def q115_drop_accounting(spark, d):
    c = chunks(spark, d)
    return R.with_drops(R.bm25(index(spark, d), questions(spark, d), 10), c.filter("id % 3 <> 0"), c.filter("id % 5 <> 0"))


@query(f"""with {_POSTINGS}, {_VECTOR}, u as (select query_id, id, 'lexical' as source, 1 / (60 + rank) as s from lexical where rank <= 40 union all select query_id, id, 'vector', 1 / (60 + rank) from vector where rank <= 40),
f as (select query_id, id, round(sum(s), 6) as score, array_to_string(list_sort(list(distinct source)), '+') as sources from u group by all)
select *, row_number() over (partition by query_id order by score desc, id)::int as rank from f""")
def q116_rrf(spark, d):
    q = questions(spark, d)
    vq = R.hashed_embedding(q.select(F.col("query_id").alias("id"), "text")).select(F.col("id").alias("query_id"), "v")
    return R.rrf([("lexical", R.bm25(index(spark, d), q, 40), 1.0), ("vector", R.vector_topk(embedded(spark, d), vq, 40), 1.0)])


@query(f"""with {_POSTINGS}, h as (select * from lexical where rank <= 40), q as (select item_id as query_id, list_distinct({tokens_sql('text')}) as q from benchmark),
s as (select query_id, id, round(len(list_intersect(q, list_distinct(t))) / len(list_distinct(list_concat(q, t))), 6) as score from h join q using (query_id) join tok using (id))
select *, row_number() over (partition by query_id order by score desc, id)::int as rank from s""")
def q117_lexical_rerank(spark, d):
    c, q = chunks(spark, d), questions(spark, d)
    return R.lexical_rerank(R.bm25(index(spark, d), q, 40), q, c)


@query()
def q120_hybrid_search(spark, d):
    return R.hybrid(chunks(spark, d), questions(spark, d), index=index(spark, d), embedded=embedded(spark, d))


@query(f"""with {_POSTINGS} select query_id, id, case when max(score) over w = min(score) over w then 1 else round((score - min(score) over w) / (max(score) over w - min(score) over w), 6) end as relevance
from lexical where rank <= 10 window w as (partition by query_id)""")
def q055_relevance(spark, d):
    w = Window.partitionBy("query_id")
    hits = R.bm25(index(spark, d), questions(spark, d), 10)
    low, high = F.min("score").over(w), F.max("score").over(w)
    return hits.select("query_id", "id", F.when(low == high, 1.0).otherwise(F.round((F.col("score") - low) / (high - low), 6)).alias("relevance"))


@query("""with n as (select doc_id, len(string_split(text, chr(10)))::int as n from documents), s as (select doc_id, n, unnest(range(1, n + 1, 60))::int as start from n)
select doc_id, start, least(start + 59, n)::int as "end" from s""")
def q121_windows(spark, d):
    n = table(spark, d, "documents").select("doc_id", F.explode(K.windows(F.lit(1), F.size(F.split("text", "\n")))).alias("w"))
    return n.select("doc_id", "w.start", "w.end")


_SPANS = """spans as (select l_orderkey as file, l_partkey || '-' || l_suppkey as name, min(l_linenumber * 10)::int as start, min(case when l_returnflag <> 'R' then l_linenumber * 10 + l_quantity end)::int as "end" from lineitem group by all)"""
#: Symbols (file, name, start, end, lines): an open one ends before the next, within a window; all inside the file.
_CLOSED = """c as (select file, name, greatest(1, least(start, lines)) as start, lines,
    coalesce("end", least(coalesce(lead(start) over (partition by file order by start, coalesce("end", start) desc, name), lines + 1) - 1, greatest(start, 1) + 59)) as e,
    row_number() over (partition by file order by start, coalesce("end", start) desc, name) as place from sized),
  closed as (select file, name, start, greatest(start, least(e, lines)) as "end", place from c),
  k as (select *, coalesce(max("end") over (partition by file order by place rows between unbounded preceding and 1 preceding), 0) as covered from closed)"""


def _spans(spark, d):
    end = F.when(F.col("l_returnflag") != "R", F.col("l_linenumber") * 10 + F.col("l_quantity"))
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("file"), F.concat_ws("-", "l_partkey", "l_suppkey").alias("name")).agg(F.min(F.col("l_linenumber") * 10).cast("int").alias("start"), F.min(end).cast("int").alias("end"))


@query(f"""with {_SPANS}, sized as (select *, 65 as lines from spans), {_CLOSED}
select file, name, start, "end" from k where start > covered""")
def q121_span_sweep(spark, d):
    return K.chosen(K.closed(_spans(spark, d).withColumn("lines", F.lit(65)))).drop("lines")


#: Symbols of a document: its lines that begin with a vowel; those of even length end after as many lines as they have words, in tens.
_LINES_OF = "select doc_id as file, unnest(string_split(text, chr(10))) as t, unnest(range(1, len(string_split(text, chr(10))) + 1))::int as line from documents"
_SYMBOLS = r"""l as (%s), n as (select file, max(line) as lines from l group by file),
sized as (select l.file, split_part(t, ' ', 1) as name, line as start, (case when length(t) %% 2 = 0 then line + len(string_split(t, ' ')) // 10 end)::int as "end", lines from l join n using (file) where regexp_matches(t, '^[AEIOUaeiou]'))""" % _LINES_OF  # noqa: UP031


@query(f"""with recursive {_SYMBOLS}, {_CLOSED}, s as (select file, name, start, "end" from k where start > covered),
g as (select n.file, s.name, s.start, s."end", lines, coalesce(lag(s."end") over w, 0) + 1 as f, lead(n.file) over w is null as last from n left join s using (file) window w as (partition by n.file order by s.start)),
gaps as (select file, f, start - 1 as u from g where start > f union all select file, coalesce("end", 0) + 1, lines from g where last and coalesce("end", 0) < lines),
p as (select file, name, start, "end" from s union all select file, null, a::int, least(a + 59, u)::int from (select file, u, unnest(range(f, u + 1, 60)) as a from gaps)),
r as (select row_number() over (order by file, start) as id, * from p), x as (select id, line, {units_sql('t')} as z from r join l on l.file = r.file and line between start and "end"),
whole as (select id, ceil((sum(z + 1) - 1) / 4)::bigint as tokens from x group by id),
w(id, line, a, total) as (select id, line, line, ceil((z + 1) / 4)::bigint from x join r using (id) join whole using (id) where line = start and tokens > 256 union all
  select x.id, x.line, case when w.total + ceil((z + 1) / 4) > 256 then x.line else w.a end, (case when w.total + ceil((z + 1) / 4) > 256 then 0 else w.total end + ceil((z + 1) / 4))::bigint from w join x on x.id = w.id and x.line = w.line + 1),
parts as (select id, a as start, max(line)::int as "end" from w group by all union all select id, start, "end" from r join whole using (id) where tokens <= 256)
select file, name, q.start, q."end", (select ceil((sum(z + 1) - 1) / 4)::bigint from x where x.id = q.id and x.line between q.start and q."end") as tokens from parts q join r using (id)""")
def q121_chunk_plan(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file"), "text")
    l = docs.select("file", F.posexplode(F.split("text", "\n")).alias("line", "t")).filter(F.col("t").rlike("^[AEIOUaeiou]"))  # noqa: E741
    words = F.size(F.split("t", " "))
    start = (F.col("line") + 1).cast("int")
    end = F.when(F.length("t") % 2 == 0, (start + F.floor(words / 10)).cast("int"))
    return K.plan_chunks(docs, l.select("file", F.element_at(F.split("t", " "), 1).alias("name"), start.alias("start"), end.alias("end")), most=256)


_FOLD = """with recursive e as ({rows}),
w(g, k, batch, n, total, o) as (select g, k, 0, 1, size, o from e where k = 1 union all
  select e.g, e.k, case when w.n >= {most} or w.total + e.size > {budget} then w.batch + 1 else w.batch end, case when w.n >= {most} or w.total + e.size > {budget} then 1 else w.n + 1 end,
    case when w.n >= {most} or w.total + e.size > {budget} then e.size else w.total + e.size end, e.o from w join e on e.g = w.g and e.k = w.k + 1)"""
_LINES = f"select g, row_number() over (partition by g order by o) as k, o, ceil({units_sql('t')} / 4)::bigint as size from (select doc_id as g, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) - 1 as o from documents)"
_TURNS = f"select conv_id as g, row_number() over (partition by conv_id order by turn) as k, turn as o, ceil({units_sql('text')} / 4)::bigint as size from conversations"


@query(_FOLD.format(rows=_LINES, most=1_000_000, budget=256) + " select g as doc_id, batch, min(o) as first, count(*) as lines from w group by all")
def q122_split_by_tokens(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    packed = R.greedy_batches(rows.withColumn("size", T.estimate_tokens(F.col("t"))), "doc_id", "line", "size", 1_000_000, 256)
    return packed.groupBy("doc_id", "batch").agg(F.min("line").alias("first"), F.count("*").alias("lines"))


@query(_FOLD.format(rows=_TURNS, most=3, budget=60) + " select g as conv_id, batch, count(*) as n from w group by all")
def q125_embed_batches(spark, d):
    rows = table(spark, d, "conversations").withColumn("size", T.estimate_tokens(F.col("text")))
    return R.greedy_batches(rows, "conv_id", "turn", "size", 3, 60).groupBy("conv_id", "batch").agg(F.count("*").alias("n"))


@query("""with k as (select doc_id, sha256(text) as key from documents), c as (select distinct key from k where doc_id % 2 = 0)
select (key in (select key from c)) as cached, count(*) as n, count(distinct key) as keys from k group by all""")
def q126_cache_aware_embed(spark, d):
    k = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("key"))
    return L.cached(k, "key", k.filter("doc_id % 2 = 0"))


_TARGETS = "target as (select item_id as query_id, doc_id as id from benchmark b join documents d on contains(d.text, b.text))"
_SCORED = f"""{_POSTINGS}, {_TARGETS}, hit as (select * from lexical where rank <= 5),
per as (select b.item_id as query_id, count(t.id) as expected, count(h.id) as found, min(h.rank) as first from benchmark b left join target t on t.query_id = b.item_id left join hit h on h.query_id = t.query_id and h.id = t.id group by all)"""


@query(f"with {_TARGETS} select * from target")
def q079_targets(spark, d):
    return targets(spark, d)


def _scored(spark, d):
    q = questions(spark, d)
    return E.score_questions(q.select("query_id"), targets(spark, d), R.bm25(index(spark, d), q, 5))


@query(f"with {_SCORED} select query_id, expected, found, round(case when expected = 0 then 0 else found / expected end, 6) as recall, round(coalesce(1 / first, 0), 6) as reciprocal_rank, found > 0 as hit, expected = 0 as negative from per")
def q173_score_questions(spark, d):
    return _scored(spark, d)


@query(f"with {_SCORED} select count(*) as questions, count(*) filter (where expected = 0) as negatives, round(coalesce(avg(found / expected) filter (where expected > 0), 0), 6) as recall, round(coalesce(avg(coalesce(1 / first, 0)) filter (where expected > 0), 0), 6) as mrr from per")
def q174_aggregate_rag(spark, d):
    return E.aggregate_rag(_scored(spark, d))


_SETS = """sets as (select o_custkey as id, list(distinct l_suppkey) filter (where l_returnflag = 'N') as expected, list(distinct l_suppkey) filter (where l_linestatus = 'F') as found from lineitem join orders on o_orderkey = l_orderkey group by all)"""


def _sets(spark, d):
    own = lines(spark, d).groupBy(F.col("o_custkey").alias("id"))
    return own.agg(F.collect_set(F.when(F.col("l_returnflag") == "N", F.col("l_suppkey"))).alias("expected"), F.collect_set(F.when(F.col("l_linestatus") == "F", F.col("l_suppkey"))).alias("found"))


_PRF = f"""with {_SETS}, c as (select id, len(coalesce(expected, [])) as e, len(coalesce(found, [])) as f, len(coalesce(list_intersect(expected, found), [])) as b from sets),
m as (select *, case when f = 0 then (case when e = 0 then 1 else 0 end) else b / f end as p, case when e = 0 then 1 else b / e end as r from c)"""


@query(f"{_PRF} select id, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r = 0 then 0 else 2 * p * r / (p + r) end, 6) as f1 from m")
def q177_precision_recall(spark, d):
    return _sets(spark, d).select("id", *E.precision_recall(F.col("expected"), F.col("found")))


@query(f"{_PRF} select round(sum(b) / sum(f), 6) as precision, round(sum(b) / sum(e), 6) as recall, round(2 * sum(b) / (sum(f) + sum(e)), 6) as f1 from m")
def q135_micro_average(spark, d):
    return E.micro_average(_sets(spark, d))


@query(f"{_PRF} select id, e = f and b = e as exact, (f - b)::int as fabricated, (e - b)::int as missed from m")
def q181_oracle_verifier(spark, d):
    return E.verify_sets(_sets(spark, d))


@query("""with x as (select count(*) as n, avg((quality = toxic)::int) as agree, avg(quality) as q, avg(toxic) as t from labels),
k as (select *, q * t + (1 - q) * (1 - t) as chance from x), y as (select *, (agree - chance) / (1 - chance) as kappa, sqrt(agree * (1 - agree) / n) / (1 - chance) as se from k)
select n, round(agree, 6) as agreement, round(kappa, 6) as kappa, round(kappa - 1.96 * se, 6) as low, round(kappa + 1.96 * se, 6) as high, n >= 20 and kappa >= 0.6 as gateable from y""")
def q179_kappa(spark, d):
    return E.kappa(table(spark, d, "labels"), "quality", "toxic")


@query("""with r as (select o_custkey as task, o_orderkey as verifier, greatest(0, least(1, o_totalprice / 400000)) as reward, o_orderstatus <> 'F' as pass from orders)
select task, round(avg(reward), 6) as score, bool_and(pass) as passed from r group by task""")
def q183_rewards(spark, d):
    o = table(spark, d, "orders")
    return E.rewards(o.select(F.col("o_custkey").alias("task"), (F.col("o_totalprice") / 400000).alias("reward"), (F.col("o_orderstatus") != "F").alias("pass")))


@query(f"""with {_SCORED}, a as (select avg(found / expected) filter (where expected > 0) as recall, count(*) filter (where expected = 0) as negatives from per),
g as (select 'recall' as gate, recall as value, 0.6 as threshold, recall >= 0.6 as ok from a union all select 'unjustified', negatives, 1, negatives <= 1 from a)
select gate, round(value, 6) as value, ok from g""")
def q176_thresholds(spark, d):
    return E.thresholds(E.aggregate_rag(_scored(spark, d)), [("recall", "recall", ">=", 0.6), ("unjustified", "negatives", "<=", 1)])


@query(f"""with {_POSTINGS}, {_TARGETS}, h as (select * from lexical where rank <= 5),
x as (select *, row_number() over (partition by query_id order by rank) as k from h where not exists (select 1 from target t where t.query_id = h.query_id and t.id = h.id))
select query_id, string_agg(id::varchar, ',' order by k) as negatives from x where k <= 3 group by query_id""")
def q185_hard_negatives(spark, d):
    return E.hard_negatives(R.bm25(index(spark, d), questions(spark, d), 5), targets(spark, d))


@query(f"""with {_POSTINGS}, {_TARGETS}, {_VECTOR},
per as (select t.query_id, count(*) as n, count(l.id) as a, count(v.id) as b from target t left join lexical l on l.query_id = t.query_id and l.id = t.id and l.rank <= 3 left join vector v on v.query_id = t.query_id and v.id = t.id and v.rank <= 3 group by all)
select count(*) as questions, round(avg(a / n), 6) as recall_a, round(avg(b / n), 6) as recall_b, count(*) filter (where b > a) as won, count(*) filter (where b < a) as lost from per""")
def q187_arms_compared(spark, d):
    q = questions(spark, d)
    vq = R.hashed_embedding(q.select(F.col("query_id").alias("id"), "text")).select(F.col("id").alias("query_id"), "v")
    return E.compare_arms(targets(spark, d), R.bm25(index(spark, d), q, 3), R.vector_topk(embedded(spark, d), vq, 3))
