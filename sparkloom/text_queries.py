"""Queries of the scalars over text, paths and vectors, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import relational as L
from .operators import resolve as V
from .operators import support as U
from .plans.lineage import spread
from .sources.bindings import table

QUERIES, SQL = {}, {}


def units_sql(text: str) -> str:
    """UTF-16 units: characters, and those beyond the first 65536 once more."""
    return rf"(length({text}) + length(regexp_replace({text}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Macros stand before the query as expressions: the oracle's regular expressions know no lookaround.
def tokens_sql(text: str) -> str:
    split = r"string_split(regexp_replace(regexp_replace(regexp_replace(w, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), ' ')"
    return f"list_filter(flatten(list_transform(list_filter(string_split_regex({text}, '[^A-Za-z0-9]+'), lambda w: w <> ''), lambda w: list_concat([lower(w)], case when len({split}) > 1 then list_transform({split}, lambda p: lower(p)) else [] end))), lambda t: length(t) >= 2)"


@query(f"with t as (select doc_id, {tokens_sql('text')} as t from documents) select doc_id, len(t)::bigint as n_tokens, len(list_distinct(t))::bigint as n_distinct, md5(array_to_string(t, ' ')) as digest from t")
def q047_tokenize_code(spark, d):
    t = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", T.tokenize_code(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@query(r"""with w as (select page_id, list_distinct(list_filter(flatten(list_transform(list_filter(string_split_regex(regexp_replace(url, '\.[A-Za-z0-9]+$', ''), '[^A-Za-z0-9]+'), lambda w: w <> ''),
  lambda w: list_transform(string_split(regexp_replace(regexp_replace(w, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), ' '), lambda p: lower(p)))), lambda p: length(p) >= 2)) as w from pages)
select page_id, case when len(w) > 1 then array_to_string(list_sort(w), ' ') else '' end as words from w""")
def q048_path_words(spark, d):
    w = table(spark, d, "pages").select("page_id", T.path_words(F.col("url")).alias("w"))
    return w.select("page_id", F.when(F.col("w") == "", "").otherwise(F.array_join(F.array_sort(F.split("w", " ")), " ")).alias("words"))


@query(f"select doc_id, ceil({units_sql('text')} / 4)::bigint as tokens from documents")
def q049_estimate_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query("""select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def q050_cosine_of_neighbours(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    both = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    return both.select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("select page_id, list_reduce(list_transform(string_split(url, ''), lambda c: ascii(c)::bigint), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::bigint) as hash from pages")
def q051_fnv1a(spark, d):
    return table(spark, d, "pages").select("page_id", T.fnv1a(F.col("url")).alias("hash"))


@query(f"""with t as (select conv_id, turn, unnest({tokens_sql('text')}) as t from conversations),
h as (select conv_id, turn, list_reduce(list_transform(string_split(t, ''), lambda c: ascii(c)::bigint), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::bigint) % 256 as bucket from t),
n as (select conv_id, turn, bucket, count(*) as n from h group by all)
select conv_id, turn, bucket, round(n / sqrt(sum(n * n) over (partition by conv_id, turn)), 6) as weight from n""")
def q052_hashed_embedding(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.explode(T.tokenize_code(F.col("text"))).alias("t"))
    n = t.groupBy("conv_id", "turn", (T.fnv1a(F.col("t")) % 256).alias("bucket")).agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("conv_id", "turn")))
    return n.select("conv_id", "turn", "bucket", F.round(F.col("n") / norm, 6).alias("weight"))


_TURNS = f"t as (select conv_id, turn, list_distinct({tokens_sql('text')}) as a from conversations), p as (select conv_id, turn, a, lag(a) over (partition by conv_id order by turn) as b from t)"


@query(f"with {_TURNS} select conv_id, turn, case when len(a) = 0 or len(b) = 0 then 0 else round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) end as jaccard from p where b is not null")
def q053_jaccard_of_turns(spark, d):
    t = table(spark, d, "conversations").withColumn("a", F.array_distinct(T.tokenize_code(F.col("text"))))
    t = t.withColumn("b", F.lag("a").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("b is not null")
    return t.select("conv_id", "turn", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query(f"with {_TURNS} select conv_id, turn, case when len(a) = 0 then 0 else round(len(list_intersect(a, b)) / len(a), 6) end as overlap from p where b is not null")
def q054_overlap_with_last_turn(spark, d):
    t = table(spark, d, "conversations").withColumn("a", F.array_distinct(T.tokenize_code(F.col("text"))))
    t = t.withColumn("b", F.lag("a").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("b is not null")
    return t.select("conv_id", "turn", F.round(T.overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


@query("""select event_id, case when max(value) over w = min(value) over w then 1 else round((value - min(value) over w) / (max(value) over w - min(value) over w), 6) end as score from events window w as (partition by user_id)""")
def q055_normalize_scores(spark, d):
    return L.normalised(table(spark, d, "events"), "user_id", "value").select("event_id", "score")


@query(r"""with f as (select conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from conversations)
select conv_id, turn, case when length(t) <= 40 then t else substr(t, 1, 39) || '…' end as text from f""")
def q056_truncate(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.truncate(F.col("text"), 40).alias("text"))


@query("""select doc_id, concat_ws(chr(10), 'file: ' || source || '/' || doc_id, 'language: ' || lang, case when n_chars > 1000 then 'symbol: s' || doc_id end) as header from documents""")
def q057_embed_header(spark, d):
    text = F.col("doc_id").cast("string")
    none = F.lit(None).cast("string")
    symbol = F.when(F.col("n_chars") > 1000, F.concat(F.lit("s"), text))
    return table(spark, d, "documents").select("doc_id", U.embed_header(F.concat("source", F.lit("/"), text), F.col("lang"), none, symbol, none, none).alias("header"))


_LINE = "'  /** ' || substr(text, 1, 20) || ' **/'"


@query(rf"""select conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({_LINE}), '\*+/$', ''), '^/\*+', ''), '^//+', ''), '^#+', ''), '^\*+', '')) as line from conversations""")
def q058_strip_comment(spark, d):
    line = F.concat(F.lit("  /** "), F.substring("text", 1, 20), F.lit(" **/"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.strip_comment(line).alias("line"))


@query("select doc_id, sha256('m1' || chr(10) || replace(text, chr(13) || chr(10), chr(10))) as key from documents")
def q059_embed_cache_key(spark, d):
    return table(spark, d, "documents").select("doc_id", U.embed_key("m1", F.col("text")).alias("key"))


@query(r"select page_id, lower(regexp_extract(list_extract(string_split(regexp_replace(url, '[?#].*$', ''), '/'), -1), '^.+(\.[^.]+)$', 1)) as ext, length(html)::bigint as size from pages")
def q022_extension(spark, d):
    bare = F.regexp_replace("url", r"[?#].*$", "")
    return table(spark, d, "pages").select("page_id", T.extension(bare).alias("ext"), F.length("html").cast("long").alias("size"))


_PATHS = {"src/a.test.ts": 0, "docs/guide/x.md": 1, "Dockerfile": 2, "config/app.yaml": 3, "img/logo.png": 4, "src/main.py": 5, "bin/run": 6}
_PATH_SQL = "(case p_partkey % 7 " + " ".join(f"when {k} then '{p}'" for p, k in _PATHS.items()) + " end)"
_ROLES = ["test", "docs", "build", "config", "asset", "source", "other"]


def _path():
    out = F.lit(None)
    for p, k in _PATHS.items():
        out = F.when(F.col("p_partkey") % 7 == k, p).otherwise(out)
    return out


@query("select case p_partkey % 7 " + " ".join(f"when {i} then '{r}'" for i, r in enumerate(_ROLES)) + " end as role, case p_partkey % 7 when 0 then 'TypeScript' when 1 then 'Markdown' when 3 then 'YAML' when 5 then 'Python' else 'Unknown' end as language, count(*) as n from part group by all")
def q023_role_and_language(spark, d):
    return table(spark, d, "part").groupBy(T.role(_path()).alias("role"), T.language(_path()).alias("language")).agg(F.count("*").alias("n"))


@query(r"select doc_id, len(list_filter(string_split_regex(text, '\r\n|\r|\n'), lambda x: trim(x) <> ''))::bigint as loc, length(text)::bigint as chars from documents")
def q026_loc(spark, d):
    return table(spark, d, "documents").select("doc_id", T.loc(F.col("text")).alias("loc"), F.length("text").cast("long").alias("chars"))


@query("select p_partkey, 'lib/' || replace(p_name, ' ', '/') || '/x' as path from part")
def q040_join_posix(spark, d):
    raw = F.concat(F.lit("src/.././lib//"), F.replace("p_name", F.lit(" "), F.lit("/./")), F.lit("/y/../x"))
    return table(spark, d, "part").select("p_partkey", T.join_posix(raw).alias("path"))


@query("select conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> ''))), ' ') as key from conversations")
def q066_headline_key(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.headline_key(F.col("text")).alias("key"))


@query("select p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9._/@-]+', '-', 'g'), '^-+|-+$', '', 'g') || '@' || p_size || '/m-1/' || p_size as namespace from part")
def q012_namespace(spark, d):
    repo = F.concat("p_name", F.lit(" "), "p_brand")
    return table(spark, d, "part").select("p_partkey", T.namespace(repo, F.col("p_size").cast("string"), F.lit("-M 1"), F.col("p_size")).alias("namespace"))


@query("select c_custkey, c_mktsegment || '.' || c_custkey as id, true as ok, false as bad from customer")
def q224_session_id(spark, d):
    name = F.concat("c_mktsegment", F.lit("."), F.col("c_custkey").cast("string"))
    return table(spark, d, "customer").select("c_custkey", name.alias("id"), T.session_id_ok(name).alias("ok"), T.session_id_ok(F.col("c_name")).alias("bad"))


@query("select conv_id, turn, trim(text) as text from conversations")
def q226_strip_fence(spark, d):
    fenced = F.concat(F.lit("```json\n"), F.trim("text"), F.lit("\n```"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.trim(T.strip_fence(fenced)).alias("text"))


_HREF = r"""href=["\x27]([^"\x27]+)["\x27]"""


@query(r"""with l as (select page_id, unnest(regexp_extract_all(html, 'href=["\x27]([^"\x27]+)["\x27]', 1)) as href from pages)
select page_id, count(*) as links, count(distinct href) as targets, count(*) filter (where regexp_matches(href, '^[a-z]+:')) as external from l group by page_id""")
def q045_links(spark, d):
    links = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))).alias("href"))
    return links.groupBy("page_id").agg(F.count("*").alias("links"), F.count_distinct("href").alias("targets"), F.sum(F.col("href").rlike("^[a-z]+:").cast("long")).alias("external"))


#: A Markdown file for each page: its links, links to other pages in several forms, and what isn't a link.
_MD = r"""p as (select page_id as id, 'docs/g' || (page_id % 7) || '/p' || page_id || '.md' as path, regexp_replace(html, '<a href="([^"]+)">([^<]*)</a>', '[\2](\1)', 'g') || chr(10) || '[next](../g' || ((page_id + 1) % 7) || '/p' || (page_id + 1) || '.md#top) ![i](p' || page_id || '.md) `[c](p1.md)` [root](/docs/g'
    || ((page_id + 2) % 7) || '/P' || (page_id + 2) || ') [[p' || (page_id + 3) || '|see]] [far](p' || (page_id + 4) || ' "t")' || chr(10) || '```' || chr(10) || '[no](p2.md)' || chr(10) || '```' || chr(10) || '[w](https://x.org/p3.md)' as content from pages),
c as (select id, path, regexp_replace(regexp_replace(regexp_replace(content, '```[\s\S]*?```', '', 'g'), '~~~[\s\S]*?~~~', '', 'g'), '`[^`\n]*`', '', 'g') as t from p),
l as (select path, 'wikilink' as kind, trim(unnest(regexp_extract_all(t, '\[\[([^\]|#]+?)(?:#[^\]|]*)?(?:\|[^\]]+)?\]\]', 1))) as link from c
  union all select path, 'mdlink', regexp_extract(x, '\]\(([^)\s]+?)(?:\s+"[^"]*")?\)$', 1) from (select path, unnest(regexp_extract_all(t, '(!?\[(?:[^\[\]]|\[[^\[\]]*\])*\]\([^)\s]+?(?:\s+"[^"]*")?\))', 1)) as x from c) where x not like '!%'),
k as (select *, regexp_replace(link, '[#?].*$', '') as bare from l where not regexp_matches(link, '^(?i:https?:|mailto:|ftp:|file:|tel:|#)') and regexp_replace(link, '[#?].*$', '') <> ''),
n as (select *, lower(case when bare like '/%' then substr(bare, 2) when bare like '../%' then 'docs/' || substr(bare, 4) else regexp_replace(path, '[^/]*$', '') || bare end) as base, lower(regexp_extract(bare, '[^/]*$')) as name from k),
f as (select lower(path) as low, min(path) as file from p group by 1), b as (select lower(regexp_extract(path, '[^/]*$')) as name, min(path) as file from p group by 1)
select path as from_path, kind, link, coalesce(case when kind = 'mdlink' then (select min(file) from f where low = base or low = base || '.md') end, (select min(file) from b where b.name = n.name or b.name = n.name || '.md')) as target from n"""


@query("with " + _MD)
def q045_markdown_links(spark, d):
    p, k = table(spark, d, "pages"), F.col("page_id")
    at = lambda n, mod=7: ((k + n) % mod).cast("string") if mod else (k + n).cast("string")
    body = F.regexp_replace("html", '<a href="([^"]+)">([^<]*)</a>', "[$2]($1)")
    more = F.concat(F.lit("\n[next](../g"), at(1), F.lit("/p"), at(1, 0), F.lit(".md#top) ![i](p"), at(0, 0), F.lit(".md) `[c](p1.md)` [root](/docs/g"), at(2), F.lit("/P"), at(2, 0), F.lit(") [[p"), at(3, 0), F.lit("|see]] [far](p"), at(4, 0), F.lit(' "t")\n```\n[no](p2.md)\n```\n[w](https://x.org/p3.md)'))
    files = p.select(F.concat(F.lit("docs/g"), at(0), F.lit("/p"), at(0, 0), F.lit(".md")).alias("path"), F.concat(body, more).alias("content"))
    return V.resolve_links(V.markdown_links(files), files.select("path")).withColumnRenamed("from", "from_path")
