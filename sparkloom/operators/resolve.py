
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import join_posix

#: What may stand after an import's path, in order of preference.
SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def _first_match(wanted: DataFrame, candidates: Column, files: DataFrame, keys: list[str]) -> DataFrame:
    """The first of each row's candidates that is a file: they are exploded with their rank and joined by equality."""
    each = wanted.select(*keys, F.posexplode(candidates).alias("rank", "path"))
    met = each.join(files.select("path").distinct(), "path")
    return met.groupBy(*keys).agg(F.min_by("path", "rank").alias("target"))


def resolve_js(imports: DataFrame, files: DataFrame) -> DataFrame:
    """39: imports (from, line, source) with the file that a relative source means; null where there is none."""
    keys = ["from", "line", "source"]
    base = join_posix(F.concat(folder(F.col("from")), F.lit("/"), F.col("source")))
    near = imports.filter(F.col("source").startswith("."))
    found = _first_match(near, F.transform(F.array(*map(F.lit, SUFFIXES)), lambda s: F.concat(base, s)), files, keys)
    return imports.join(found, keys, "left")


def resolve_python(imports: DataFrame, files: DataFrame) -> DataFrame:
    """39: a module is a file or a package; each dot after the first goes up one folder."""
    keys = ["from", "line", "source"]
    dots = F.length(F.regexp_extract("source", r"^(\.*)", 1))
    module = F.replace(F.regexp_replace("source", r"^\.+", ""), F.lit("."), F.lit("/"))
    up = F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0)))
    base = join_posix(F.concat(folder(F.col("from")), F.lit("/"), up, module))
    return imports.join(_first_match(imports, F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py"))), files, keys), keys, "left")


#: What links look like in Markdown, what isn't read, and schemes that lead elsewhere.
FENCED = (r"(?s)```.*?```", r"(?s)~~~.*?~~~", r"`[^`\n]*`")
WIKI = r"\[\[([^\]|#]+?)(?:#[^\]|]*)?(?:\|[^\]]+)?\]\]"
LINK = r"(!?\[(?:[^\[\]]|\[[^\[\]]*\])*\]\([^)\s]+?(?:\s+\"[^\"]*\")?\))"
ELSEWHERE = r"(?i)^(?:https?:|mailto:|ftp:|file:|tel:|#)"


def markdown_links(files: DataFrame) -> DataFrame:
    """45: (from, kind, link): wiki links and links of Markdown files (path, content), outside fences and code. Images, other schemes and bare anchors
    are left out."""
    text = F.col("content")
    for pattern in FENCED:
        text = F.regexp_replace(text, pattern, "")
    rows = files.select(F.col("path").alias("from"), text.alias("t"))
    wiki = rows.select("from", F.lit("wikilink").alias("kind"), F.explode(F.regexp_extract_all("t", F.lit(WIKI), F.lit(1))).alias("link")).withColumn("link", F.trim("link"))
    whole = rows.select("from", F.lit("mdlink").alias("kind"), F.explode(F.regexp_extract_all("t", F.lit(LINK), F.lit(1))).alias("x")).filter(~F.col("x").startswith("!"))
    url = F.regexp_extract("x", r"\]\(([^)\s]+?)(?:\s+\"[^\"]*\")?\)$", 1)
    inside = whole.select("from", "kind", url.alias("link")).filter(~F.col("link").rlike(ELSEWHERE) & (F.regexp_replace("link", "[#?].*$", "") != ""))
    return wiki.union(inside)


def resolve_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """45: links (from, link, and kind if there is one) with their target: by path from the file's folder, or from the root after a slash, as it is or
    with .md or .markdown; else, and for wiki links at once, the least path of that base name. Case doesn't matter; null without a target."""
    keys = ["from", "link"]
    own = links.select(*keys, (F.col("kind") == "wikilink" if "kind" in links.columns else F.lit(False)).alias("wiki")).distinct()
    bare = F.regexp_replace("link", "[#?].*$", "")
    base = F.lower(join_posix(F.when(bare.startswith("/"), bare).otherwise(F.concat(folder(F.col("from")), F.lit("/"), bare))))
    known = files.groupBy(F.lower("path").alias("path")).agg(F.min("path").alias("file"))
    exact = _first_match(own.filter(~F.col("wiki")), F.array(base, F.concat(base, F.lit(".md")), F.concat(base, F.lit(".markdown"))), known, keys)
    exact = exact.join(known, exact["target"] == known["path"]).select(*keys, "file")
    last = F.lower(F.element_at(F.split("path", "/"), -1))
    named = files.groupBy(last.alias("name")).agg(F.min("path").alias("by_name")).filter(F.col("name").rlike(r"\.(md|markdown)$"))
    name = F.lower(F.element_at(F.split(bare, "/"), -1))
    each = own.withColumn("n", F.when(name.rlike(r"\.(md|markdown)$"), F.array(name)).otherwise(F.array(F.concat(name, F.lit(".md")), F.concat(name, F.lit(".markdown"))))).select(*keys, F.explode("n").alias("name"))
    found = each.join(named, "name").groupBy(*keys).agg(F.min("by_name").alias("by_name"))
    out = links.join(exact, keys, "left").join(found, keys, "left")
    return out.select(*links.columns, F.coalesce("file", "by_name").alias("target"))


def unique_suffix(names: DataFrame, files: DataFrame) -> DataFrame:
    """81: files that are the name or end in it after a slash, where only one is. Every tail of a path is a key."""
    segments = F.split("path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.array_join(F.slice(segments, i, F.size(segments)), "/"))
    keyed = files.select("path", F.explode(tails).alias("name"))
    met = names.join(keyed, "name").groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    return names.join(met.filter("n = 1").drop("n"), "name", "left")


def merge_symbols(symbols: DataFrame, exports: DataFrame) -> DataFrame:
    """38: exported names mark symbols of that name; other exports become symbols."""
    names = exports.select("path", "name").distinct().withColumn("__e", F.lit(True))
    marked = symbols.join(names, ["path", "name"], "left").withColumn("exported", F.coalesce("__e", F.lit(False)) | F.col("exported")).drop("__e")
    rest = exports.join(symbols.select("path", "name"), ["path", "name"], "left_anti").select("path", "name", "line", "kind", F.lit(True).alias("exported"))
    return marked.select("path", "name", "line", "kind", "exported").unionByName(rest)


def dependency_edges(resolved: list[DataFrame]) -> DataFrame:
    """Edges (src, dst, line) of resolved imports."""
    return reduce(DataFrame.unionByName, [r.filter("target is not null").select(F.col("from").alias("src"), F.col("target").alias("dst"), "line") for r in resolved])
