
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import retrieval as R

def search_code(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """151: lexical search with k held to 1..10."""
    return R.bm25(chunks, queries, max(1, min(10, k)))


def match_prefix(wanted: DataFrame, shas: DataFrame, length: int = 7) -> DataFrame:
    """82: the one sha that starts with each prefix (at least `length` long); null if none or several do."""
    keyed = shas.select("sha", F.substring("sha", 1, length).alias("key")).distinct()
    met = wanted.withColumn("key", F.substring("prefix", 1, length)).join(keyed, "key").filter(F.col("sha").startswith(F.col("prefix")))
    one = met.groupBy("prefix").agg(F.count("*").alias("n"), F.min("sha").alias("sha")).filter("n = 1").drop("n")
    return wanted.join(one, "prefix", "left")


def ground_findings(findings: DataFrame, known: DataFrame, most: int = 3) -> DataFrame:
    """160: findings (cluster, specialist, finding, importance, files) with the files that exist; the most important
    of each specialist stay, and what was dropped is counted."""
    each = findings.select("cluster", "specialist", "finding", "importance", F.explode("files").alias("file")).distinct()
    met = each.join(known.select("cluster", "file").distinct().withColumn("ok", F.lit(1)), ["cluster", "file"], "left")
    per = met.groupBy("cluster", "specialist", "finding", "importance").agg(F.count("ok").alias("grounded"), (F.count("*") - F.count("ok")).alias("dropped"))
    rank = F.row_number().over(Window.partitionBy("cluster", "specialist").orderBy(F.desc("importance"), "finding"))
    return per.filter("grounded > 0").withColumn("place", rank).filter(F.col("place") <= most)


def fan_out(communities: DataFrame, specialists: list[str], outputs: DataFrame) -> DataFrame:
    """162: a job for each community and specialist, and what became of it; specialists are literals."""
    jobs = communities.select("cluster", F.explode(F.array(*map(F.lit, specialists))).alias("specialist"))
    return jobs.join(outputs.groupBy("cluster", "specialist").agg(F.count("*").alias("findings")), ["cluster", "specialist"], "left").withColumn("status", F.when(F.col("findings").isNull(), "empty").otherwise("ok")).fillna(0, ["findings"])


def renumber(order: DataFrame, known: DataFrame) -> DataFrame:
    """167: the entries of a reading order that exist, numbered anew, each file once."""
    first = order.groupBy("repo", "file").agg(F.min("position").alias("old")).join(known.select("repo", "file").distinct(), ["repo", "file"], "left_semi")
    return first.withColumn("position", F.row_number().over(Window.partitionBy("repo").orderBy("old", "file")))


def select_facts(metrics: DataFrame, cyclic: DataFrame, entries: DataFrame, key: int = 30, impact: int = 10, cycles: int = 15, entry: int = 50) -> DataFrame:
    """168: what a prompt shows, at most so many of each: key files, files of widest impact, cycles (by their first file, the largest first) and
    entry points (repo, file)."""

    def best(section: str, column: str, most: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc(column), "file"))
        return metrics.filter(F.col(column) > 0).select("repo", F.lit(section).alias("section"), "file", rank.alias("place")).filter(F.col("place") <= most)

    rings = cyclic.groupBy("repo", F.col("component").alias("file")).agg(F.count("*").alias("n"))
    ring = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("n"), "file"))
    rings = rings.select("repo", F.lit("cycle").alias("section"), "file", ring.alias("place")).filter(F.col("place") <= cycles)
    first = F.row_number().over(Window.partitionBy("repo").orderBy("file"))
    starts = entries.select("repo", "file").distinct().select("repo", F.lit("entry").alias("section"), "file", first.alias("place")).filter(F.col("place") <= entry)
    return reduce(DataFrame.union, [best("key", "centrality", key), best("impact", "blast_radius", impact), rings, starts])


def domain_lanes(files: DataFrame, group: str) -> DataFrame:
    """165, 147, 148: a title for each group of files (group, path, tag): their common folder and their dominant tag."""
    from .agentops import common_prefix

    n = files.groupBy(group, "tag").agg(F.count("*").alias("n"))
    tag = n.groupBy(group).agg(F.min_by("tag", F.struct(-F.col("n"), "tag")).alias("tag"), F.sum("n").alias("files"))
    return common_prefix(files, group).join(tag, group)


def split_overflow(fields: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """15: fields (doc, field, place, value) of documents cut to a limit of bytes: (what stays, what goes to a side table, manifests).

    While a document has more than the limit, its fields go in order of place; those without a place never go, and empty ones (null, '' or [])
    aren't worth it. Manifests (doc, shed, bytes, kept_bytes, too_large) are of the documents that shed something or are still too large."""
    size = F.coalesce(F.octet_length("value"), F.lit(0))
    goes = F.col("place").isNotNull() & ~F.coalesce(F.trim("value").isin("", "[]"), F.lit(True))
    by = Window.partitionBy("doc").orderBy(F.col("place").asc_nulls_last(), "field")
    before = F.coalesce(F.sum(F.when(goes, size).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = fields.withColumns({"__size": size, "__shed": goes & (F.sum(size).over(Window.partitionBy("doc")) - before > limit)})
    told = rows.groupBy("doc").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("__shed"), F.struct("place", "field")))), lambda x: x["field"]).alias("shed"), F.sum("__size").alias("bytes"), F.sum(F.when(~F.col("__shed"), F.col("__size")).otherwise(0)).alias("kept_bytes")
    )
    told = told.withColumn("too_large", F.col("kept_bytes") > limit).filter((F.size("shed") > 0) | F.col("too_large"))
    return rows.filter(~F.col("__shed")).drop("__size", "__shed"), rows.filter("__shed").select("doc", "field", "value"), told


def rehydrate(stored: DataFrame, side: DataFrame, manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """15: (doc, field, value) of documents with what was shed put back, and (doc, missing): the fields that a manifest names and the side table
    lacks. A missing field stays away; an empty one would be a statement of its own."""
    named = manifests.select("doc", F.explode("shed").alias("field"))
    back = named.join(side.select("doc", "field", "value", F.lit(True).alias("there")), ["doc", "field"], "left")
    missing = back.filter("there is null").groupBy("doc").agg(F.array_sort(F.collect_list("field")).alias("missing"))
    return stored.select("doc", "field", "value").union(back.filter("there").select("doc", "field", "value")), missing


def same_space(vectors: DataFrame, model: str, dim: int) -> DataFrame:
    """63: vectors (id, model, v) after proof that all are of one space; reading them fails if one isn't."""
    ok = (F.col("model") == model) & (F.size("v") == dim)
    return vectors.filter(F.assert_true(F.coalesce(ok, F.lit(False)), F.lit(f"a vector isn't of {model}/{dim}")).isNull())


def sandbox(files: DataFrame, asked: DataFrame, commit: str) -> DataFrame:
    """227: which of the files asked for (path, commit) a snapshot has; another commit than its own fails."""
    right = F.assert_true(F.col("commit") == commit, F.lit("the snapshot is of another commit"))
    known = files.select("path").distinct().withColumn("member", F.lit(True))
    return asked.filter(right.isNull()).join(known, "path", "left").select("path", F.coalesce("member", F.lit(False)).alias("member"))
