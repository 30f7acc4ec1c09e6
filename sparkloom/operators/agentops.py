
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Weights of a community's complexity and where its parts level off.
SIZE, COUPLING, CYCLES, DENSITY = 0.3, 0.3, 0.25, 0.15
FULL_SIZE, FULL_CYCLES, FULL_DENSITY = 20, 2, 12
MOST_COMMUNITIES, MOST_POINTS, HARD, MOST_HARD = 12, 5, 0.6, 3


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def complexity(nodes: DataFrame, edges: DataFrame, clusters: DataFrame, cyclic: DataFrame) -> DataFrame:
    """157: by size, share of outward edges, cycles through it and symbols per file of each cluster (repo, file, cluster)."""
    own = nodes.join(clusters, ["repo", "file"]).groupBy("repo", "cluster").agg(F.count("*").alias("size"), F.sum("symbols").alias("symbols"))
    of = lambda c: clusters.select("repo", F.col("file").alias(c), F.col("cluster").alias(f"c_{c}"))
    both = edges.join(of("src"), ["repo", "src"]).join(of("dst"), ["repo", "dst"])
    ends = both.select("repo", F.col("c_src").alias("cluster"), (F.col("c_src") == F.col("c_dst")).alias("same")).union(both.filter("c_src <> c_dst").select("repo", "c_dst", F.lit(False)))
    weight = ends.groupBy("repo", "cluster").agg(F.sum(F.when(~F.col("same"), 1).otherwise(0)).alias("outer"), F.count("*").alias("all"))
    rings = cyclic.join(clusters, ["repo", "file"]).groupBy("repo", "cluster").agg(F.count_distinct("component").alias("cycles"))
    out = own.join(weight, ["repo", "cluster"], "left").join(rings, ["repo", "cluster"], "left").fillna(0, ["outer", "all", "cycles"])
    coupling = F.when(F.col("all") == 0, 0.0).otherwise(F.col("outer") / F.when(F.col("all") > 0, F.col("all")))
    score = SIZE * clamp(F.col("size") / FULL_SIZE) + COUPLING * coupling + CYCLES * clamp(F.col("cycles") / FULL_CYCLES) + DENSITY * clamp(F.col("symbols") / F.col("size") / FULL_DENSITY)
    return out.select("repo", "cluster", "size", "cycles", F.round(score, 6).alias("score"))


def routing(scored: DataFrame) -> DataFrame:
    """158, 140: the most complex communities of each repository, the first hard ones with three candidates."""
    by = Window.partitionBy("repo").orderBy(F.desc("score"), "cluster")
    kept = scored.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= MOST_COMMUNITIES)
    hard = (F.col("score") >= HARD).cast("int")
    used = F.sum(hard).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return kept.withColumn("candidates", F.when((hard == 1) & (used <= MOST_HARD), 3).otherwise(1)).select("repo", "cluster", "place", "candidates")


def consolidate(findings: DataFrame) -> DataFrame:
    """164, 130, 66: findings (cluster, specialist, importance, headline) merged by their headline's words; the most
    important points of each cluster, with who agrees."""
    key = findings.withColumn("key", T.headline_key(F.col("headline")))
    points = key.groupBy("cluster", "key").agg(F.max("importance").alias("importance"), F.array_join(F.array_sort(F.collect_set("specialist")), ",").alias("agreed"), F.count("*").alias("merged"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("importance"), "key"))
    return points.withColumn("place", rank).filter(F.col("place") <= MOST_POINTS)


def kb_search(entries: DataFrame, questions: DataFrame, k: int = 3) -> DataFrame:
    """128: entries (id, kind, text, weight) by the share of a question's tokens they hold, at most the k best."""
    q = questions.select("query_id", F.array_distinct(T.tokenize_code(F.col("text"))).alias("q")).withColumn("n", F.size("q"))
    terms = q.select("query_id", "n", F.explode("q").alias("token"))
    held = entries.select("id", "kind", "weight", F.explode(F.array_distinct(T.tokenize_code(F.col("text")))).alias("token")).join(terms.select("token").distinct(), "token", "left_semi")
    scored = held.join(terms, "token").groupBy("query_id", "id", "kind").agg(F.round(F.count("*") / F.first("n") * F.first("weight"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "kind", "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def curate_tools(questions: DataFrame, tools: list[tuple[str, list[str], int, int]], most: int = 4, empties: int = 2) -> DataFrame:
    """153: tools (tool, triggers, empty answers, calls) for each question: those exhausted go, then those that nothing
    asks for; triggers found, then use, then special ones decide. Tools are a program's own, so they are literals."""
    low = F.lower("text")
    each = []
    for tool, triggers, empty, calls in tools:
        if empty < empties:
            n = sum((F.contains(low, F.lit(t)).cast("int") for t in triggers), F.lit(0))
            each.append(F.struct(F.lit(tool).alias("tool"), n.alias("n"), F.lit(not triggers).alias("general"), F.lit(calls > 0).alias("used")))
    scored = questions.select("query_id", F.explode(F.array(*each)).alias("x")).select("query_id", "x.*").filter("general or n > 0 or used")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), F.desc("used"), "general", "tool"))
    return scored.withColumn("place", rank).filter(F.col("place") <= most).select("query_id", "tool", "place")


def best_of(candidates: DataFrame, by: list[str], scorer: Column | None = None) -> DataFrame:
    """161, 213: the candidate with the best score, by default .5 grounding, .3 coverage and .2 substance; the first on a tie."""
    score = F.round(0.5 * F.col("grounding") + 0.3 * F.col("coverage") + 0.2 * F.col("substance"), 6) if scorer is None else scorer
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "candidate"))
    return candidates.withColumn("score", score).withColumn("k", rank).filter("k = 1").drop("k")


def ground(cited: DataFrame, retrieved: DataFrame) -> DataFrame:
    """127, 156, 74: citations (query_id, id) kept where they were retrieved, dropped elsewhere; no citation refuses."""
    known = retrieved.select("query_id", "id").distinct().withColumn("known", F.lit(True))
    out = cited.distinct().join(known, ["query_id", "id"], "left").groupBy("query_id").agg(F.count("known").alias("kept"), (F.count("*") - F.count("known")).alias("dropped"))
    return out.withColumn("answered", F.col("kept") > 0)


def ground_answers(cited: DataFrame, retrieved: DataFrame, most: int = 50) -> DataFrame:
    """127: what each answer's citations (query_id, id) come to among the chunks retrieved for it (query_id, id, file, start, end).

    Returns query_id, citations (file, start, end; each place once, in order), dropped (ids that weren't retrieved, each once, at most `most`
    of them by name), n_dropped, answered. An answer without a citation that holds is refused."""
    one = cited.select("query_id", "id").distinct()
    chunks = retrieved.groupBy("query_id", "id").agg(F.min(F.struct("file", "start", "end")).alias("at"))
    met = one.join(chunks, ["query_id", "id"], "left")
    place = F.row_number().over(Window.partitionBy("query_id", F.col("at").isNull()).orderBy("id"))
    met = met.withColumn("__k", place)
    out = met.groupBy("query_id").agg(
        F.array_sort(F.collect_set("at")).alias("citations"), F.array_sort(F.collect_list(F.when(F.col("at").isNull() & (F.col("__k") <= most), F.col("id")))).alias("dropped"),
        F.sum(F.col("at").isNull().cast("long")).alias("n_dropped"),
    )
    return out.withColumn("answered", F.size("citations") > 0)


def answer_scores(grounded: DataFrame, expected: DataFrame) -> DataFrame:
    """175: validity of citations, and whether an answer or a refusal is justified."""
    has = expected.select("query_id").distinct().withColumn("has", F.lit(True))
    out = grounded.join(has, "query_id", "left")
    validity = F.when(F.col("kept") + F.col("dropped") == 0, 1.0).otherwise(F.col("kept") / (F.col("kept") + F.col("dropped")))
    return out.select("query_id", F.round(validity, 6).alias("validity"), (F.col("answered") == F.col("has").isNotNull()).alias("justified"))


def meter(parts: DataFrame, group: str) -> DataFrame:
    """154, 49: tokens by pillar, and the pillar with the largest share."""
    n = parts.groupBy(group, "pillar").agg(F.sum(T.estimate_tokens(F.col("text"))).alias("tokens"))
    all_ = n.groupBy(group).agg(F.sum("tokens").alias("total"), F.max_by("pillar", F.struct("tokens", "pillar")).alias("dominant"), F.max("tokens").alias("most"))
    return all_.select(group, "total", "dominant", F.round(F.when(F.col("total") == 0, 0.0).otherwise(F.col("most") / F.col("total")), 6).alias("share"))


def common_prefix(paths: DataFrame, group: str) -> DataFrame:
    """147: the longest folder that all paths of a group lie in: that of the least and the greatest of them."""
    ends = paths.groupBy(group).agg(F.split(F.min("path"), "/").alias("a"), F.split(F.max("path"), "/").alias("b"))
    same = F.filter(F.sequence(F.lit(1), F.least(F.size("a"), F.size("b"))), lambda i: F.slice("a", 1, i) == F.slice("b", 1, i))
    return ends.select(group, F.array_join(F.slice("a", 1, F.least(F.size(same), F.size("a") - 1)), "/").alias("prefix"))


def reading_order(entries: DataFrame, key_files: DataFrame, impact: DataFrame) -> DataFrame:
    """166: entry points first, then key files, then impact; a file stands where it comes first."""
    parts = [df.select("repo", "file", F.lit(k).alias("rank")) for k, df in enumerate((entries, key_files, impact))]
    first = reduce(DataFrame.union, parts).groupBy("repo", "file").agg(F.min("rank").alias("rank"))
    return first.withColumn("position", F.row_number().over(Window.partitionBy("repo").orderBy("rank", "file")))


def tier(task: Column, tokens: Column) -> Column:
    """169: small models for short or mechanical work."""
    return F.when(task.isin("classify", "extract") & (tokens < 4000), "small").when(tokens < 30000, "medium").otherwise("large")
