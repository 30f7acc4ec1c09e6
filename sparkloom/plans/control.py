
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: Stages of an analysis; what each reads.
STAGES = {"ingest": [], "orient": ["ingest"], "map": ["ingest"], "inventory": ["map"], "connect": ["inventory"], "analyze": ["connect"], "synthesize": ["analyze", "orient"], "rag": ["inventory"]}
AI_STAGES = ["synthesize", "rag"]


def cache_action(produced: Column, same_space: Column) -> Column:
    """214: what stages a cached result covers; its vectors count in the same embedding space only."""
    covers = lambda s: F.array_contains(produced, s)
    fixed = [covers(s) for s in STAGES if s not in AI_STAGES]
    every = fixed[0]
    for c in fixed[1:]:
        every = every & c
    return F.when(produced.isNull() | ~every, "miss").when(covers("synthesize") & covers("rag") & same_space, "full-hit").otherwise("ai-retry")


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """215: the layer of each node (group, node) in its group's graph of edges (group, before, node): all that it
    needs stands in lower layers. Nodes in cycles, and what follows them, get none."""
    rest, done, depth = nodes.select("group", "node"), None, 0
    while True:
        blocked = edges.join(rest.select("group", F.col("node").alias("before")), ["group", "before"], "left_semi").select("group", "node")
        free = cut(rest.join(blocked, ["group", "node"], "left_anti"))
        if free.isEmpty():
            break
        rest = cut(rest.join(free, ["group", "node"], "left_anti"))
        now = free.withColumn("layer", F.lit(depth))
        done, depth = now if done is None else done.union(now), depth + 1
    return done if done is not None else nodes.select("group", "node", F.lit(0).alias("layer")).limit(0)


def run_status(stages: DataFrame, run: str, status: str) -> DataFrame:
    """216: failed, aborted, partial or completed, the worst first."""
    any_ = lambda s: F.bool_or(F.col(status) == s)
    return stages.groupBy(run).agg(F.when(any_("failed"), "failed").when(any_("aborted"), "aborted").when(any_("skipped"), "partial").otherwise("completed").alias("status"))


def speculation(log: DataFrame, key: str) -> DataFrame:
    """218: launches that were used, thrown away or failed, and the share used."""
    n = lambda s: F.sum((F.col("outcome") == s).cast("long")).alias(s)
    out = log.groupBy(key).agg(F.count("*").alias("launched"), n("hit"), n("discarded"), n("failed"))
    return out.withColumn("rate", F.round(F.col("hit") / F.col("launched"), 6))


def index_violations(vectors: DataFrame, dim: int) -> DataFrame:
    """220: rows of an index that break its rules, by rule."""
    twice = vectors.groupBy("id").count().filter("count > 1").select("id", F.lit("duplicate-id").alias("rule"))
    size = vectors.filter(F.size("v") != dim).select("id", F.lit("dimension"))
    finite = vectors.filter(F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).select("id", F.lit("not-finite"))
    return twice.union(size).union(finite)


def repo_reference(url: Column) -> list[Column]:
    """223: owner and name of a repository's address, null where it isn't one."""
    p = r"^(?:https?://)?[^/@\s]+\.[^/@\s]+/([A-Za-z0-9._-]+)/([A-Za-z0-9._-]+?)(?:\.git)?/?(?:[?#].*)?$"
    part = lambda k: F.when(url.rlike(p), F.regexp_extract(url, p, k))
    return [part(1).alias("owner"), part(2).alias("name")]


def sha_ok(sha: Column) -> Column:
    """223."""
    return F.coalesce(F.lower(sha).rlike("^[0-9a-f]{7,40}$"), F.lit(False))


def with_notice(notices: Column, reason: Column, text: Column) -> Column:
    """225: adds a notice unless one of its reason is there."""
    return F.when(F.exists(notices, lambda n: n["reason"] == reason), notices).otherwise(F.array_append(notices, F.struct(reason.alias("reason"), text.alias("text"))))
