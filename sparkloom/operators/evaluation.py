
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def score_questions(questions: DataFrame, targets: DataFrame, hits: DataFrame) -> DataFrame:
    """173: recall and reciprocal rank of hits (query_id, id, rank) against targets (query_id, id).

    A question without targets is a negative control with recall 0."""
    met = targets.join(hits.select("query_id", "id", "rank"), ["query_id", "id"], "left")
    per = met.groupBy("query_id").agg(F.count("*").alias("expected"), F.count("rank").alias("found"), F.min("rank").alias("first"))
    out = questions.select("query_id").join(per, "query_id", "left").fillna(0, ["expected", "found"])
    return out.select(
        "query_id", "expected", "found",
        F.round(F.when(F.col("expected") == 0, 0.0).otherwise(F.col("found") / F.when(F.col("expected") > 0, F.col("expected"))), 6).alias("recall"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"), (F.col("found") > 0).alias("hit"), (F.col("expected") == 0).alias("negative"),
    )


def aggregate_rag(scored: DataFrame) -> DataFrame:
    """174, 134: means that leave out negative controls."""
    real = lambda c: F.round(F.coalesce(F.avg(F.when(~F.col("negative"), c)), F.lit(0.0)), 6)
    recall = F.col("found") / F.when(F.col("expected") > 0, F.col("expected"))
    return scored.agg(F.count("*").alias("questions"), F.sum(F.col("negative").cast("long")).alias("negatives"), real(recall).alias("recall"), real(F.col("reciprocal_rank")).alias("mrr"))


def precision_recall(expected: Column, found: Column) -> list[Column]:
    """177: on sets; nothing expected gives recall 1, nothing found precision 1 only if nothing was expected."""
    both = F.size(F.array_intersect(expected, found))
    p = F.when(F.size(found) == 0, F.when(F.size(expected) == 0, 1.0).otherwise(0.0)).otherwise(both / F.size(found))
    r = F.when(F.size(expected) == 0, 1.0).otherwise(both / F.size(expected))
    f1 = F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1")]


def micro_average(sets: DataFrame) -> DataFrame:
    """135: counts are summed before ratios are taken."""
    n = sets.agg(F.sum(F.size(F.array_intersect("expected", "found"))).alias("b"), F.sum(F.size("expected")).alias("e"), F.sum(F.size("found")).alias("f"))
    return n.select(F.round(F.col("b") / F.col("f"), 6).alias("precision"), F.round(F.col("b") / F.col("e"), 6).alias("recall"), F.round(2 * F.col("b") / (F.col("f") + F.col("e")), 6).alias("f1"))


def verify_sets(sets: DataFrame) -> DataFrame:
    """181: exact match, and what is made up or missed."""
    made, missed = F.size(F.array_except("found", "expected")), F.size(F.array_except("expected", "found"))
    return sets.select("id", ((made == 0) & (missed == 0)).alias("exact"), made.alias("fabricated"), missed.alias("missed"))


def kappa(labels: DataFrame, a: str, b: str) -> DataFrame:
    """179: Cohen's kappa of two binary raters, its interval, and whether it may gate."""
    x = labels.agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("int")).alias("agree"), F.avg(a).alias("q"), F.avg(b).alias("t"))
    x = x.withColumn("chance", F.col("q") * F.col("t") + (1 - F.col("q")) * (1 - F.col("t")))
    x = x.withColumn("kappa", (F.col("agree") - F.col("chance")) / (1 - F.col("chance"))).withColumn("se", F.sqrt(F.col("agree") * (1 - F.col("agree")) / F.col("n")) / (1 - F.col("chance")))
    r = lambda c, name: F.round(c, 6).alias(name)
    return x.select("n", r(F.col("agree"), "agreement"), r(F.col("kappa"), "kappa"), r(F.col("kappa") - 1.96 * F.col("se"), "low"), r(F.col("kappa") + 1.96 * F.col("se"), "high"), ((F.col("n") >= 20) & (F.col("kappa") >= 0.6)).alias("gateable"))


def rewards(results: DataFrame) -> DataFrame:
    """183: the mean of rewards held to 0..1; a task passes if all its verifiers do."""
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("reward")))
    return results.groupBy("task").agg(F.round(F.avg(held), 6).alias("score"), F.bool_and("pass").alias("passed"))


def thresholds(aggregate: DataFrame, gates: list[tuple[str, str, str, float]]) -> DataFrame:
    """176: a row for each gate (name, column, comparison, limit)."""
    out = []
    for name, column, how, limit in gates:
        ok = F.col(column) >= limit if how == ">=" else F.col(column) <= limit
        out.append(F.struct(F.lit(name).alias("gate"), F.round(F.col(column).cast("double"), 6).alias("value"), ok.alias("ok")))
    return aggregate.select(F.explode(F.array(*out)).alias("x")).select("x.*")


def hard_negatives(hits: DataFrame, targets: DataFrame, most: int = 3) -> DataFrame:
    """185: the best hits that aren't targets."""
    wrong = hits.join(targets, ["query_id", "id"], "left_anti")
    wrong = wrong.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("k") <= most)
    return wrong.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"].cast("string")), ",").alias("negatives"))


def compare_arms(targets: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """187: recall of two arms and on how many questions the second won or lost."""
    met = targets.join(a.select("query_id", "id", F.lit(1).alias("a")), ["query_id", "id"], "left").join(b.select("query_id", "id", F.lit(1).alias("b")), ["query_id", "id"], "left")
    per = met.groupBy("query_id").agg(F.count("*").alias("n"), F.count("a").alias("a"), F.count("b").alias("b"))
    flag = lambda c: F.sum(c.cast("long"))
    return per.agg(F.count("*").alias("questions"), F.round(F.avg(F.col("a") / F.col("n")), 6).alias("recall_a"), F.round(F.avg(F.col("b") / F.col("n")), 6).alias("recall_b"), flag(F.col("b") > F.col("a")).alias("won"), flag(F.col("b") < F.col("a")).alias("lost"))
