
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve_endpoints(refs: DataFrame, known: DataFrame, on: str, name: str, fallback: Column) -> DataFrame:
    """70: refs with target, the name that known (on, name) has for them, or the fallback where it has none (unresolved)."""
    out = refs.join(known.select(on, F.col(name).alias("__name")), on, "left")
    return out.withColumns({"target": F.coalesce("__name", fallback), "unresolved": F.col("__name").isNull()}).drop("__name")


def lookup(rows: DataFrame, facts: DataFrame, on: list[str], defaults: dict[str, int]) -> DataFrame:
    """71: rows with the facts known of them, and defaults for the others."""
    return rows.join(facts, on, "left").fillna(defaults)


def having(rows: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
    """74: rows that others match."""
    return rows.join(others.select(*on), on, "left_semi")


def lacking(rows: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
    """75, 126: rows that nothing in others matches, such as the keys that a cache doesn't have."""
    return rows.join(others.select(*on), on, "left_anti")


def bind(uses: DataFrame, bindings: DataFrame, on: list[str], target: str) -> DataFrame:
    """77: uses with the target bound to their name where they stand; of several bindings the least."""
    return uses.join(bindings.groupBy(*on).agg(F.min(target).alias("target")), on)


def containing(spans: DataFrame, group: str, start: str, end: str, ident: str) -> DataFrame:
    """78: pairs (group, inner, outer) of spans of a group of which one lies in the other and isn't equal to it."""
    a, b = spans.alias("a"), spans.alias("b")
    within = (F.col(f"b.{start}") <= F.col(f"a.{start}")) & (F.col(f"b.{end}") >= F.col(f"a.{end}"))
    equal = (F.col(f"b.{start}") == F.col(f"a.{start}")) & (F.col(f"b.{end}") == F.col(f"a.{end}"))
    both = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & within & ~equal)
    return both.select(F.col(f"a.{group}").alias(group), F.col(f"a.{ident}").alias("inner"), F.col(f"b.{ident}").alias("outer"))


def overlapping(left: DataFrame, right: DataFrame, group: str, start: str, end: str, ident: str) -> DataFrame:
    """79: pairs (group, left, right) of spans of a group that have a place in common; ends count."""
    a, b = left.alias("a"), right.alias("b")
    both = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col(f"a.{start}") <= F.col(f"b.{end}")) & (F.col(f"b.{start}") <= F.col(f"a.{end}")))
    return both.select(F.col(f"a.{group}").alias(group), F.col(f"a.{ident}").alias("left"), F.col(f"b.{ident}").alias("right"))


def children(spans: DataFrame) -> DataFrame:
    """76: spans (span_id, parent_id) with the number of spans directly below each."""
    n = spans.filter("parent_id is not null").groupBy(F.col("parent_id").alias("span_id")).agg(F.count("*").alias("children"))
    return lookup(spans, n, ["span_id"], {"children": 0})


def totals(rows: DataFrame, by: list[str], sums: dict[str, Column], places: int = 2) -> DataFrame:
    """129: rows and rounded sums of each group."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.round(F.sum(c), places).alias(n) for n, c in sums.items()])


def judged(rows: DataFrame, by: str, measured: Column, failed: Column, partial: Column) -> DataFrame:
    """131: whether all rows of a group are measured, whether any failed, and what follows for its status."""
    status = F.when(F.bool_or(failed), "failed").when(F.bool_or(partial), "partial").otherwise("completed")
    return rows.groupBy(by).agg(F.bool_and(measured).alias("measured"), F.bool_or(failed).alias("failed"), status.alias("status"))


def distinct_sorted(rows: DataFrame, by: str, value: str) -> DataFrame:
    """136: the distinct values of each group, in order, as text."""
    return rows.groupBy(by).agg(F.array_join(F.array_sort(F.collect_set(value)).cast("array<string>"), ",").alias("values"))


def covered(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """138: the greatest value before each row, null for the first."""
    before = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("covered", F.max(value).over(before))


def until_next(rows: DataFrame, by: str, start: str) -> DataFrame:
    """139: where each row ends: one before the next one's start, null for the last."""
    return rows.withColumn("until", F.lead(start).over(Window.partitionBy(by).orderBy(start)) - 1)


def round_robin(rows: DataFrame, by: str, group: str, order: list, most: int) -> DataFrame:
    """141: the first row of each group, then the second ones, until there are `most`; groups in order."""
    depth = F.row_number().over(Window.partitionBy(by, group).orderBy(*order))
    place = F.row_number().over(Window.partitionBy(by).orderBy("__depth", group))
    return rows.withColumn("__depth", depth).withColumn("place", place).filter(F.col("place") <= most).drop("__depth")


def quota(rows: DataFrame, by: str, negative: str, order: list, positives: int = 5, negatives: int = 1) -> DataFrame:
    """143: so many positive and negative rows of each kind."""
    k = F.row_number().over(Window.partitionBy(by, negative).orderBy(*order))
    return rows.withColumn("__k", k).filter(F.col("__k") <= F.when(F.col(negative), negatives).otherwise(positives)).drop("__k")


def shown(items: Column, most: int) -> Column:
    """144: the first of an array of texts, and how many more there are."""
    more = F.when(F.size(items) > most, F.concat(F.lit(" (+"), (F.size(items) - most).cast("string"), F.lit(" more)"))).otherwise("")
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), more)


def numbered(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """194: a log's rows with their number in it, from 1."""
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long"))


def latest(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """200: the value of each group's last row and where that stands."""
    return rows.groupBy(by).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def normalised(rows: DataFrame, by: str, value: str, places: int = 6) -> DataFrame:
    """55: score, the value between the least (0) and the greatest (1) of its group; 1 where these are equal."""
    w = Window.partitionBy(by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return rows.withColumn("score", F.when(low == high, 1.0).otherwise(F.round((F.col(value) - low) / (high - low), places)))


def best_row(rows: DataFrame, by: str, value: str, ident: str, listed: str) -> DataFrame:
    """130: of each group the greatest value, the row that has it (the greatest ident on a tie), and the distinct `listed` together."""
    return rows.groupBy(by).agg(F.max(value).alias("importance"), F.max_by(ident, F.struct(value, ident)).alias("best"), F.array_join(F.array_sort(F.collect_set(listed)), "").alias("all"))


def within_budget(rows: DataFrame, by: str, order: list, costs: Column, most: int) -> DataFrame:
    """140: the rows that cost something while no more than `most` of their group did so far; used counts them."""
    used = F.sum(costs.cast("int")).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", used).filter(costs & (F.col("used") <= most))


def set_sizes(rows: DataFrame, by: str, value: str, first: Column) -> DataFrame:
    """145: of each group's two sets, values of rows that are `first` and of the others: how many are in both, in either, and in the first only."""
    of = lambda c: F.collect_set(F.when(c, F.col(value)))
    s = rows.groupBy(by).agg(of(first).alias("a"), of(~first).alias("b"))
    n = lambda c, name: F.size(c).cast("long").alias(name)
    return s.select(by, n(F.array_intersect("a", "b"), "both"), n(F.array_union("a", "b"), "either"), n(F.array_except("a", "b"), "only_a"))


def keep_first(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """146: of the rows of each key the first by an order; by a descending one, the latest."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__k = 1").drop("__k")


def mode(rows: DataFrame, by: str, value: str) -> DataFrame:
    """148: the most frequent value of each group, the least on a tie, and how often it is there. Counted before it is ranked."""
    c = rows.groupBy(by, value).agg(F.count("*").alias("n"))
    return c.groupBy(by).agg(F.min_by(value, F.struct(-F.col("n"), value)).alias("dominant"), F.max("n").alias("n"))


def ring(rows: DataFrame, by: str, order: list, ident: str, most: int = 5) -> DataFrame:
    """219: a group's last `most` rows, the latest first, how many there were, and how many of them were dropped."""
    k = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    kept = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("__k") <= most, F.struct("__k", ident)))), lambda x: x[ident].cast("string")), ",")
    return rows.withColumn("__k", k).groupBy(by).agg(F.count("*").alias("exported"), F.greatest(F.count("*") - most, F.lit(0)).alias("dropped"), kept.alias("kept"))


def sides(edges: DataFrame, cluster: Column, other: Column) -> DataFrame:
    """83: how many edges lie inside a cluster, come in from one before it or go out to one after it."""
    side = F.when(other == cluster, "internal").when(other < cluster, "inbound").otherwise("outbound")
    return edges.groupBy(cluster.alias("cluster"), side.alias("side")).agg(F.count("*").alias("n"))


def cached(rows: DataFrame, key: str, cache: DataFrame) -> DataFrame:
    """126: rows that a cache has and lacks, and their distinct keys; what it lacks is `lacking`."""
    hit = cache.select(key).distinct().withColumn("__hit", F.lit(True))
    return rows.join(hit, key, "left").groupBy(F.col("__hit").isNotNull().alias("cached")).agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys"))


def seen(cited: DataFrame, evidence: DataFrame, on: list[str]) -> DataFrame:
    """156: what is cited, and whether the evidence has it."""
    return cited.join(evidence.select(*on).distinct().withColumn("seen", F.lit(True)), on, "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
