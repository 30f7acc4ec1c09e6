
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def costs(usage: DataFrame, pricing: DataFrame, group: str) -> DataFrame:
    """189: usage (group, model, tokens, cached) by pricing (model, price, cached_price): cached tokens aren't billed
    as input. A group with an unpriced model has no total, but names those models."""
    priced = usage.join(pricing, "model", "left")
    usd = (F.col("tokens") - F.col("cached")) * F.col("price") + F.col("cached") * F.col("cached_price")
    out = priced.groupBy(group).agg(F.bool_or(F.col("price").isNull()).alias("open"), F.sum(usd).alias("usd"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("price").isNull(), F.col("model")))), ",").alias("unpriced"))
    return out.select(group, F.when(~F.col("open"), F.round("usd", 4)).alias("usd"), "unpriced")


def interactions(spans: DataFrame) -> DataFrame:
    """190, 76: edges between the kinds of a span (trace, span, parent, kind, ms) and of its parent."""
    up = spans.select("trace", F.col("span").alias("parent"), F.col("kind").alias("caller"))
    return spans.join(up, ["trace", "parent"]).groupBy("caller", F.col("kind").alias("callee")).agg(F.count("*").alias("calls"), F.sum("ms").alias("ms"))


def report(spans: DataFrame) -> DataFrame:
    """191: spans, time and errors by kind."""
    return spans.groupBy("kind").agg(F.count("*").alias("calls"), F.sum("ms").alias("ms"), F.max("ms").alias("slowest"), F.sum(F.col("failed").cast("long")).alias("errors"))


def percentiles(samples: DataFrame, group: str, value: str) -> DataFrame:
    """132, 133: nearest-rank p50 and p95, and the upper median, which differs for even counts."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(value))
    n = F.count("*").over(Window.partitionBy(group))
    rows = samples.withColumn("k", rank).withColumn("n", n)
    at = lambda k, name: F.max(F.when(F.col("k") == k, F.col(value))).alias(name)
    return rows.groupBy(group).agg(at(F.ceil(0.5 * F.col("n")), "p50"), at(F.ceil(0.95 * F.col("n")), "p95"), at(F.floor(F.col("n") / 2) + 1, "upper_median"), F.min(value).alias("best"), F.max(value).alias("worst"))


def last_n(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """193, 198, 202, 204, 219: the n latest rows of each group; order is descending and total."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("__k") <= n).drop("__k")


def aligned_windows(hits: DataFrame, key: str, ts: str, seconds: int, most: int) -> DataFrame:
    """196, by the clock: hits of a key in windows that start at multiples of their length; beyond `most` they are refused."""
    start = (F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000)) * seconds).cast("long")
    return hits.groupBy(key, start.alias("window")).agg(F.count("*").alias("hits"), F.greatest(F.count("*") - most, F.lit(0)).alias("refused"))


def first_hit_windows(hits: DataFrame, key: str, ts: str, seconds: int, most: int) -> DataFrame:
    """196, from the first hit: a window opens at a hit that none holds. A fold over one key's hits, in grouped pandas."""
    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        opened, n, allowed, windows = None, 0, 0, 0
        for t in sorted(pdf["t"].tolist()):
            if opened is None or t - opened >= seconds * 1_000_000:
                opened, n, windows = t, 0, windows + 1
            n += 1
            allowed += n <= most
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "hits": [len(pdf)], "allowed": [allowed], "windows": [windows]})

    rows = hits.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    return rows.groupBy("key").applyInPandas(fold, "key long, hits long, allowed long, windows long").withColumnRenamed("key", key)


def budget(spend: DataFrame, unit: str, ts: str, amount: str, order: str, limit: float) -> DataFrame:
    """197: spending by UTC day and unit; a request is allowed while what was recorded before it is at most the limit."""
    by = Window.partitionBy(F.to_date(ts), unit).orderBy(ts, order).rowsBetween(Window.unboundedPreceding, -1)
    return spend.withColumn("before", F.coalesce(F.sum(amount).over(by), F.lit(0.0))).withColumn("allowed", F.col("before") <= limit)


def progress(events: DataFrame, job: str, order: list[str], stage: str, terminal: Column) -> DataFrame:
    """195: events whose stage is beyond all before them, up to the first terminal one, in batch form."""
    by = Window.partitionBy(job).orderBy(*order)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    fresh = events.withColumn("__high", F.max(stage).over(before)).withColumn("__done", F.max(terminal.cast("int")).over(before))
    return fresh.filter((F.coalesce("__done", F.lit(0)) == 0) & (F.col("__high").isNull() | (F.col(stage) > F.col("__high")))).drop("__high", "__done")


def set_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """145, 201: keys that came, went or stayed."""
    a, b = old.select(keys).distinct().withColumn("__old", F.lit(True)), new.select(keys).distinct().withColumn("__new", F.lit(True))
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").otherwise("kept")
    return a.join(b, keys, "full").withColumn("change", change).drop("__old", "__new")


def fresh(rows: DataFrame, ts: str, now: Column, seconds: int, size: str, most: int) -> DataFrame:
    """203, 222: entries that are neither too old nor too large."""
    return rows.filter((F.unix_seconds(now) - F.unix_seconds(F.col(ts).cast("timestamp")) < seconds) & (F.col(size) <= most))


def sparkline(points: DataFrame, group: str, order: str, value: str, width: int = 100, height: int = 20) -> DataFrame:
    """205: values scaled into a box, the highest on top."""
    w = Window.partitionBy(group)
    low, high, n = F.min(value).over(w), F.max(value).over(w), F.count("*").over(w)
    k = F.row_number().over(w.orderBy(order)) - 1
    x = F.when(n == 1, 0.0).otherwise(k * width / F.when(n > 1, n - 1))
    y = F.when(high == low, height / 2).otherwise(height - (F.col(value) - low) * height / F.when(high != low, high - low))
    return points.select(group, order, F.round(x, 4).alias("x"), (F.round(y, 4) + 0.0).alias("y"))


def span_depths(spans: DataFrame, most: int = 64) -> DataFrame:
    """192: steps from the root of each span's trace, by a join up for each level; cycles end at `most`."""
    from ..plans.lineage import cut

    at = cut(spans.filter("parent is null").select("trace", "span", F.lit(0).alias("depth")))
    out = at
    child = spans.filter("parent is not null").select("trace", F.col("span").alias("child"), F.col("parent").alias("span"))
    for depth in range(1, most):
        at = cut(at.join(child, ["trace", "span"]).select("trace", F.col("child").alias("span"), F.lit(depth).alias("depth")))
        if at.isEmpty():
            break
        out = out.union(at)
    return out
