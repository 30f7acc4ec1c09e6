"""Resharding by minimum-cost flow."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, blank, hidden, shown

SHARDS, OLD_SHARDS = 8, 6
#: Blocks of an old shard: so many size classes to a doubling, of at most DOUBLINGS.
CLASSES, DOUBLINGS = 8, 40
#: A class with more rows or bytes is cut into parts; all blocks together are about so many at most, the parts of a very
#: large table being larger.
PART_ROWS, PART_BYTES, MOST_BLOCKS = 1_000_000, 512 << 20, 100_000
_KEY = ["__old", "__class", "__part"]
_BLOCK = "__old int, __class int, __part int"


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> list[list[int]]:
    """Bytes from each source to each sink, all supply placed, at the least sum of bytes * cost(i, j).

    Successive shortest paths in the residual network by Bellman-Ford; the network has one node for each
    shard, however much they hold."""
    n, m = len(supply), len(capacity)
    flow = [[0] * m for _ in range(n)]
    left, free = list(supply), list(capacity)
    if sum(left) > sum(free):
        raise ValueError("the new shards can't hold all")
    while any(left):
        dist: list[float] = [0 if left[i] else float("inf") for i in range(n)] + [float("inf")] * m
        back: list[int | None] = [None] * (n + m)
        for _ in range(n + m):
            changed = False
            for i in range(n):
                for j in range(m):
                    if dist[i] + cost(i, j) < dist[n + j]:
                        dist[n + j], back[n + j], changed = dist[i] + cost(i, j), i, True
                    if flow[i][j] and dist[n + j] - cost(i, j) < dist[i]:
                        dist[i], back[i], changed = dist[n + j] - cost(i, j), n + j, True
            if not changed:
                break
        end = min((j for j in range(m) if free[j]), key=lambda j: (dist[n + j], j))
        path, at = [], n + end
        while back[at] is not None:
            path.append((back[at], at))
            at = back[at]
        push = min([left[at], free[end], *(flow[v][u - n] for u, v in path if u >= n)])
        for u, v in path:
            if u < n:
                flow[u][v - n] += push
            else:
                flow[v][u - n] -= push
        left[at] -= push
        free[end] -= push
    return flow


def even(total: int, n: int) -> list[int]:
    return [total // n + (i < total % n) for i in range(n)]


@dataclass
class Plan:
    """Where rows go, by blocks: (old shard, class, part)."""

    shards: int
    old: Column
    parts: list[tuple]  # (old shard, class, parts)
    offsets: list[tuple]  # (block, its first byte in the old shard)
    cuts: list[tuple]  # (old shard, new shard, first byte), for each old shard in order
    slots: list[tuple]  # (new shard, block, what a row's number in its block lacks to its slot)
    held: dict[int, int]  # rows by new shard
    changed: list[int]  # shards that gain or lose rows


def _measured(docs: DataFrame, old: Column) -> DataFrame:
    text = blank("text")
    own = docs.withColumns({"__size": (F.octet_length(text) + 1).cast("long"), "__crc": F.crc32(text.cast("binary")), "__old": old.cast("int")})
    return own.withColumns({"__class": (CLASSES * DOUBLINGS - F.floor(F.log2("__size") * CLASSES)).cast("int"), "__order": F.xxhash64("doc_id", "__crc")})


def _blocked(own: DataFrame, parts: list[tuple]) -> DataFrame:
    # one row for each class of each old shard
    parts = own.sparkSession.createDataFrame(parts, "__old int, __class int, __parts int")
    return own.join(F.broadcast(parts), ["__old", "__class"]).withColumn("__part", F.pmod("__order", "__parts").cast("int")).drop("__parts")


def _placed(own: DataFrame, offsets: list[tuple], cuts: list[tuple]) -> DataFrame:
    """Rows of these blocks with __rank in the block and the new shard."""
    # one row for each block, of which there are MOST_BLOCKS or so
    at = own.sparkSession.createDataFrame(offsets, f"{_BLOCK}, __offset long")
    block = "partition by __old, __class, __part order by __size desc, __order, doc_id, __crc rows unbounded preceding"
    own = own.join(F.broadcast(at), _KEY).withColumns({"__start": F.expr(f"sum(__size) over ({block}) - __size"), "__rank": F.expr(f"row_number() over ({block})")})
    middle = F.col("__offset") + F.col("__start") + F.floor(F.col("__size") / 2)
    target = F.lit(None).cast("int")
    for i, j, first in cuts:
        target = F.when((F.col("__old") == i) & (middle >= first), j).otherwise(target)
    return own.withColumn("__shard", target).drop("__offset", "__start")


def solve(docs: DataFrame, shards: int = SHARDS, old_shards: int = OLD_SHARDS, old_shard: Column | None = None) -> Plan:
    """The plan that makes old shards into `shards` shards of near equal bytes and moves the fewest bytes.

    Rows of an old shard are ordered by size class, the largest first, so that cuts fall among its smallest rows; a
    class of many rows or bytes is cut by a hash into parts, in number with its rows, so that a block is a task's
    load. Only sums of blocks go to the driver, which solves the flow. An old shard keeps what its capacity allows and
    cuts the rest into runs of bytes, one for each receiver; a row belongs to the run in which its middle byte lies,
    so a cut is off by half a row at most. Only blocks with a cut are looked at row by row here.

    old_shard: a column with the present shard, by default a hash of doc_id (the layout that doc_id and the old
    number of shards decide)."""
    old = F.pmod(F.xxhash64("doc_id"), F.lit(old_shards)) if old_shard is None else old_shard
    own = _measured(docs, old).select("doc_id", "__size", "__crc", "__old", "__class", "__order")
    sums = [F.sum("__size").alias("size"), F.count("*").alias("n")]
    classes = [tuple(r) for r in own.groupBy("__old", "__class").agg(*sums).collect()]  # CLASSES * DOUBLINGS a shard at most
    least_rows, least_bytes = (max(least, sum(r[k] for r in classes) // MOST_BLOCKS) for least, k in ((PART_ROWS, 3), (PART_BYTES, 2)))
    parts = [(i, c, max(1, -(-n // least_rows), -(-size // least_bytes))) for i, c, size, n in classes]
    if all(p == 1 for *_, p in parts):
        blocks = sorted((i, c, 0, size, n) for i, c, size, n in classes)
    else:
        blocks = sorted(tuple(r) for r in _blocked(own, parts).groupBy(*_KEY).agg(*sums).collect())  # MOST_BLOCKS or so
    supply, offsets = [0] * old_shards, []
    for i, c, p, size, _ in blocks:
        offsets.append((i, c, p, supply[i]))
        supply[i] += size
    flow = min_cost_flow(supply, even(sum(supply), shards), lambda i, j: int(i != j))
    cuts, runs, split = [], [], []
    for i in range(old_shards):
        at = 0
        for j in sorted(range(shards), key=lambda j: j != i):  # what stays comes first
            if flow[i][j]:
                cuts.append((i, j, at))
                at += flow[i][j]
    for (i, c, p, size, n), (*_, first) in zip(blocks, offsets, strict=True):
        mine = [(at, j) for k, j, at in cuts if k == i and at <= first + size]
        if any(at > first for at, _ in mine):
            split.append((i, c, p, first))
        else:
            runs.append((mine[-1][1], i, c, p, n, 1))
    if split:  # a block for each cut at most
        rows = _placed(_blocked(own, parts), split, cuts)
        runs += [tuple(r) for r in rows.groupBy("__shard", *_KEY).agg(F.count("*").alias("n"), F.min("__rank").alias("first")).collect()]
    before, slots = dict.fromkeys(range(shards), 0), []
    for j, i, c, p, n, first in sorted(runs):
        slots.append((j, i, c, p, before[j] - first))
        before[j] += n
    changed = sorted({s for j, i, *_ in runs if i != j for s in (i, j)})
    return Plan(shards, old, parts, offsets, cuts, slots, {j: n for j, n in before.items() if n}, changed)


def _with_slots(docs: DataFrame, plan: Plan) -> DataFrame:
    """docs with __size, __crc, __old, __shard and __slot; one shuffle, by block."""
    rows = _placed(_blocked(_measured(docs, plan.old), plan.parts), plan.offsets, plan.cuts)
    # two rows for each block at most, and one more for each cut
    base = docs.sparkSession.createDataFrame(plan.slots, f"__shard int, {_BLOCK}, __base long")
    return rows.join(F.broadcast(base), ["__shard", *_KEY]).withColumn("__slot", F.col("__base") + F.col("__rank")).drop("__base", "__rank", "__class", "__part", "__order")


def reshard(docs: DataFrame, shards: int = SHARDS, old_shards: int = OLD_SHARDS, old_shard: Column | None = None, plan: Plan | None = None) -> DataFrame:
    """Where each row goes by the plan, that of solve where none is given.

    Returns doc_id, size, text_crc32, old_shard, shard, slot (gapless from 0 in a shard). A null text has size 1 and the
    checksum of nothing; a very long text is one row and moves whole; null and repeated doc_ids are rows as any other,
    but rows equal in doc_id and text stay in one block; an empty table gives an empty table.
    """
    plan = plan or solve(docs, shards, old_shards, old_shard)
    rows = _with_slots(docs.select(*{"doc_id", "text", *(docs.columns if old_shard is not None else ())}), plan)
    return rows.select("doc_id", F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.col("__old").alias("old_shard"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))


def rewrite(docs: DataFrame, plan: Plan, path: str) -> list[int]:
    """Writes anew the files of the shards whose rows change, one folder shard=N each, with slot, and in its order within
    a file; returns those shards.

    docs: the rows that the plan was solved for, maybe read from path itself: the new files stand complete before the
    old ones of these shards go. A shard that neither gains nor loses rows is left as it is, in path too; the folder of
    one that loses all its rows goes. Each row is written once, repeated or not, with or without doc_id."""
    docs = hidden(docs)
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = _with_slots(docs, plan).filter(F.col("__shard").isin(plan.changed))
    out = rows.select(*names, F.col("__slot").alias("slot"), F.col("__shard").alias("shard"))
    shown(out).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("shard").parquet(path)
    for shard in set(plan.changed) - set(plan.held):
        gone = docs.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={shard}")
        gone.getFileSystem(docs.sparkSession._jsc.hadoopConfiguration()).delete(gone, True)
    return plan.changed


def op7_resharding(spark, sf_dir: str) -> DataFrame:
    """Sizes, checksums and slots are those of the files written anew; only shards that stay as they are come from the plan."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    plan, path = solve(docs), f"{Scratch(spark, 'reshard').base}/layout"
    stay = reshard(docs, plan=plan).filter(~F.col("shard").isin(plan.changed))
    if plan.changed:
        rewrite(docs, plan, path)
        new = spark.read.schema("doc_id long, text string, slot long, shard int").parquet(path)
        new = new.select("doc_id", (F.octet_length(blank("text")) + 1).cast("long").alias("size"), F.crc32(blank("text").cast("binary")).alias("text_crc32"), plan.old.cast("int").alias("old_shard"), "shard", "slot")
        stay = new.unionByName(stay) if set(plan.held) - set(plan.changed) else new
    return stay.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard"), "old_shard")
