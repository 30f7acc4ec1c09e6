"""Transactions of a log put together again: what stays, what was undone and by whom, and the store after each epoch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: What a record is; END is the end of a source's log, which no record stands for.
CHANGE, COMMIT, ABORT, SAVEPOINT, ROLLBACK, END = range(6)
#: Commits of an epoch, keys of the store.
EPOCH, KEYS = 16, 3000
#: Records of a block of the range-minimum table; blocks whose own tables are held at once.
BLOCK, AT_ONCE = 64, 1024
HIGH = np.iinfo(np.int64).max

RECORD = "seq long, source string, kind int, key long, value long"


def heights(kind: np.ndarray) -> np.ndarray:
    """The height of each record of a log: that of a change lies above what undoes it and above nothing else.

    In a transaction with s savepoints so far a change is at 2s + 1, a rollback at 2s, and an end is below all."""
    ends = (kind == COMMIT) | (kind == ABORT) | (kind == END)
    saved = np.cumsum(kind == SAVEPOINT)
    before = np.maximum.accumulate(np.where(ends, saved, 0))
    s = saved - np.r_[0, before[:-1]] if len(kind) else saved
    out = np.full(len(kind), HIGH)
    out[kind == CHANGE] = 2 * s[kind == CHANGE] + 1
    out[kind == ROLLBACK] = 2 * s[kind == ROLLBACK]
    out[ends] = -1
    return out


def _levels(rows: np.ndarray) -> list[np.ndarray]:
    """The sparse table along the last axis: level j has the least of 2**j values from each place on; beyond the end, the highest."""
    out = [rows]
    while 2 ** len(out) <= rows.shape[-1]:
        step = 2 ** (len(out) - 1)
        far = np.full_like(rows, HIGH)
        far[..., :-step] = out[-1][..., step:]
        out.append(np.minimum(out[-1], far))
    return out


def first_lower(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place of `at` the first later place with a lower height, len(h) where there is none.

    By binary lifting on range minima: in the rest of the own block, then over the least heights of whole blocks, then in
    the block that has one. The table over blocks takes a few bytes a record; those in blocks are made for some blocks at a time."""
    n = len(h)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, HIGH)
    grid[:n] = h
    grid = grid.reshape(blocks, BLOCK)
    want, out, open_ = h[at], np.full(len(at), n), np.ones(len(at), bool)

    def lift(levels: list[np.ndarray], row: np.ndarray, pos: np.ndarray, limit: np.ndarray, size: int) -> np.ndarray:
        for j in range(len(levels) - 1, -1, -1):
            fits = pos + 2**j <= size
            jump = fits & (levels[j][row, np.minimum(pos, size - 1)] >= limit)
            pos = pos + np.where(jump, 2**j, 0)
        return pos

    own = at // BLOCK
    for low in range(0, blocks, AT_ONCE):
        here = np.flatnonzero((own >= low) & (own < low + AT_ONCE)) if blocks > AT_ONCE else np.arange(len(at))
        pos = lift(_levels(grid[low : low + AT_ONCE]), own[here] - low, at[here] % BLOCK + 1, want[here], BLOCK)
        hit = pos < BLOCK
        out[here[hit]], open_[here[hit]] = own[here[hit]] * BLOCK + pos[hit], False
    left = np.flatnonzero(open_)
    if len(left):
        least = grid.min(axis=1)
        block = lift([x[None] for x in _levels(least)], np.zeros(len(left), int), own[left] + 1, want[left], blocks)
        left, block = left[block < blocks], block[block < blocks]
        run = np.minimum.accumulate(grid, axis=1)
        pos = np.zeros(len(left), int)
        for j in range(BLOCK.bit_length() - 2, -1, -1):
            pos = pos + np.where(run[block, pos + 2**j - 1] >= want[left], 2**j, 0)
        out[left] = block * BLOCK + pos
    return out


def _numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.fill_null(0).to_numpy().astype(np.int64)


def _in_order(df: DataFrame, *by: str) -> DataFrame:
    """df in parts by ranges of the columns `by`, each in their order; there are as many parts as Spark has for shuffles.
    A part takes a share of the rows, whatever a single source or key has of them."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *by).sortWithinPartitions(*by)


def _number_commits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seen = TaskContext.get().partitionId(), 0
    for b in batches:
        commits = b.column("kind").to_numpy() == COMMIT
        rank = seen + np.cumsum(commits)
        seen = int(rank[-1]) if len(rank) else seen
        extra = {"rank": pa.array(rank, pa.int64(), mask=~commits), "part": pa.array([part] * len(b), pa.int32())}
        yield pa.record_batch({**{c: b.column(c) for c in b.schema.names}, **extra})


#: What is known of a record, or of a part: its first and last source, what ends the transaction it begins in, and the
#: first rollback and whether there is a savepoint before that.
_FOUND = "what string, part int, seq long, key long, value long, kind int, by long, rank long, same boolean, first_source string, last_source string, saved boolean"
_FIELDS = [f.split()[0] for f in _FOUND.split(", ")]
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}


def _rows(n: int, what: str, part: int, **columns) -> Iterator[pa.RecordBatch]:
    """Rows of _FOUND, in batches."""
    types = {f.split()[0]: _ARROW[f.split()[1]] for f in _FOUND.split(", ")}
    given = {"what": pa.array([what] * n), "part": pa.array(np.full(n, part, np.int32)), **columns}
    table = pa.table([given[c] if c in given else pa.nulls(n, types[c]) for c in _FIELDS], schema=pa.schema(list(types.items())))
    yield from table.to_batches(65536)


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What becomes of the changes of one part, which is in the order of sources and of their logs.

    A change whose transaction doesn't end here is open: `same` if no savepoint follows it here. The part's own row says
    how the transaction goes on that comes in from the part before."""
    part, columns, changed, first, last = TaskContext.get().partitionId(), [], [], None, None
    for b in batches:
        if len(b):
            src = b.column("source")
            new = np.empty(len(b), bool)
            new[0] = bool(columns) and src[0].as_py() != last
            a, z = src.slice(1), src.slice(0, len(b) - 1)
            differ = pc.or_(pc.xor(a.is_null(), z.is_null()), pc.fill_null(pc.not_equal(a, z), False))
            new[1:] = differ.to_numpy(zero_copy_only=False)
            first, last = first if columns else src[0].as_py(), src[-1].as_py()
            changed.append(new)
            columns.append(b.select(["seq", "kind", "key", "value", "rank"]))
    if not columns:
        return
    table, breaks = pa.Table.from_batches(columns), np.flatnonzero(np.concatenate(changed))
    kind = np.insert(table.column("kind").to_numpy().astype(np.int8), breaks, END)
    seq = np.insert(table.column("seq").to_numpy(), breaks, 0)
    key = np.insert(_numbers(table.column("key")), breaks, 0)
    rank = np.insert(_numbers(table.column("rank")), breaks, 0)
    value = np.insert(_numbers(table.column("value")), breaks, 0)
    deletes = np.insert(table.column("value").is_null().to_numpy(), breaks, True)
    del table, columns
    n = len(kind)
    changes = np.flatnonzero(kind == CHANGE)
    by = first_lower(heights(kind), changes)
    ended = by < n
    what = np.where(ended, kind[np.minimum(by, n - 1)], -1)

    def column(x: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
        return pa.array(x, pa.int64(), mask=null)

    undone = ended & (what != COMMIT)
    own, to = changes[undone], by[undone]
    yield from _rows(len(own), "undone", part, seq=column(seq[own]), key=column(key[own]), kind=pa.array(what[undone], pa.int32()), by=column(seq[to], what[undone] == END))
    kept = ended & (what == COMMIT)
    own, to = changes[kept], by[kept]
    yield from _rows(len(own), "kept", part, seq=column(seq[own]), key=column(key[own]), value=column(value[own], deletes[own]), rank=column(rank[to]))
    own = changes[~ended]
    after = np.flatnonzero(kind == SAVEPOINT)
    same = own > (after[-1] if len(after) else -1)
    yield from _rows(len(own), "open", part, seq=column(seq[own]), key=column(key[own]), value=column(value[own], deletes[own]), same=pa.array(same))
    ends = np.flatnonzero((kind == COMMIT) | (kind == ABORT) | (kind == END))
    head = kind[: ends[0]] if len(ends) else kind
    saves, backs = np.flatnonzero(head == SAVEPOINT), np.flatnonzero(head == ROLLBACK)
    back = len(backs) and (not len(saves) or backs[0] < saves[0])
    end = int(ends[0]) if len(ends) else None
    yield from _rows(
        1, "part", part, seq=pa.array([None if end is None else int(seq[end])], pa.int64()), kind=pa.array([None if end is None else int(kind[end])], pa.int32()),
        rank=pa.array([None if end is None else int(rank[end])], pa.int64()), by=pa.array([int(seq[backs[0]]) if back else None], pa.int64()),
        first_source=pa.array([first], pa.string()), last_source=pa.array([last], pa.string()), saved=pa.array([bool(len(saves))]),
    )


def _carry(parts: DataFrame) -> DataFrame:
    """For each part, how the transaction goes on that is open at its end: (part, end, back).

    parts has one row for each part, of which there is a fixed number."""
    order = Window.orderBy("part")
    p = parts.withColumn("breaks", (F.lag("part").over(order).isNotNull()) & ~F.lag("last_source").over(order).eqNullSafe(F.col("first_source")))
    end = F.when(F.col("breaks"), F.struct(F.lit(END).alias("kind"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("long").alias("rank"))).when(
        F.col("kind").isNotNull(), F.struct("kind", F.when(F.col("kind") != END, F.col("seq")).alias("seq"), "rank")
    )
    back = F.when(F.col("breaks"), F.struct(F.lit(None).cast("long").alias("by"))).when(F.col("by").isNotNull() | F.col("saved") | F.col("kind").isNotNull(), F.struct("by"))
    later = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    return p.select("part", end.alias("end"), back.alias("back")).select("part", F.last("end", True).over(later).alias("end"), F.last("back", True).over(later).alias("back"))


_DELTA = "what string, part int, epoch long, n long, value long, key long, last_key long, last_value long"


def _deltas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many keys and how much value each applied change adds to its epoch's store, summed by epoch; and the part's own
    row: its first change, which follows one in an earlier part, and its last."""
    part, held, head, schema = TaskContext.get().partitionId(), None, None, pa.schema([(f.split()[0], _ARROW[f.split()[1]]) for f in _DELTA.split(", ")])
    for b in batches:
        if not len(b):
            continue
        key, rank = b.column("key").to_numpy(), b.column("rank").to_numpy()
        there, value = (~b.column("value").is_null().to_numpy(zero_copy_only=False)).astype(np.int64), _numbers(b.column("value"))
        epoch = (rank - 1) // EPOCH + 1
        before = held or (None, 0, 0)
        follows = np.r_[before[0] is not None and key[0] == before[0], key[1:] == key[:-1]]
        dn = there - np.where(follows, np.r_[before[1], there[:-1]], 0)
        dv = value - np.where(follows, np.r_[before[2], value[:-1]], 0)
        if head is None:  # what it follows is in another part
            head, dn[0], dv[0] = (int(epoch[0]), int(there[0]), int(value[0]), int(key[0])), 0, 0
        held = int(key[-1]), int(there[-1]), int(value[-1])
        at, where = np.unique(epoch, return_inverse=True)
        sums = [np.zeros(len(at), np.int64) for _ in range(2)]
        np.add.at(sums[0], where, dn)
        np.add.at(sums[1], where, dv)
        none = pa.nulls(len(at), pa.int64())
        yield pa.record_batch([pa.array(["delta"] * len(at)), pa.array([part] * len(at), pa.int32()), pa.array(at), pa.array(sums[0]), pa.array(sums[1]), none, none, none], schema=schema)
    if head is not None:
        last = held[2] if held[1] else None
        yield pa.RecordBatch.from_pylist([{"what": "part", "part": part, "epoch": head[0], "n": head[1], "value": head[2], "key": head[3], "last_key": held[0], "last_value": last}], schema)


def running(rows: DataFrame, by: str, most: int, *sums: str) -> DataFrame:
    """rows with running totals in the place of the columns `sums`, in the order of by, whose values go from 1 to most.

    Values fall into ranges, as many as Spark has parts for shuffles; each is summed by itself and gets the total before it."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = rows.withColumn("__range", F.floor((F.col(by) - 1) * ranges / F.lit(max(most, 1))).cast("int"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    total = own.groupBy("__range").agg(*[F.sum(c).alias(c) for c in sums]).select("__range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in sums])
    inner = Window.partitionBy("__range").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumns({c: F.sum(c).over(inner) for c in sums}).join(F.broadcast(total), "__range").select(
        *[(F.col(c) + F.col(f"__{c}")).alias(c) if c in sums else c for c in rows.columns]
    )


def replay(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a log's transactions undo, and its store after each epoch.

    records: (seq, source, kind, key, value), kind being one of the numbers above. By ascending seq each source, null being
    one, runs transactions that end by commit, abort or the end of its log, which is an abort. A rollback undoes what its
    transaction still has of changes since its latest savepoint, or since its start, and keeps that savepoint. A commit puts the changes that are
    left into the one store of all sources, in their order: value is kept under key, a null value deletes it. An epoch
    ends after each EPOCH commits by seq over all sources, and after the last.

    Returns (undone: seq, kind (ABORT, ROLLBACK or END), by (the record that undoes it, null at the log's end), key), (states: epoch,
    n (stored keys), value (the sum of what they hold)). No commits give no states.

    Parts are ranges of the log, of (source, seq) and of (key, commit, seq), each a like share of the rows whatever a source, a
    transaction or a key has; the number of parts is Spark's number of shuffle partitions and doesn't grow. A part
    is held by one task in narrow columns (some 60 bytes a record) and says in one row how it joins the next. Only such rows, one a part, are
    broadcast or sorted in one task. Records without seq are left out. Equal seq values go by source and then by value, nulls first;
    rows equal in all are records of their own.
    """
    spark, work = records.sparkSession, Scratch(records.sparkSession, "txlog")
    own = records.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in RECORD.split(", ")]).filter("seq is not null")
    numbered = work.table(_in_order(own, "seq", "source", "value").mapInArrow(_number_commits, RECORD + ", rank long, part int"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = work.table(numbered.groupBy("part").agg(F.coalesce(F.max("rank"), F.lit(0)).alias("n")))
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    commits = counts.agg(F.sum("n")).first()[0] or 0
    ranked = numbered.join(F.broadcast(offsets), "part").withColumn("rank", F.col("rank") + F.col("offset")).drop("part", "offset")
    found = work.table(_in_order(ranked, "source", "seq", "value").mapInArrow(_resolve, _FOUND))
    work.drop(numbered, counts)
    carry = _carry(found.filter("what = 'part'"))
    opened = found.filter("what = 'open'").select("part", "seq", "key", "value", "same").join(F.broadcast(carry), "part", "left")
    opened = opened.withColumn("rolled", F.when(F.col("same"), F.col("back.by")))
    closed = F.coalesce(F.col("end.kind"), F.lit(END))
    undone = found.filter("what = 'undone'").select("seq", "kind", "by", "key").union(
        opened.filter(F.col("rolled").isNotNull() | (closed != COMMIT)).select(
            "seq", F.when(F.col("rolled").isNotNull(), F.lit(ROLLBACK)).otherwise(closed).alias("kind"), F.coalesce("rolled", "end.seq").alias("by"), "key"
        )
    )
    kept = found.filter("what = 'kept'").select("key", "rank", "seq", "value").union(
        opened.filter(F.col("rolled").isNull() & (closed == COMMIT)).select("key", F.col("end.rank").alias("rank"), "seq", "value")
    )
    steps = work.table(_in_order(kept, "key", "rank", "seq", "value").mapInArrow(_deltas, _DELTA))
    last = Window.orderBy("part")
    heads = steps.filter("what = 'part'").withColumns({"b_key": F.lag("last_key").over(last), "b_value": F.lag("last_value").over(last)})
    follows = F.coalesce(F.col("b_key") == F.col("key"), F.lit(False))
    heads = heads.select(
        "epoch", (F.col("n") - F.when(follows & F.col("b_value").isNotNull(), 1).otherwise(0)).alias("n"), (F.col("value") - F.when(follows, F.coalesce("b_value", F.lit(0))).otherwise(0)).alias("value")
    )
    epochs = -(-commits // EPOCH)
    every = spark.range(1, epochs + 1).select(F.col("id").alias("epoch"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("value"))
    by_epoch = steps.filter("what = 'delta'").select("epoch", "n", "value").union(heads).union(every).groupBy("epoch").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
    return undone, running(by_epoch, "epoch", epochs, "n", "value")


def records_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents as records: crc32(doc_id) says what each is, and a change's key and value (crc32 of key:text).

    A null text, and one that any row of labels calls toxic, deletes the key. Texts don't move, only their checksums."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    m = h % 41
    kind = F.when(m <= 1, COMMIT).when(m == 2, ABORT).when(m <= 4, SAVEPOINT).when(m <= 6, ROLLBACK).otherwise(CHANGE)
    key = F.floor(h / 100) % KEYS
    own = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("seq"), F.col("source").cast("string").alias("source"), kind.alias("kind"), F.when(kind == CHANGE, key).alias("key"), F.when(kind == CHANGE, F.crc32(F.concat(key.cast("string"), F.lit(":"), F.col("text")))).alias("value"))
    toxic = labels.filter("toxic = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("seq")).distinct().withColumn("toxic", F.lit(True))
    out = own.join(toxic.hint("merge"), "seq", "left")  # neither side is small enough to be broadcast
    return out.withColumn("value", F.when(F.col("toxic").isNull(), F.col("value"))).drop("toxic")


def op11_txlog(spark, sf_dir: str) -> DataFrame:
    undone, states = replay(records_of(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")]))
    rows = undone.select(F.when(F.col("kind") == ROLLBACK, "rollback").otherwise("abort").alias("kind"), F.col("seq").alias("id"), F.col("by").alias("n"), F.col("key").alias("value"))
    return rows.union(states.select(F.lit("state"), "epoch", "n", "value"))
