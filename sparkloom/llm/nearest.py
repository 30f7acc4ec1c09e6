"""Approximate nearest neighbours by additive quantisation."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Codebooks, their entries, the beam of the encoder, rounds of fitting.
BOOKS, ENTRIES, BEAM, ROUNDS = 48, 16, 4, 3
#: The codebooks are fitted on at most this many vectors, those with the least hash.
SAMPLE = 12288
#: Distinct vectors of a part of the index; queries of a block.
PART, QUERIES = 16384, 8192
#: The share of a part's vectors that is measured exactly for each query, and how many times k at least.
SHARE, TIMES = 0.04, 8


@dataclass
class Quantiser:
    """x is about the sum of one entry of each full-dimensional book; encoding looks at residuals."""

    books: np.ndarray  # (BOOKS, ENTRIES, dim)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes by beam search: of all extensions of the beam's partial sums the best stay, book after book."""
        b, k, d = self.books.shape
        flat = self.books.reshape(-1, d)
        gram = flat @ flat.T
        out = np.empty((len(x), b), np.uint8)
        for at in range(0, len(x), 512):
            dots = x[at : at + 512] @ flat.T
            n = len(dots)
            codes, cost = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1))
            for m in range(b):
                own = slice(m * k, (m + 1) * k)
                add = np.diag(gram)[own] - 2 * dots[:, own]
                total = cost[:, :, None] + add[:, None, :]
                for j in range(m):
                    total += 2 * gram[j * k + codes[:, :, j], own]
                flat_total = total.reshape(n, -1)
                width = min(beam, flat_total.shape[1])
                best = np.argpartition(flat_total, width - 1, axis=1)[:, :width]
                cost = np.take_along_axis(flat_total, best, axis=1)
                codes = np.concatenate([np.take_along_axis(codes, (best // k)[:, :, None], axis=1), (best % k)[:, :, None]], axis=2)
            out[at : at + 512] = codes[np.arange(n), cost.argmin(axis=1)]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, m]] for m, book in enumerate(self.books))

    def norms(self, codes: np.ndarray) -> np.ndarray:
        """Squared norms of what the codes stand for; stored beside them."""
        return (self.decode(codes) ** 2).sum(axis=1)

    def packed(self, codes: np.ndarray) -> np.ndarray:
        """The codes of two books in one byte each."""
        return (codes[:, ::2] * self.books.shape[1] + codes[:, 1::2]).astype(np.uint8)

    def scores(self, queries: np.ndarray, packed: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Squared distances but for the query's norm, from a table of products for each query and pair of books."""
        out = np.tile(norms.astype(np.float32), (len(queries), 1))
        for m in range(packed.shape[1]):
            one, two = (2 * queries @ self.books[2 * m + i].T for i in range(2))
            out -= np.take((one[:, :, None] + two[:, None, :]).reshape(len(queries), -1).astype(np.float32), packed[:, m], axis=1)
        return out


def fit(x: np.ndarray, books: int = BOOKS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Quantiser:
    """Residual k-means book by book, then rounds of encoding all and solving all books by least squares."""
    r = np.random.default_rng(8)
    k = min(entries, len(x))
    q, rest = np.zeros((books, k, x.shape[1])), x.copy()
    for m in range(books):
        c = rest[r.choice(len(x), k, replace=False)]
        for _ in range(6):
            near = ((c**2).sum(axis=1) - 2 * rest @ c.T).argmin(axis=1)
            n = np.bincount(near, minlength=k)
            held = n > 0
            sums = np.add.reduceat(rest[np.argsort(near, kind="stable")], (np.cumsum(n) - n)[held], axis=0)
            c[held] = sums / n[held, None]
        q[m] = c
        rest = rest - c[((c**2).sum(axis=1) - 2 * rest @ c.T).argmin(axis=1)]
    out = Quantiser(q)
    for _ in range(rounds):
        hot = np.zeros((len(x), books * k), np.float32)
        codes = out.encode(x, 2).astype(np.int64)
        hot[np.arange(len(x))[:, None], np.arange(books) * k + codes] = 1
        ridge = (hot.T @ hot).astype(float) + 1e-2 * np.eye(books * k)
        out = Quantiser((out.books.reshape(-1, x.shape[1]) + np.linalg.solve(ridge, hot.T @ (x - out.decode(codes)))).reshape(q.shape))
    return out


def valid(v: Column) -> Column:
    """Not null, not zero, all components finite."""
    finite = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(v, lambda c: c != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def build_index(vectors: DataFrame, work: Scratch, k: int) -> tuple[DataFrame, Quantiser | None, int]:
    """The index (vector, ids, codes, norm), a row for each distinct valid vector, its quantiser and their dimension.

    ids are the k + 1 least vec_ids that have the vector; no other can be among the k nearest of a query, whose own is
    left out. Vectors of another length than most (the shorter length on a tie) can't be compared and are left out."""
    own = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null").filter(valid(F.col("v")))
    lengths = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], "vector binary, ids array<long>, codes binary, norm double"), None, 0
    dim = lengths[0]
    ranked = own.filter(F.size("v") == dim).distinct().withColumn("k", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("k") <= k + 1)
    distinct = work.table(ranked.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    sample = distinct.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("v").collect()
    model = fit(np.array([r[0] for r in sample]))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                codes = model.encode(x)
                yield pa.record_batch({"vector": pa.array([r.tobytes() for r in x], pa.binary()), "ids": b.column("ids"), "codes": pa.array([r.tobytes() for r in model.packed(codes)], pa.binary()), "norm": pa.array(model.norms(codes))})

    index = work.table(distinct.mapInArrow(encode, "vector binary, ids array<long>, codes binary, norm double"))
    work.drop(distinct)
    return index, model, dim


def search(index: DataFrame, asked: DataFrame, model: Quantiser, dim: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the nearest k to each query of asked (vec_id, vector) in each part of the index.

    Index rows fall into parts and queries into blocks, by hash and in number with the rows alone; each part meets each block
    in a task of its own, which holds no more than the two. There all rows are scored by lookup table, the best SHARE of them
    (TIMES * k at least) is measured exactly, and k rows of a query go on."""
    n, m = index.count(), asked.count()
    parts, blocks = max(1, -(-n // PART)), max(1, -(-m // QUERIES))

    def each(count: int, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)

    rows = index.select("*", F.pmod(F.xxhash64("vector"), F.lit(parts)).cast("int").alias("part"), each(blocks, "block"))
    queries = asked.select("*", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), each(parts, "part"))

    def run(own: pa.Table, other: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(own) and len(other):
            vectors, q = (np.frombuffer(b"".join(t.column("vector").to_pylist()), "<f8").reshape(-1, dim) for t in (own, other))
            codes = np.frombuffer(b"".join(own.column("codes").to_pylist()), np.uint8).reshape(len(own), -1)
            norms, owners, ids = own.column("norm").to_numpy(), own.column("ids"), other.column("vec_id").to_pylist()
            most = min(max(TIMES * k, math.ceil(SHARE * len(own))), len(own))
            for at in range(0, len(ids), 32):
                s = model.scores(q[at : at + 32], codes, norms)
                near = np.argpartition(s, most - 1, axis=1)[:, :most]
                exact = np.sqrt(((vectors[near] - q[at : at + 32, None, :]) ** 2).sum(axis=2))
                for j, d in enumerate(exact):
                    edge = np.partition(d, min(k, most - 1))[min(k, most - 1)]  # of k + 1 vectors, as one may be the query's own
                    held = [(d[c], i) for c in np.flatnonzero(d <= edge).tolist() for i in owners[int(near[j, c])].as_py() if i != ids[at + j]]
                    out += [(ids[at + j], i, x) for x, i in sorted(held)[:k]]
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    return rows.groupBy("part", "block").cogroup(queries.groupBy("part", "block")).applyInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """The k nearest vectors of each query, by Euclidean distance in double precision, nearest first.

    vectors: (vec_id, embedding); is_query: which of them are queries. Every distinct valid vector is encoded and stored
    with the norm of its code; blocks of queries meet parts of the index, are scored from lookup tables and
    reranked on the original vectors. Neither vectors nor queries go to the driver, but for the sample that the books
    are fitted on.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id. Vectors that are null, zero or
    hold null or non-finite components, and rows without vec_id, take no part. Rows that repeat a vec_id are one
    candidate, at its nearest; as a query such a vec_id is its least vector. Fewer candidates give fewer rows.
    """
    spark, work = vectors.sparkSession, Scratch(vectors.sparkSession, "nearest")
    index, model, dim = build_index(vectors, work, k)
    if model is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    own = vectors.filter(is_query).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    own = own.filter("vec_id is not null").filter(valid(F.col("v"))).filter(F.size("v") == dim)
    least = own.groupBy("vec_id").agg(F.min("v").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            yield pa.record_batch({"vec_id": b.column("vec_id"), "vector": pa.array([r.tobytes() for r in x], pa.binary())})

    asked = work.table(least.mapInArrow(pack, "vec_id long, vector binary"))
    merged = search(index, asked, model, dim, k).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = merged.withColumn("rank", F.expr("row_number() over (partition by query_id order by score, vec_id)")).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op8_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
