"""Product codes of vectors in whole numbers, by partial-distance search."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: A component is floor(SCALE * x); parts of a vector, entries of a codebook, rounds of fitting.
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows searched at once, dimensions summed before entries are dropped.
BLOCK, FIRST = 2048, 3
#: Squares of larger components don't add up in 64 bits; they are worked on as Python's whole numbers.
LARGE = 2**26
MOST = 2**63 - 1


def usable(v: Column) -> Column:
    """Not null and all components finite; zero vectors are as any other."""
    return F.coalesce(F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))), F.lit(False))


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exactly."""
    y = np.floor(x * SCALE) if np.abs(x).max(initial=0) < LARGE else None
    if y is not None and np.abs(y).max(initial=0) < LARGE:
        return y.astype(np.int64)
    return np.frompyfunc(lambda c: math.floor(Fraction(float(c)) * SCALE), 1, 1)(x)


def _closest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry to each row, ties to the lower index, by partial distances.

    Dimensions go in the order of their variance over the codebook, largest first. Of each row, the entry ahead after the
    first of them is measured completely; from then on masks drop the entries whose sum so far strictly exceeds the
    row's best complete distance, which is measured anew for the entry ahead after each further dimension of the first."""
    if x.dtype == object or book.dtype == object:
        x, book = x.astype(object), book.astype(object)
    n, dims = x.shape
    spread = (book.astype(float) - book.astype(float).mean(axis=0)) ** 2
    order = np.argsort(-spread.sum(axis=0), kind="stable")
    x, book = x[:, order], book[:, order]
    head = min(FIRST, dims)
    so_far = np.zeros((n, len(book)), x.dtype)
    for d in range(head):
        so_far += (x[:, d, None] - book[None, :, d]) ** 2
    ahead = so_far.argmin(axis=1)
    best = ((x - book[ahead]) ** 2).sum(axis=1)
    row, entry = np.nonzero(so_far <= best[:, None])
    held = so_far[row, entry]
    for d in range(head, dims):
        held = held + (x[row, d] - book[entry, d]) ** 2
        stays = held <= best[row]
        row, entry, held = row[stays], entry[stays], held[stays]
        if d < dims - 1 and len(row) > 2 * n:  # many are left: a better complete distance pays
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            least = np.minimum.reduceat(held, first)
            where = np.flatnonzero(held == np.repeat(least, np.diff(np.r_[first, len(row)])))
            one = where[np.r_[True, row[where][1:] != row[where][:-1]]]
            best = np.minimum(best, ((x - book[entry[one]]) ** 2).sum(axis=1))
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    least = np.minimum.reduceat(held, first)
    where = np.flatnonzero(held == np.repeat(least, np.diff(np.r_[first, len(row)])))
    one = where[np.r_[True, row[where][1:] != row[where][:-1]]]
    return entry[one], least


def closest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As _closest, block by block."""
    got = [_closest(x[at : at + BLOCK], book) for at in range(0, len(x), BLOCK)]
    return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])


@dataclass
class Codebooks:
    """One array (entries, width) for each part; vectors of length dim are filled up with zeros to parts of one width."""

    books: list[np.ndarray]
    dim: int

    @property
    def width(self) -> int:
        return self.books[0].shape[1]

    def parts_of(self, column: pa.Array) -> list[np.ndarray]:
        x = whole(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, self.dim))
        x = np.concatenate([x, np.zeros((len(x), self.width * len(self.books) - self.dim), x.dtype)], axis=1)
        return [x[:, p * self.width : (p + 1) * self.width] for p in range(len(self.books))]

    def decode(self, code: str) -> list[int]:
        """The components that a code stands for."""
        return [c for p, book in enumerate(self.books) for c in book[int(code[2 * p : 2 * p + 2], 16)].tolist()][: self.dim]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(c) for book in self.books for c in book.ravel().tolist()).encode()).hexdigest()


def _split(rows: list, dim: int, parts: int) -> list[np.ndarray]:
    x = whole(np.array(rows, dtype=float).reshape(-1, dim))
    width = -(-dim // parts)
    x = np.concatenate([x, np.zeros((len(x), width * parts - dim), x.dtype)], axis=1)
    return [x[:, p * width : (p + 1) * width] for p in range(parts)]


def _round(table: DataFrame, books: Codebooks) -> Codebooks:
    """The entries as the floors of the means of what is nearest to them; unused ones stay.

    Each task gives its sums by entry, which Spark adds up; the driver gets one row for each used entry."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(book.shape, book.dtype) for book in books.books]
        count = [np.zeros(len(book), np.int64) for book in books.books]
        for b in batches:
            for p, x in enumerate(books.parts_of(b.column("v")) if len(b) else ()):
                near, _ = closest(x, books.books[p])
                if x.dtype == object:
                    total[p] = total[p].astype(object)
                np.add.at(total[p], near, x)
                count[p] += np.bincount(near, minlength=len(count[p]))
        for p, n in enumerate(count):
            used = np.flatnonzero(n)
            text = [[str(c) for c in t] for t in total[p][used].tolist()]
            yield pa.record_batch({"part": pa.array([p] * len(used), pa.int32()), "entry": pa.array(used, pa.int32()), "n": pa.array(n[used], pa.int64()), "sums": pa.array(text, pa.list_(pa.string()))})

    def mean(own: pa.Table) -> pa.Table:
        n = sum(own.column("n").to_pylist())
        means = [str(sum(map(int, c)) // n) for c in zip(*own.column("sums").to_pylist(), strict=True)]
        return own.slice(0, 1).select(["part", "entry"]).append_column("mean", pa.array([means], pa.list_(pa.string())))

    rows = table.select("v").mapInArrow(sums, "part int, entry int, n long, sums array<string>")
    new = [book.copy() for book in books.books]
    for r in rows.groupBy("part", "entry").applyInArrow(mean, "part int, entry int, mean array<string>").collect():
        means = [int(c) for c in r.mean]
        if max(map(abs, means)) >= LARGE:
            new[r.part] = new[r.part].astype(object)
        new[r.part][r.entry] = means
    return Codebooks(new, books.dim)


def fit(table: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks from the vectors of the least vec_ids (at most 256 rows), after rounds over all rows; None without rows.
    Null vec_ids come last, equal ones in the order of their vectors."""
    seeds = table.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not seeds:
        return None
    books = Codebooks(_split([r[0] for r in seeds], dim, parts), dim)
    for _ in range(rounds):
        books = _round(table, books)
    return books


def encode(table: DataFrame, books: Codebooks) -> DataFrame:
    """table (vec_id, label, v) with code and error in place of v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            found = [closest(x, book) for x, book in zip(books.parts_of(b.column("v")), books.books, strict=True)]
            code = ["".join(f"{i:02x}" for i in c) for c in zip(*[f[0].tolist() for f in found], strict=True)]
            error = [min(sum(e), MOST) for e in zip(*[f[1].tolist() for f in found], strict=True)]
            yield pa.record_batch({"vec_id": b.column("vec_id"), "label": b.column("label"), "code": pa.array(code, pa.string()), "error": pa.array(error, pa.int64())})

    label = table.schema["label"].dataType.simpleString()
    return table.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """Codes of all vectors (vec_id, embedding, label) and the codebooks they refer to.

    Returns rows vec_id, code (two hex digits a part), error (squared distance to what the code stands for), label_error
    (the sum of error over rows of the same label, nulls being one) and codebooks_sha256. Each row is in one task at a time;
    tasks hold the codebooks (4 of at most 256 entries) and a block of rows, and only sums by entry are shuffled.

    Vectors that are null or hold null or non-finite components take no part; nor do empty ones and those of another
    length than most (the shorter length on a tie). A length that isn't a multiple of four is filled up with zeros. Repeated rows
    and null vec_ids come back as often as they are there. Errors above 2**63 - 1 count as that. Without a column
    label, all are null; other columns are left out. No rows give no rows, and no codebooks.
    """
    spark, work = vectors.sparkSession, Scratch(vectors.sparkSession, "codes")
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("v")).filter(usable(F.col("v")) & (F.size("v") > 0))
    lengths = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if lengths is None:
        return spark.createDataFrame([], schema), None
    table = work.table(own.filter(F.size("v") == lengths[0]))
    books = fit(table, lengths[0], rounds=rounds)
    codes = work.table(encode(table, books))
    work.drop(table)
    total = codes.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    out = codes.join(total, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")), books


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]


def _sql() -> str:
    """The rounds as a chain of tables: a, what is nearest; c, the entries."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(
            f"a{r} as materialized (select v.rid, v.part, min(struct_pack(d := list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, e := c.entry)) as m"
            f" from v join c{r} c using (part) group by v.rid, v.part)"
        )
        if r < ROUNDS:
            steps.append(
                f"s{r} as (select a.part, a.m.e as entry, v.pos, sum(v.c)::hugeint as total, count(*) as n from a{r} a join flat v using (rid, part) group by 1, 2, 3),"
                f" m{r} as (select part, entry, list((total - (((total % n) + n) % n)) // n order by pos)::bigint[] as x from s{r} group by 1, 2),"
                f" c{r + 1} as materialized (select c.part, c.entry, coalesce(m.x, c.x) as x from c{r} c left join m{r} m using (part, entry))"
            )
    return f"""
with own as (select row_number() over (order by vec_id, embedding) as rid, vec_id, label, list_transform(embedding, lambda y: floor({SCALE} * y::double)::bigint) as y from embeddings
  where embedding is not null and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0),
v as materialized (select rid, p as part, y[p * len(y) // {PARTS} + 1 : (p + 1) * len(y) // {PARTS}] as x from own, range({PARTS}) as t(p)),
flat as materialized (select rid, part, unnest(x) as c, unnest(range(len(x))) as pos from v),
c0 as (select part, (rid - 1)::int as entry, x from v where rid <= {ENTRIES}),
{", ".join(steps)},
done as (select rid, string_agg(format('{{:02x}}', m.e), '' order by part) as code, sum(m.d)::bigint as error from a{ROUNDS} group by rid),
sha as (select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) as h from c{ROUNDS})
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, h as codebooks_sha256 from own join done using (rid), sha
"""


OP13_SQL = _sql()
