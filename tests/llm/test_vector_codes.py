import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows):
    """The contract in plain Python: full distances, first of the least."""
    own = [(i, v, b) for i, v, b in rows if v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v)]
    own.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[[math.floor(Fraction(x) * 1024) for x in v[2 * p : 2 * p + 2]] for p in range(4)] for _, v, _ in own]
    books = [[cut[j][p] for j in range(min(256, len(own)))] for p in range(4)]

    def find(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(4):
        for p in range(4):
            near = [find(c[p], books[p])[0] for c in cut]
            for e in set(near):
                hit = [c[p] for c, n in zip(cut, near, strict=True) if n == e]
                books[p][e] = [sum(col) // len(hit) for col in zip(*hit, strict=True)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, total = [], {}
    for (i, _, label), c in zip(own, cut, strict=True):
        found = [find(c[p], books[p]) for p in range(4)]
        out.append((i, "".join(f"{f[0]:02x}" for f in found), sum(f[1] for f in found), label))
        total[label] = total.get(label, 0) + out[-1][2]
    return sorted(((i, c, min(e, V.MOST), min(total[b], V.MOST), sha) for i, c, e, b in out), key=repr)


def got(spark, rows, cols="vec_id code error label_error codebooks_sha256".split()):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("code", "error", "v", "of", "part", "n", "sums"):
        df = df.withColumn(name, F.lit("mine"))
    return sorted([tuple(r) for r in V.compress(df)[0].select(cols).collect()], key=repr)


def made(n, seed=0, grid=64):
    r = random.Random(seed)
    return [(i, [r.randrange(-grid, grid) / 512 for _ in range(8)], r.choice([None, 1, 2])) for i in range(n)]


def test_against_plain_python(spark):
    rows = made(700, 1)  # a coarse grid, so that ties are many
    assert got(spark, rows) == plain(rows)


def test_rows_left_out_repeated_and_tied(spark):
    rows = made(300, 2, 8)
    rows += [rows[0], rows[0], (7, [0.5] * 8, 1), (None, [0.25] * 8, None), (None, [-0.25] * 8, 2), (500, [0.0] * 8, 1), (501, None, 1), (502, [1.0, None] + [0.0] * 6, 1)]
    rows += [(503, [float("nan")] + [0.0] * 7, 1), (504, [float("-inf")] + [0.0] * 7, 1), (505, [], 1), (506, [1.0, 2.0], 1), (507, [-0.0001] * 8, 3)]
    assert got(spark, rows) == plain(rows)


def test_fewer_rows_than_entries_and_none(spark):
    rows = made(5, 3)
    assert got(spark, rows) == plain(rows)
    assert V.compress(spark.createDataFrame([(1, None, 1)], SCHEMA))[0].count() == 0
    assert V.compress(spark.createDataFrame([], SCHEMA).drop("label"))[0].columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_components_beyond_64_bits(spark):
    rows = [(0, [1e300] + [0.0] * 7, 1), (1, [-1e18] * 8, 1), (2, [0.1] * 8, 1), (3, [3e5, -3e5] * 4, None)]
    rows += [(4 + i, [1e18 * (i % 3), 0.1 * i] * 4, 1) for i in range(300)]
    assert got(spark, rows) == plain(rows)


def test_lengths_that_parts_do_not_divide(spark):
    out, books = V.compress(spark.createDataFrame([(i, [i / 7, 1.0, -i / 3, 0.5, 2.0], 1) for i in range(20)], SCHEMA))
    for r in out.collect():
        i = r.vec_id
        assert r.error == 0 and books.decode(r.code) == [math.floor(1024 * x) for x in (i / 7, 1.0, -i / 3, 0.5, 2.0)]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 30), st.integers(1, 9), st.integers(0, 10**6), st.sampled_from([2, 5, 1000]))
def test_partial_distances_find_the_first_of_the_least(n, k, d, seed, grid):
    r = np.random.default_rng(seed)
    x, book = r.integers(-grid, grid, (n, d)), r.integers(-grid, grid, (k, d))
    full = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    near, least = V.closest(x, book)
    assert (near == full.argmin(axis=1)).all() and (least == full.min(axis=1)).all()


def test_masks_drop_most_entries():
    r = np.random.default_rng(3)
    x, book = r.integers(-500, 500, (100, 16)), r.integers(-500, 500, (256, 16))
    near, _ = V._closest(x, book)
    assert (near == ((x[:, None, :] - book[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view embeddings as from '/root/testdata/{sf}/embeddings.parquet'")
    want = con.execute(V.OP13_SQL).fetchall()
    out = V.op13_vector_codes(spark, f"/root/testdata/{sf}").collect()
    assert sorted(map(tuple, out)) == sorted(want)
