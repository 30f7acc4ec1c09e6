import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import nearest as N
from sparkloom.llm.common import Scratch

SCHEMA = "vec_id long, embedding array<float>"


def brute(own, k=10):
    best = {}
    for i, v in own:
        if i is None or v is None or len(v) != 16 or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        best.setdefault(i, []).append(np.array(v, np.float32).astype(float))
    out = {}
    for q in best:
        if q % 20 == 0:
            x = min(best[q], key=lambda v: v.tobytes())
            rows = sorted((min(float(np.sqrt(((x - y) ** 2).sum())) for y in ys), i) for i, ys in best.items() if i != q)
            out[q] = rows[:k]
    return out


def run(spark, own, k=10):
    df = spark.createDataFrame(own, SCHEMA).repartition(4).withColumn("score", F.lit("x")).withColumn("codes", F.lit(1))
    got = {}
    for r in N.nearest(df, F.col("vec_id") % 20 == 0, k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    return got


def test_recall_and_exact_scores(spark):
    r = np.random.default_rng(0)
    own = [(i, r.normal(size=16).astype(float).tolist()) for i in range(3000)]
    got, want = run(spark, own), brute(own)
    assert set(got) == set(want)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.95 * 10 * len(want)
    exact = {(q, i): s for q, rows in want.items() for s, i in rows}
    for q, rows in got.items():
        assert rows == sorted(rows) and len(rows) == 10
        assert all(abs(exact[q, i] - s) < 1e-12 for s, i in rows if (q, i) in exact)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0] * 16
    own = [(i, [float(i % 7)] * 15 + [1.0]) for i in range(60)]
    own += [(100, None), (120, [0.0] * 16), (140, [nan] * 16), (160, [inf] + one[1:]), (180, [None] + one[1:]), (200, [1.0, 2.0]), (None, one), (220, []), (40, own[40][1])]
    assert run(spark, own) == brute(own)
    copies = [(i, one) for i in range(5000)] + [(6000, [2.0] * 16)]
    assert run(spark, copies) == brute(copies)
    assert run(spark, own[:3]) == brute(own[:3]) and run(spark, [(0, one)]) == {} and run(spark, []) == {}


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    own = [(i, np.random.default_rng(i).normal(size=16).tolist()) for i in range(500)]
    whole = run(spark, own)
    monkeypatch.setattr(N, "QUERIES", 5)
    assert run(spark, own) == whole
    monkeypatch.setattr(N, "PART", 100)  # a short list in each of five parts
    assert run(spark, own) == whole == brute(own)


def test_beam_beats_greed_and_codes_decode(spark):
    x = np.random.default_rng(2).normal(size=(2000, 16))
    m = N.fit(x, books=6, entries=16)
    error = lambda c: ((x - m.decode(c)) ** 2).sum()
    assert error(m.encode(x, 8)) < error(m.encode(x, 1)) < (x**2).sum()
    codes = m.encode(x[:50])
    want = m.norms(codes)[None] - 2 * x[:5] @ m.decode(codes).T
    assert np.allclose(m.scores(x[:5], m.packed(codes), m.norms(codes)), want, atol=1e-3)
    index, _, dim = N.build_index(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA), Scratch(spark, "t"), 10)
    assert index.count() == len(np.unique(x.astype(np.float32), axis=0)) and dim == 16
