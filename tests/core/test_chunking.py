"""The chunk plan against a plan line by line in plain Python, MMR against a plain choice, lengths in UTF-16 units."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import chunking as K
from sparkloom.operators import retrieval as R


def u16(s):
    return len(s.encode("utf-16-le")) // 2


def tokens(s):
    return -(-u16(s) // 4)


def plain(text, symbols, size, most):
    """Each line is asked which chunk it is in: that of the span it lies in, or a window of the gap around it."""
    lines = text.split("\n")
    n = len(lines)
    order = sorted(symbols, key=lambda s: (s[1], -(s[2] if s[2] is not None else s[1]), s[0]))
    spans = []
    for i, (name, start, end) in enumerate(order):
        first = max(1, min(start, n))
        if end is None:
            following = order[i + 1][1] if i + 1 < len(order) else n + 1
            end = min(following - 1, max(start, 1) + size - 1)
        spans.append((first, max(first, min(end, n)), name))
    taken, covered = [], 0
    for s in spans:
        if s[0] > covered:
            taken.append(s)
        covered = max(covered, s[1])
    owner = [None] * (n + 1)
    for s in taken:
        for k in range(s[0], s[1] + 1):
            owner[k] = s
    pieces, k = [], 1
    while k <= n:
        if owner[k]:
            pieces.append(owner[k])
            k = owner[k][1] + 1
        else:
            last = k
            while last < n and owner[last + 1] is None and last - k + 1 < size:
                last += 1
            pieces.append((k, last, None))
            k = last + 1
    out = []
    for a, b, name in pieces:
        if tokens("\n".join(lines[a - 1 : b])) <= most:
            out.append((name, a, b))
            continue
        begin, total = a, 0
        for k in range(a, b + 1):
            own = tokens(lines[k - 1] + "\n")
            if k > begin and total + own > most:
                out.append((name, begin, k - 1))
                begin, total = k, 0
            total += own
        out.append((name, begin, b))
    return sorted((name or "", a, b, tokens("\n".join(lines[a - 1 : b]))) for name, a, b in out)


@pytest.mark.parametrize("size,most", [(4, 10**6), (60, 10**6), (5, 12), (3, 1)])
def test_chunk_plan_against_lines(spark, size, most):
    r = random.Random(size)
    files, symbols = {}, {}
    for f in range(60):
        n = r.choice([1, 1, 2, 7, 30, 80])
        files[f] = "\n".join("".join(r.choice("ab é😀") for _ in range(r.choice([0, 3, 20, 60]))) for _ in range(n))
        own = []
        for k in range(r.choice([0, 0, 1, 5, 12])):
            start = r.randrange(-2, n + 6)
            own.append((f"s{k}", start, r.choice([None, start, start + r.randrange(9), start - 2, 10**6])))
        symbols[f] = own
    own = [(f, *s) for f, all_ in symbols.items() for s in all_] + [(999, "unknown", 1, 2), (0, "nowhere", None, 5)]
    df = spark.createDataFrame([(f, t) for f, t in files.items()] + [(1000, None)], "file long, text string").repartition(3)
    got = {}
    for x in K.plan_chunks(df, spark.createDataFrame(own, "file long, name string, start int, end int"), size, most).collect():
        got.setdefault(x.file, []).append((x.name or "", x.start, x.end, x.tokens))
    assert set(got) == set(files)
    for f, text in files.items():
        assert sorted(got[f]) == plain(text, symbols[f], size, most)
        covered = sorted(k for _, a, b, _ in got[f] for k in range(a, b + 1))
        assert covered == list(range(1, len(text.split("\n")) + 1))


def test_no_files_no_symbols(spark):
    files = spark.createDataFrame([(1, "a\nb\nc")], "file long, text string")
    none = spark.createDataFrame([], "file long, name string, start int, end int")
    assert [tuple(r) for r in K.plan_chunks(files, none, 2).orderBy("start").collect()] == [(1, None, 1, 2, 1), (1, None, 3, 3, 1)]
    assert K.plan_chunks(files.limit(0), none).count() == 0


def choose(pool, k, weight):
    """Candidate by candidate."""
    left, out = list(pool), []
    while left and len(out) < k:
        best = None
        for c in sorted(left, key=lambda c: c[0]):
            worst = 0.0
            for o in out:
                if c[3] is not None and o[3] is not None:
                    a, b = np.array(c[3]), np.array(o[3])
                    norm = np.sqrt(a @ a) * np.sqrt(b @ b)
                    s = round(float(a @ b / norm), 6) if norm else 0.0
                else:
                    s = float(c[2] is not None and c[2] == o[2])
                worst = max(worst, s)
            score = round(weight * c[1] - (1 - weight) * worst, 9)
            if best is None or score > best[0]:
                best = (score, c)
        out.append(best[1])
        left.remove(best[1])
    return [c[0] for c in out]


@pytest.mark.parametrize("vectors", [0.0, 0.6, 1.0])
def test_mmr_in_both_modes(spark, vectors):
    r = random.Random(int(10 * vectors))
    pools = {}
    for q in range(12):
        pools[q] = [(i, r.choice([0.1, 0.5, 0.5, 0.9]), r.choice(["a", "b", None]), [r.choice([0.0, 1.0, -1.0]) for _ in range(3)] if r.random() < vectors else None) for i in r.sample(range(100), r.choice([1, 6, 40]))]
    df = spark.createDataFrame([(q, *c) for q, p in pools.items() for c in p], "query_id long, id long, relevance double, group string, v array<double>")
    for weight in (0.7, 0.0, 1.0):
        got = {}
        for x in R.mmr(df, 8, weight).orderBy("query_id", "position").collect():
            got.setdefault(x.query_id, []).append(x.id)
        assert got == {q: choose(p, 8, weight) for q, p in pools.items()}


def test_lengths_in_utf16_units(spark):
    rows = [("plain",), ("😀😀😀",), ("é" * 9,), ("a😀b  \n😀c",), ("",), (None,), ("x" * 50,), ("😀" * 50,)]
    df = spark.createDataFrame(rows, "t string")
    for r in df.select("t", T.estimate_tokens(F.col("t")).alias("n"), T.fnv1a(F.col("t")).alias("h"), T.truncate(F.col("t"), 12).alias("cut")).collect():
        if r.t is None:
            assert r.n is r.h is r.cut is None
            continue
        assert r.n == tokens(r.t) and u16(r.cut) <= 12
        h, flat = 2166136261, " ".join(r.t.split())
        raw = r.t.encode("utf-16-le")
        for k in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[k : k + 2], "little")) * 16777619) & 0xFFFFFFFF
        assert r.h == h
        assert r.cut == flat if u16(flat) <= 12 else r.cut.endswith("…") and flat.startswith(r.cut[:-1]) and u16(r.cut) >= 11
