import random
import re

import numpy as np
import pytest
from cases import clashing, edited, prose, rows, table

from sparkloom.llm import near_dedup as N

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def brute(own, n):
    docs = [(-(2**63) if r[0] is None else r[0], sets(r[1], n)) for r in own]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(docs):
        for j in range(i):
            b = docs[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                if x != y:
                    x, y = sorted((x, y), key=lambda k: docs[k][0])
                    root[y] = x
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    out = []
    for i, (d, s) in enumerate(docs):
        c = least[find(i)]
        out.append(tuple(None if x == -(2**63) else x for x in (d, len(s), c)) + (d == c,))
    return sorted(out, key=str)


def run(df, n):
    return sorted(map(tuple, N.near_groups(df, n).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


@pytest.mark.parametrize("words", [2, 5])
def test_brute_force(spark, words):
    r, own = random.Random(words), []
    for family in range(25):
        text = prose(family + 100, r.choice([8, 20, 60, 150]))
        for _ in range(r.randrange(1, 9)):
            own.append((r.randrange(10**6), text.upper() if r.random() < 0.1 else text, "en", "s", 1))
            text = edited(text, r.randrange(10**6), r.randrange(0, 3)) if " " in text else text
    own += rows()
    assert run(table(spark, own), words) == brute(own, words)


def test_clash_and_empty(spark):
    assert run(clashing(spark), 2) == brute(rows(), 2)
    assert N.near_groups(table(spark, [])).count() == 0
    assert run(table(spark, [(1, None, None, None, None), (2, "", None, None, 0)]), 5) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_pigeonhole_guarantees_pairs_under_the_distance():
    r = np.random.default_rng(0)
    most = N.CHUNKS * (N.ERRORS + 1) - 1
    for _ in range(200):
        a = r.integers(0, 2**16, N.SYMBOLS, dtype=np.uint16)
        b = a.copy()
        at = r.choice(N.SYMBOLS, most, replace=False)
        b[at] ^= r.integers(1, 2**16, most, dtype=np.uint16)
        keys = N.chunk_keys(np.stack([a, b]))
        assert (keys[0] == keys[1]).any()


def test_distance_in_the_join_is_that_of_the_symbols(spark):
    r = np.random.default_rng(1)
    a, b = (r.integers(0, 256, (50, N.SYMBOLS), dtype=np.uint8) for _ in range(2))
    b[:, ::3] = a[:, ::3]
    df = spark.createDataFrame([(x.view("<i8").tolist(), y.view("<i8").tolist(), int((x != y).sum())) for x, y in zip(a, b, strict=True)], "a array<long>, b array<long>, d int")
    assert df.filter(N._distance("a", "b") != df.d).count() == 0


def test_chain_and_star_in_one_bucket(spark):
    """A chain whose ends aren't alike: each link must be found although all share keys with the least one."""
    text, own = prose(7, 100), []
    for i in range(40):
        own.append((i, text, "en", "s", 1))
        text = edited(text, i, 1)
    assert run(table(spark, own), 2) == brute(own, 2)
