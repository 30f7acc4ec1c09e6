"""The closure, whole and in both of its ways, against breadth-first search in plain Python."""

import os
import random
from collections import deque

import duckdb
import pytest
from test_queries import DIR, TABLES

from sparkloom.graph_queries import _BASE, _REACH
from sparkloom.operators import graph as G


def brute(edges):
    near = {}
    for repo, a, b in edges:
        near.setdefault((repo, a), set()).add(b)
    out = []
    for repo, s in near:
        seen, todo = {s: 0}, deque([s])
        while todo:
            x = todo.popleft()
            for y in near.get((repo, x), ()):
                if y not in seen:
                    seen[y] = seen[x] + 1
                    todo.append(y)
        out += [(repo, s, t, d) for t, d in seen.items() if d]
    return sorted(out)


@pytest.mark.parametrize("steps", [10**6, 30, 0])
def test_closure_of_small_and_large_repositories(spark, monkeypatch, steps):
    monkeypatch.setattr(G, "STEPS", steps)
    monkeypatch.setattr(G, "SEEN", 40)
    r = random.Random(3)
    own = [(repo, f"f{r.randrange(n)}", f"f{r.randrange(n)}") for repo, n, m in (("a", 12, 14), ("b", 40, 60), ("c", 2, 3), ("d", 1, 2)) for _ in range(m)] + [("e", f"f{i:02d}", f"f{i + 1:02d}") for i in range(25)]
    edges = spark.createDataFrame(own * 2, "repo string, src string, dst string").repartition(3)
    want = brute(own)
    got = sorted(map(tuple, G.closure(edges).collect()))
    assert got == want and max(w[3] for w in want) == 25
    assert sorted(map(tuple, G.closure(edges, max_depth=2).collect())) == [w for w in want if w[3] <= 2]
    starts = spark.createDataFrame([("a", own[0][1]), ("e", "f03"), ("e", "f03"), ("zz", "f1")], "repo string, src string")
    assert sorted(map(tuple, G.closure(edges, starts=starts).collect())) == [w for w in want if w[:2] in (("a", own[0][1]), ("e", "f03"))]
    assert G.closure(edges.limit(0)).isEmpty()


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_sql_reaches_all(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    want = brute(con.execute(f"{_BASE} select repo, src, dst from edges").fetchall())
    assert sorted(con.execute(f"{_BASE}, {_REACH} select repo, src, dst, depth from reach").fetchall()) == want and max(w[3] for w in want) > 5
