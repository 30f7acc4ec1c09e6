import random
from collections import deque

import pytest

from sparkloom.operators import graph as G
from sparkloom.operators import ordered_graph as O
from sparkloom.operators import reach as H

SCHEMA = "repo long, src long, dst long, kind string, line int, confidence double, evidence long"


def frame(spark, pairs, repo=1):
    return spark.createDataFrame([(repo, a, b, "import", k, 1.0, k) for k, (a, b) in enumerate(pairs)], SCHEMA)


def bfs(pairs):
    out = {}
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
    for s in {x for p in pairs for x in p}:
        seen, todo = {s: 0}, deque([s])
        while todo:
            x = todo.popleft()
            for y in near.get(x, ()):
                if y not in seen:
                    seen[y] = seen[x] + 1
                    todo.append(y)
        out |= {(s, t): d for t, d in seen.items() if t != s}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_closure_and_cycles_against_a_model(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(25), r.randrange(25)) for _ in range(45)]
    e = frame(spark, pairs)
    reach = G.closure(e)
    want = bfs(pairs)
    assert {(x.src, x.dst): x.depth for x in reach.collect()} == want
    assert {(x.src, x.dst): x.depth for x in G.closure(e, max_depth=2).collect()} == {k: d for k, d in want.items() if d <= 2}
    ring = {x for x, y in want if (y, x) in want} | {a for a, b in pairs if a == b}
    assert {x.file for x in H.in_cycle(e).collect()} == ring
    found = O.cycles(e).collect()
    for c in found:
        ids = [int(x) for x in c.cycle.split(",")]
        assert min(ids) == ids[0] and len(ids) == c.size and all(p in pairs for p in zip(ids, ids[1:] + ids[:1], strict=True))
    assert bool(found) == bool(ring)


def test_small_cycles(spark):
    assert [r.cycle for r in O.cycles(frame(spark, [(3, 1), (1, 2), (2, 3)])).collect()] == ["1,2,3"]
    assert [r.cycle for r in O.cycles(frame(spark, [(4, 4)])).collect()] == ["4"]
    assert O.cycles(frame(spark, [(1, 2), (2, 3), (4, 2)])).count() == 0
    assert sorted(r.cycle for r in O.cycles(frame(spark, [(1, 2), (2, 3), (3, 4), (4, 1)]).union(frame(spark, [(1, 2), (2, 1)], 2))).collect()) == ["1,2", "1,2,3,4"]


def modularity(pairs, of):
    m2 = 2 * len(pairs)
    degree = {}
    inside = 0
    for a, b in pairs:
        degree[of[a]] = degree.get(of[a], 0) + 1
        degree[of[b]] = degree.get(of[b], 0) + 1
        inside += 2 * (of[a] == of[b])
    return inside / m2 - sum((d / m2) ** 2 for d in degree.values())


def test_two_triangles_and_a_bridge(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (11, 12), (12, 13), (13, 11), (1, 11)]
    e = frame(spark, pairs)
    c = O.communities(e)
    of = {r.file: r.cluster for r in c.collect()}
    assert len(set(of.values())) == 2 and of[1] == of[2] == of[3] != of[11] == of[12] == of[13]
    q = G.modularity(e, c).first()
    assert q.modularity > 0.3 and abs(q.modularity - modularity(pairs, of)) < 1e-9 and q.internal == 6 and q.external == 2


def test_louvain_beats_single_files_and_is_seeded():
    r = random.Random(2)
    pairs = [(10 * g + r.randrange(10), 10 * g + r.randrange(10)) for g in range(5) for _ in range(25)] + [(r.randrange(50), r.randrange(50)) for _ in range(10)]
    weighted = [(a, b, 1) for a, b in pairs]
    of = O.louvain(weighted, seed=7)
    assert of == O.louvain(weighted, seed=7) and modularity(pairs, of) > 0.5
    assert sorted(O.shuffled(list(range(20)), 3)) == list(range(20)) != O.shuffled(list(range(20)), 3)
    assert O.louvain([]) == {} and O.louvain([(1, 1, 1)]) == {1: 0}


def test_edge_cases(spark):
    empty = frame(spark, []).limit(0)
    nodes = spark.createDataFrame([(1, f, 10, 1, 0) for f in range(3)], "repo long, file long, loc long, symbols long, folder long")
    assert G.closure(empty).count() == 0 and O.cycles(empty).count() == 0
    assert G.isolated(nodes, empty).count() == 3
    m = G.file_metrics(G.degrees(nodes, empty), H.reach_counts(empty))
    assert {r.issue for r in G.issues(m, H.in_cycle(empty)).collect()} == {"isolated"}
    h = G.health(m, H.in_cycle(empty)).first()
    assert (h.health, h.grade) == (85, "B")


def test_louvain_takes_no_move_that_lowers_modularity(spark):
    """Against plain Python: moves in the seeded order end where no vertex gains by moving, ties by the least cluster."""
    r = random.Random(8)
    for seed in range(1, 40):
        n = r.randrange(2, 25)
        pairs = [(r.randrange(n), r.randrange(n), r.choice([1, 2, 3])) for _ in range(r.randrange(1, 50))]
        found = O.louvain(pairs, seed)
        assert set(found) == {u for a, b, _ in pairs for u in (a, b)}
        sizes = [sum(c == k for c in found.values()) for k in range(len(set(found.values())))]
        assert sizes == sorted(sizes, reverse=True) and O.louvain(pairs, seed) == found

        def modularity(of):
            two_m = 2 * sum(w for *_, w in pairs)
            inside = sum(2 * w for a, b, w in pairs if of[a] == of[b])
            total = {}
            for a, b, w in pairs:
                for u in (a, b):
                    total[of[u]] = total.get(of[u], 0) + w
            return inside / two_m - sum(t * t for t in total.values()) / two_m**2

        alone = {u: i for i, u in enumerate(found)}
        assert modularity(found) >= modularity(alone) - 1e-9
    assert O.louvain([(0, 1, 1), (1, 2, 1), (0, 2, 1), (3, 4, 1), (4, 5, 1), (3, 5, 1), (2, 3, 1)]) == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}


def test_only_the_repository_over_the_guard_is_refused(spark, monkeypatch):
    monkeypatch.setattr(O, "MOST_FILES", 3)
    e = frame(spark, [(1, 2), (2, 1)]).union(frame(spark, [(i, i + 1) for i in range(6)], 2)).union(frame(spark, [(5, 6), (6, 7), (7, 5)], 3))
    assert sorted(map(tuple, O.cycles(e).collect()), key=str) == [(1, "1,2", 2), (2, None, None), (3, "5,6,7", 3)]
    found = O.communities(e).collect()
    assert [r for r in found if r.repo == 2] == [(2, None, None)] and {r.file for r in found if r.repo != 2} == {1, 2, 5, 6, 7}
