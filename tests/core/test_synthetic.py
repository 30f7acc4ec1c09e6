"""Questions, answers and hard negatives against sets in plain Python."""

import random

from sparkloom.operators import reach as H
from sparkloom.operators import synthetic as Y

SCHEMA = "repo long, src long, dst long, kind string, line int, confidence double, evidence long"


def test_against_sets(spark):
    r = random.Random(4)
    own = [(repo, r.randrange(14), r.randrange(14), r.choice(["import", "call", "inheritance"])) for repo in range(5) for _ in range(20)]
    edges = spark.createDataFrame([(*e, i, 1.0, i) for i, e in enumerate(own)], SCHEMA).repartition(3)
    files = [(repo, f, f % 3) for repo in range(6) for f in range(16)]
    nodes = spark.createDataFrame([(*f, 1, 1) for f in files], "repo long, file long, folder long, loc long, symbols long")
    entries = nodes.filter("file % 7 = 0 and repo <> 4").select("repo", "file")
    cyclic = H.in_cycle(edges)
    asked = Y.questions(nodes, edges, H.reach_counts(edges), cyclic, entries)
    truth = Y.answers(asked, edges, cyclic, entries)
    wrong = Y.hard_negatives(asked, truth, nodes, edges, nodes.selectExpr("repo", "file", "folder as cluster"))

    def reach(repo, f, turn):
        seen, todo = set(), [f]
        while todo:
            x = todo.pop()
            for q, a, b, _ in own:
                a, b = (b, a) if turn else (a, b)
                if q == repo and a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    want, near, degree = {}, {}, {}
    for repo, f, folder in files:
        degree[repo, f] = sum((a == f) + (b == f) for q, a, b, _ in own if q == repo)
        mates = {g for q, g, h in files if q == repo and h == folder}
        up, down = reach(repo, f, False), reach(repo, f, True)
        want[repo, "imports-of", f] = {a for q, a, b, k in own if q == repo and b == f and k == "import"}
        want[repo, "who-calls", f] = {a for q, a, b, k in own if q == repo and b == f and k == "call"}
        want[repo, "blast-radius", f] = down - {f}
        want[repo, "cycle-through", f] = (up & down) - {f}
        near[repo, "imports-of", f] = {b for q, a, b, k in own if q == repo and a == f and k == "import"}
        near[repo, "who-calls", f] = near[repo, "cycle-through", f] = mates
        near[repo, "blast-radius", f] = up - {f}
    chosen = {}
    for repo in range(6):
        for kind in Y.KINDS[:-1]:
            own_ = sorted((f for q, f, _ in files if q == repo), key=lambda f: (-degree[repo, f], f))
            yes, no = [f for f in own_ if want[repo, kind, f]][:5], [f for f in own_ if not want[repo, kind, f]][:1]
            for n, f in enumerate(sorted(yes + no, key=lambda f: (-degree[repo, f], f))):
                chosen[repo, kind, f] = n
        if repo != 4:
            chosen[repo, "entry-points", None] = 0
            want[repo, "entry-points", None] = {0, 7, 14}
            near[repo, "entry-points", None] = {f for q, f, _ in files if q == repo}
    got = asked.collect()
    assert {(x.repo, x.kind, x.file): x.n for x in got} == chosen and len(got) == len(chosen)
    assert all(x.expected == len(want[x.repo, x.kind, x.file]) and x.negative == (x.expected == 0) for x in got)
    assert {x.question for x in got if x.kind == "blast-radius" and x.file == 3} <= {"What breaks if I change 3?"}
    by = {}
    for x in truth.collect():
        by.setdefault((x.repo, x.kind, x.file), set()).add(x.answer)
    assert by == {k: want[k] for k in chosen if want[k]}
    expected = {k: sorted(near[k] - want[k] - {k[2]})[:3] for k in chosen}
    assert {(x.repo, x.kind, x.file): x.negatives for x in wrong.collect()} == {k: v for k, v in expected.items() if v}
    total = {x.kind: x for x in Y.summary(asked, wrong).collect()}
    for kind in Y.KINDS:
        mine = [k for k in chosen if k[1] == kind]
        assert (total[kind].questions, total[kind].controls, total[kind].with_negatives, total[kind].negatives) == (len(mine), sum(not want[k] for k in mine), sum(bool(expected[k]) for k in mine), sum(len(expected[k]) for k in mine))
