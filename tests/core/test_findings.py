"""What a reviewer found at larger sizes: steps that grew faster than their input, and results that differed from their SQL."""

import datetime as dt
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sparkloom import catalog
from sparkloom import retrieval_queries as Q
from sparkloom.operators import evaluation as E
from sparkloom.operators import ordered_graph as O
from sparkloom.operators import reach as H
from sparkloom.operators import retrieval as R
from sparkloom.operators import synthetic as Y


def test_languages_of_files_with_the_same_path(spark, tmp_path):
    """72 paths for all files; a join by path made pairs of all files of a path."""
    rows = spark.range(1, 7201).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).cast("int").alias("c_nationkey"), F.lit("n").alias("c_name"))
    rows.write.parquet(f"{tmp_path}/customer.parquet")
    df = catalog.QUERIES["q021_language"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    assert sorted(map(tuple, df.select("id", "path", "language", "ext").collect())) == sorted(con.execute(catalog.SQL["q021_language"]).fetchall())
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_tables_that_are_folders_of_parts(spark, tmp_path):
    """a larger table is a folder of parts."""
    spark.range(10).repartition(3).write.parquet(f"{tmp_path}/customer.parquet")
    for name in ("documents", "region", "part"):
        (tmp_path / f"{name}.parquet").write_bytes(b"x")
    got = sorted(x.path for x in catalog.QUERIES["q007_local_tree"](spark, str(tmp_path)).collect())
    assert got == sorted(x for (x,) in duckdb.sql(catalog.SQL["q007_local_tree"]).fetchall())


@pytest.mark.parametrize("name", ["q199_session_memory", "q222_session_ttl"])
def test_sessions_of_values_between_two_analyses(spark, tmp_path, name):
    """a half goes to the even number, as in SQL."""
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(minutes=i), i % 7, "click", 30.0 * (i % 5)) for i in range(200)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(catalog.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(str, df.select(columns).collect())) == sorted(str(Row(**dict(zip(columns, r, strict=True)))) for r in want.fetchall())


def test_answers_to_all_questions(spark):
    """not of the files asked about only, which are five of a kind and one without an answer."""
    own = [(1, a, a + 1, k, a, 1.0, a) for a in range(9) for k in ("import", "call")] + [(1, 9, 0, "import", 9, 1.0, 9)]
    edges = spark.createDataFrame(own, "repo long, src long, dst long, kind string, line int, confidence double, evidence long")
    got = Y.answers(None, edges, H.in_cycle(edges), spark.createDataFrame([(1, 0), (2, 0)], "repo long, file long")).collect()
    n = {k: sum(x.kind == k for x in got) for k in Y.KINDS}
    assert n == {"imports-of": 10, "who-calls": 9, "blast-radius": 90, "cycle-through": 90, "entry-points": 2}


def test_search_keeps_the_best_in_its_tasks(spark, monkeypatch):
    """F7 to F16, F20 to F25: no pair of a question and a chunk is shuffled; the same hits by joins."""
    r = random.Random(1)
    text = lambda n: " ".join(r.choice("abcdefgh") * r.choice([2, 3]) for _ in range(n))
    docs = spark.createDataFrame([(i, text(r.randrange(30))) for i in range(300)], "id long, text string").repartition(5)
    asked = spark.createDataFrame([(i, text(4)) for i in range(12)] + [(99, "xyz")], "query_id long, text string")
    index = R.build_index(docs)
    monkeypatch.setattr(R, "CELLS", 50)
    got = sorted(map(tuple, R.bm25(index, asked, 7).collect()))
    terms = asked.select("query_id", F.explode(F.split("text", " ")).alias("token")).distinct()
    assert "Exchange" not in R._best_of_tasks(index, terms, 7)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(R, "BROADCAST_TERMS", 0)
    assert got == sorted(map(tuple, R.bm25(index, asked, 7).collect())) and len(got) == 84
    assert R.bm25(docs.limit(0), asked, 7).count() == 0 and R.bm25(index, asked.limit(0), 7).count() == 0


def test_gates_read_their_aggregate_once(spark):
    """a branch for each gate ran all searches again."""
    one = spark.createDataFrame([(0.5, 3)], "recall double, negatives long")
    out = E.thresholds(one, [("recall", "recall", ">=", 0.6), ("unjustified", "negatives", "<=", 3)])
    assert sorted(map(tuple, out.collect())) == [("recall", 0.5, False), ("unjustified", 3.0, True)]
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_small_repositories_share_a_task(spark, monkeypatch):
    """one pandas call for each of many small repositories; the same rows from plain Python."""
    monkeypatch.setattr(O, "ROWS", 3)
    r = random.Random(2)
    own = sorted({(repo, r.randrange(6), r.randrange(6)) for repo in range(40) for _ in range(9)})
    edges = spark.createDataFrame(own, "repo long, src long, dst long").repartition(4)
    pairs = {repo: [(a, b) for q, a, b in own if q == repo] for repo in range(40)}
    want = sorted((repo, *x) for repo, p in pairs.items() for x in O._cycles(tuple(map(list, zip(*p, strict=True)))))
    got = O.cycles(edges)
    assert sorted(map(tuple, got.collect())) == want and "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()
    want = sorted((repo, *x) for repo, p in pairs.items() for x in O.louvain([(a, b, 1) for a, b in p]).items())
    assert sorted(map(tuple, O.communities(edges).collect())) == want


def made_graph(spark, repos=30, files=12, n=16):
    r = random.Random(5)
    own = sorted({(repo, r.randrange(files), r.randrange(files)) for repo in range(repos) for _ in range(n)})
    return own, spark.createDataFrame([(*e, "call", i, 1.0, i) for i, e in enumerate(own)], "repo long, src long, dst long, kind string, line int, confidence double, evidence long").repartition(3)


def reached(own, turn):
    near, out = {}, {}
    for repo, a, b in own:
        near.setdefault((repo, b if turn else a), set()).add(a if turn else b)
    for repo in {x[0] for x in own}:
        for f in range(100):
            seen, todo = set(), [f]
            while todo:
                new = near.get((repo, todo.pop()), set()) - seen
                seen |= new
                todo += new
            out[repo, f] = seen - {f}
    return out


@pytest.mark.parametrize("steps", [10**6, 0])
def test_negatives_of_a_radius_without_pairs(spark, monkeypatch, steps):
    """all pairs of both directions went through five shuffles, a batch for each level of each repository."""
    own, edges = made_graph(spark, 3, 80, 90)
    starts = spark.createDataFrame([(repo, f) for repo in range(4) for f in range(80)], "repo long, file long")
    monkeypatch.setattr(H.G, "STEPS", steps)
    if steps:
        monkeypatch.setattr(H.G, "closure", None)
    into, out = reached(own, True), reached(own, False)
    want = {(repo, f): (len(into.get((repo, f), ())), sorted(out.get((repo, f), set()) - into.get((repo, f), set()))[:3]) for repo in range(4) for f in range(80)}
    got = H.around(edges, starts, 3).collect()
    assert {(x.repo, x.file): (x.dependents, x.beyond) for x in got} == want and len(got) == len(want)
    assert H.around(edges, starts.limit(0), 3).isEmpty() and H.around(edges.limit(0), starts, 3).count() == 320


def test_small_repositories_are_walked_together(spark):
    """a batch for each level, not for each level of each repository."""
    own, edges = made_graph(spark)
    rows = edges.filter("src <> dst").selectExpr("repo", "src", "dst", "true as start", "0 as block", "1 as blocks").distinct().orderBy("repo").toArrow()
    batches = list(H._chunks(iter(rows.combine_chunks().to_batches()), lambda g, t: H.G._levels(g, t, None), 10**6))
    got = [(x["repo"], x["src"], x["dst"]) for b in batches for x in b.to_pylist()]
    want = [(repo, f, x) for (repo, f), near in reached(own, False).items() for x in near]
    assert sorted(got) == sorted(want) and len(batches) < 12


def test_questions_without_counts(spark):
    """searches from all files, of which only those of the files chosen are asked for."""
    own, edges = made_graph(spark)
    nodes = spark.createDataFrame([(repo, f) for repo in range(31) for f in range(13)], "repo long, file long")
    cyclic, entries = H.in_cycle(edges), nodes.filter("file = 3")
    want = Y.questions(nodes, edges, H.reach_counts(edges), cyclic, entries).collect()
    asked = Y.questions(nodes, edges, None, cyclic, entries)
    got = Y.with_counts(asked, H.around(edges, asked.filter("kind = 'blast-radius'"), 3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and max(x.expected for x in got) > 1


HELD = [
    "alpha beta gamma delta epsilon zeta eta theta", "xalpha beta gamma delta epsilon zetaz", "one two three", "", None, " lead space and more words here ok",
    "tab\tsep\nline two  double  space end", "ñandú über café 日本語テキスト", "aaaa aaaa", "w1 w2 w3 w4 w5 ", "alpha beta gamma delta epsilon zeta eta theta", "a" * 90 + " " + "b" * 90,
]
PASSAGES = [
    "alpha", "alpha beta gamma", "beta gamma delta epsilon zeta", "alpha beta gamma delta epsilon zeta", "alpha beta gamma delta epsilon zeta eta", "", " ", "two", "lead space and more words here",
    " lead space and more words here", "line two  double", " end", "d spa", "本語", "ñ", "a", "aa", "aaaaaaaa", "w5 ", "w2 w3 w4 w5 ", "w1 w2 w3 w4 w5 ", "nothing here", None, "b" * 89, "a" * 91,
]


@pytest.mark.parametrize("few", [10**6, 0])
def test_targets_of_items_of_few_words(spark, tmp_path, monkeypatch, few):
    """Round 4, F1: items of less than seven words met no text, or only where their sixth word ended."""
    docs = spark.createDataFrame([(i, x, "s") for i, x in enumerate(HELD)], "doc_id long, text string, source string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*enumerate(PASSAGES)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(Q, "FEW_CHARS", few)
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("q079_targets", "q173_score_questions", "q174_aggregate_rag"):
        want = con.execute(catalog.SQL[name])
        got = catalog.QUERIES[name](spark, str(tmp_path)).select([c[0] for c in want.description]).collect()
        assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_windows_of_items(spark, monkeypatch):
    """Round 4, F1: each pair once, however texts, windows and slices of items fall."""
    r = random.Random(3)
    monkeypatch.setattr(R, "BITS", 4)
    text = lambda n: "".join(r.choice("ab é") for _ in range(r.randrange(n)))
    for span in (1, 9, 50) * 20:
        monkeypatch.setattr(R, "SPAN", span)
        texts = [text(r.choice([1, 5, 200])).encode() for _ in range(9)]
        items = [text(30).encode() for _ in range(9)] + [x[i : i + r.randrange(40)] for x in texts for i in [r.randrange(len(x) + 1)]]
        at = np.cumsum([0, *map(len, texts)])
        assert sorted(R._Needles(items, b"ab").found(b"".join(texts), at)) == [(i, j) for i, x in enumerate(texts) for j, y in enumerate(items) if y in x]
    monkeypatch.undo()
    monkeypatch.setattr(R, "SLICE_CHARS", 20)
    own, asked = [(i, text(60)) for i in range(40)], [(i, text(6)) for i in range(30)]
    got = R.holding(spark.createDataFrame(own, "id long, text string"), spark.createDataFrame(asked, "query_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [(j, i) for j, y in asked for i, x in own if y in x]
    assert R.holding(spark.createDataFrame(own, "id long, text string"), spark.createDataFrame([], "query_id long, text string")).isEmpty()
