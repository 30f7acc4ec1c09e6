"""Recorded runs, sessions and boards against plain Python, in batches and as a stream with expiry, late and broken rows."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import agentops as A
from sparkloom.operators import recorded as V
from sparkloom.plans import registry as X
from sparkloom.streaming import state as S

TOOLS = ["search", "callers"]
SESSION = "session long, seq long, ts timestamp, analysis string, answer string, chunks array<string>, entities array<struct<kind: string, value: string>>"
DAY = dt.datetime(2024, 1, 1)


def machine(replies, results):
    """One run, reply by reply: (turns, calls, failures, stop, kept, dropped, offered)."""
    calls = failures = 0
    spent, chunks, files, offered, kept, dropped, stop = {}, set(), set(), [], [], [], None
    for turn, text in replies[:6]:
        forced = turn == 6 or calls >= 3
        offered.append(0 if forced else sum(spent.get(t, 0) < 2 for t in TOOLS))
        try:
            x = json.loads(text[text.index("{") : text.rindex("}") + 1])
            kind = x.get("action")
        except (ValueError, AttributeError):
            x, kind = {}, None
        if kind == "tool" and x.get("tool"):
            if forced:
                continue
            calls += 1
            if x["tool"] in TOOLS:
                empty, c, f = results.get(turn, (False, [], []))
                spent[x["tool"]] = spent.get(x["tool"], 0) + empty
                chunks |= set(c)
                files |= set(f)
        elif kind == "answer":
            cc, cf = x.get("citedChunkIds", []), x.get("citedFileIds", [])
            kept = sorted({c for c in cc if c in chunks} | {f for f in cf if f in files})
            dropped = sorted({c for c in cc if c not in chunks} | {f for f in cf if f not in files})
            stop = "answered" if x.get("answered") and x.get("answer") and kept else "refused"
            break
        else:
            failures += 1
            if failures > 2:
                stop = "parse-failure"
                break
    return len(offered), calls, failures, stop or ("tool-call-limit" if calls >= 3 else "turn-limit"), kept, dropped, offered


def test_runs_against_a_plain_machine(spark):
    r = random.Random(6)
    turns, results, want = [], [], {}
    for run in range(300):
        replies, gave = [], {}
        for turn in range(1, r.choice([1, 3, 6, 9]) + 1):
            kind = r.choice(["bad", "tool", "tool", "tool", "tool", "answer"])
            if kind == "bad":
                text = r.choice(["", "no", "{", '{"action":"sing"}', '{"action":"tool"}', "{]}", '{"action":"tool","tool":""}'])
            elif kind == "tool":
                text = "well " * r.randrange(2) + json.dumps({"action": "tool", "tool": r.choice([*TOOLS, "search", "none"]), "args": {"q": '}"{'}})
            else:
                cites = {"citedChunkIds": r.sample(["c1", "c2", "c3", "x"], 2), "citedFileIds": r.sample(["f1", "f2"], 1)}
                text = json.dumps({"action": "answer", "answer": r.choice(["", "yes", "yes"]), "answered": r.random() < 0.8, **r.choice([cites, cites, {}])}) + r.choice(["", " ok"])
            replies.append((turn, text))
            if r.random() < 0.8:
                gave[turn] = (r.random() < 0.5, r.sample(["c1", "c2", "c3"], 1), r.sample(["f1", "f2"], r.randrange(2)))
        turns += [(run, *x) for x in replies]
        results += [(run, t, *x) for t, x in gave.items()]
        want[run] = machine(replies, gave)
    t = spark.createDataFrame(turns, "run long, turn int, text string").repartition(4)
    g = spark.createDataFrame(results, "run long, turn int, empty boolean, chunks array<string>, files array<string>")
    got = {x.run: (x.turns, x.calls, x.failures, x.stop, sorted(set(x.kept)), sorted(x.dropped), [y.offered for y in x.trace]) for x in V.replay(t, g, TOOLS, most_calls=3).collect()}
    assert got == want and {x[3] for x in want.values()} == {"answered", "refused", "parse-failure", "tool-call-limit", "turn-limit"}
    assert V.replay(t.limit(0), g, TOOLS).count() == 0


def turn_rows(seed=2):
    r = random.Random(seed)
    rows = []
    for s in range(25):
        t = DAY + dt.timedelta(hours=r.randrange(40))
        for k in range(r.choice([1, 5, 60])):
            t += dt.timedelta(minutes=r.choice([0, 1, 30, 30, 1500]) if k % 7 == 6 else 5)
            entities = [(r.choice("fs"), f"e{r.randrange(40)}") for _ in range(r.randrange(3))]
            rows.append((s, k, t, r.choice(["a"] * 30 + ["b"]), r.choice(["short", "x" * 601, "😀" * 400, None, "y" * 600]), [f"c{r.randrange(300)}" for _ in range(r.randrange(9))], entities))
    return rows + [(None, 1, DAY, "a", "x", [], []), (3, 900, None, "a", "x", [], []), (4, 901, DAY, None, "x", ["bad"], [])]


def folded(rows):
    states = {}
    for s, k, t, a, answer, chunks, entities in sorted((r for r in rows if None not in (r[0], r[2], r[3])), key=lambda r: (r[0], r[2], r[1])):
        micros = int((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
        states[s] = S.append_turn(states.get(s, S.remembered(None)), micros, a, answer, chunks, [{"kind": x, "value": v} for x, v in entities])
    return states


def test_sessions_against_a_fold(spark):
    rows = turn_rows()
    now = DAY + dt.timedelta(hours=62)
    micros = int((now - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
    want = {s: x for s, x in folded(rows).items() if micros - x["seen"] < 86_400 * 10**6}
    got = V.sessions(spark.createDataFrame(rows, SESSION).repartition(5), F.lit(now)).collect()
    assert 0 < len(want) < 25 and {x.session for x in got} == set(want)
    for x in got:
        w = want[x.session]
        assert x.analysis == w["analysis"] and [[t.turn, t.answer] for t in x.turns] == w["turns"]
        assert [[e.kind, e.value, e.turn] for e in x.entities] == w["entities"] and list(x.chunks) == w["chunks"]
    assert max(len(w["turns"]) for w in want.values()) == 8 and max(len(w["entities"]) for w in want.values()) == 20
    assert V.sessions(spark.createDataFrame([], SESSION), F.lit(now)).count() == 0


def test_bounds_and_broken_state():
    now = S.remembered("{broken")
    assert now == S.remembered(None) == S.remembered("[]") == S.remembered('{"turns": 3}')
    for k in range(300):
        now = S.append_turn(now, k, "a", "z" * 700, [f"c{k}", "again"], [{"kind": "f", "value": str(k)}])
    assert len(now["turns"]) == 8 and now["turns"][-1] == [300, "z" * 599 + "…"] and len(now["chunks"]) == 200 and now["chunks"][-1] == "again" and [e[1] for e in now["entities"]] == [str(k) for k in range(299, 279, -1)]
    assert S.remembered(json.dumps(now)) == json.loads(json.dumps(now))
    assert S.append_turn(now, 300, "b", "", [], [])["turns"] == [[1, ""]]
    assert S.append_turn(now, 299 + 86_400 * 10**6, "a", "", [], [])["last"] == 1 and S.append_turn(now, 298 + 86_400 * 10**6, "a", "", [], [])["last"] == 301


def test_stream_with_expiry_late_and_broken_rows(spark, tmp_path):
    hour = lambda h: DAY + dt.timedelta(hours=h)
    batches = [
        [(1, 1, hour(0), "a", "one", ["c1"], [("f", "x")]), (2, 1, hour(0), "a", "one", [], [])],
        [(1, 2, hour(1), "a", "two", ["c2", "c1"], [("f", "y"), ("f", "x")]), (1, None, hour(1), None, "broken", [], []), (None, 1, hour(1), "a", "broken", [], [])],
        [(3, 1, hour(40), "a", "moves the clock", [], [])],
        [(3, 2, hour(41), "a", "timers of 1 and 2 fire", [], [])],
        [(1, 3, hour(41), "a", "anew", [], []), (2, 2, hour(2), "a", "too late", [], [])],
        [(1, 4, hour(42), "b", "another analysis", [], [])],
    ]
    path = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, SESSION).coalesce(1).write.mode("append").parquet(path)
    stream = S.sessions(spark.readStream.schema(spark.createDataFrame([], SESSION).schema).option("maxFilesPerTrigger", 1).parquet(path))
    q = stream.writeStream.format("memory").queryName("recorded_sessions").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    assert q.awaitTermination(180)
    assert q.exception() is None
    got = [(x.session, x.analysis, list(x.turns), list(x.answers), list(x.entities), list(x.chunks)) for x in spark.table("recorded_sessions").collect()]
    assert [g for g in got if g[0] == 2] == [(2, "a", [1], ["one"], [], [])]
    assert [g for g in got if g[0] == 1] == [
        (1, "a", [1], ["one"], ["x"], ["c1"]), (1, "a", [1, 2], ["one", "two"], ["y", "x"], ["c2", "c1"]), (1, "a", [1], ["anew"], [], []), (1, "b", [1], ["another analysis"], [], []),
    ]


@pytest.mark.parametrize("most", [3, 50])
def test_boards_against_a_log(spark, most):
    r = random.Random(most)
    writes = [(b, r.randrange(30), k, r.choice("wv"), f"why{k}", r.choice([None, k])) for b in range(8) for k in range(r.randrange(1, 9))]
    reads = [(b, r.randrange(-3, 33), k, r.choice("pq"), r.choice([None, "note"])) for b in range(9) for k in range(r.randrange(7))]
    w = spark.createDataFrame(writes, "board long, at int, seq long, writer string, reason string, state int").repartition(3)
    d = spark.createDataFrame(reads, "board long, at int, seq long, reader string, note string").repartition(3)
    log = {b: sorted((x for x in writes if x[0] == b), key=lambda x: (x[1], x[2])) for b in range(9)}
    want = []
    for b, at, seq, reader, note in reads:
        n = sum(x[1] <= at for x in log[b])
        want.append((b, at, seq, reader, note, n, log[b][n - 1][5] if n and n > len(log[b]) - most else None))
    assert sorted(map(tuple, V.as_of(w, d, most).collect()), key=str) == sorted(want, key=str)
    kept = {(x.board, x.version): (x.writer, x.state, x.trimmed_before, x.total) for x in V.versions(w, most).collect()}
    assert kept == {(b, k + 1): (x[3], x[5], max(len(own) - most, 0) + 1, len(own)) for b, own in log.items() for k, x in enumerate(own) if k >= len(own) - most}
    lines = {x.board: x.history.split("\n") for x in V.history(w, d, most).collect()}
    assert set(lines) == {b for b in log if log[b]}
    for b, own in lines.items():
        n = sum(x[0] == b for x in reads)
        assert own[0] == f"{len(log[b])} writes, {n} reads" + (f", versions before {len(log[b]) - most + 1} trimmed" if len(log[b]) > most else "")
        assert sum("read by" in x for x in own) == sum(x[0] == b and x[5] > len(log[b]) - most and x[5] > 0 for x in want)


def test_any_scorer_decides(spark):
    c = spark.createDataFrame([(1, 1, 1.0, 1.0, 1.0, 0.1), (1, 2, 0.0, 0.0, 0.0, 0.9)], "task long, candidate long, grounding double, coverage double, substance double, other double")
    r = X.defaults()
    r.scorers["other"] = lambda: F.col("other")
    assert [X.hybrid_scorer(c, r, s, ["task"]).first().candidate for s in ("grounding", "other")] == [1, 2] and A.best_of(c, ["task"]).first().candidate == 1
