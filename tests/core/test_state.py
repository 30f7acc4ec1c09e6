"""Streams give what their batch forms give; stores keep their promises."""

import time

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import retrieval as R
from sparkloom.operators import telemetry as M
from sparkloom.plans import control as C
from sparkloom.plans import lineage
from sparkloom.sources import stores
from sparkloom.streaming import state as S

DIR = "/root/testdata/sf0.001"


def streamed(spark, df, parts, run, tmp_path, mode):
    """The rows that a query over df gives, split into as many files, one for each batch."""
    path = str(tmp_path / "in")
    for k in range(parts):
        df.filter(F.col("__part") == k).drop("__part").coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    stream = run(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
    name = f"out_{mode}_{abs(hash(str(tmp_path)))}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    assert q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


@pytest.fixture
def events(spark):
    return spark.read.parquet(f"{DIR}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def test_progress(spark, events, tmp_path):
    e = events.select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.floor("value").cast("long").alias("stage"), (F.col("event_type") == "error").alias("terminal"))
    got = streamed(spark, e.withColumn("__part", F.ntile(3).over(__import__("pyspark").sql.Window.orderBy("seq")) - 1), 3, S.progress, tmp_path, "append")
    want = M.progress(e, "job", ["seq"], "stage", F.col("terminal")).select("job", "seq", "stage")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_rate_limits(spark, events, tmp_path):
    hits = events.select(F.col("user_id").alias("key"), F.unix_micros("ts").alias("t"))
    part = F.ntile(2).over(__import__("pyspark").sql.Window.orderBy("t")) - 1
    got = streamed(spark, hits.withColumn("__part", part), 2, lambda df: S.rate_limits(df, 36000, 2), tmp_path, "update")
    most = {}
    for r in got.collect():
        most[r.key] = max(most.get(r.key, (0, 0)), (r.hits, r.allowed))
    want = M.first_hit_windows(events, "user_id", "ts", 36000, 2)
    assert most == {r.user_id: (r.hits, r.allowed) for r in want.collect()}


def test_windows(spark, events, tmp_path):
    hits = events.select(F.col("user_id").alias("key"), "ts").withColumn("__part", F.lit(0))
    got = streamed(spark, hits, 1, lambda df: S.aligned_limits(df, 3600), tmp_path, "complete")
    want = M.aligned_windows(events, "user_id", "ts", 3600, 2).select("user_id", "window", "hits")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    (tmp_path / "b").mkdir()
    spend = events.select(F.col("event_type").alias("unit"), "ts", F.col("value").alias("amount")).withColumn("__part", F.lit(0))
    days = streamed(spark, spend, 1, S.daily_budget, tmp_path / "b", "complete")
    assert {(r.unit, str(r.day)): round(r.spent, 4) for r in days.collect()} == {(r.event_type, str(r.day)): round(r.s, 4) for r in events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("s")).collect()}


def test_vector_store(spark, tmp_path):
    s = stores.VectorStore(spark, str(tmp_path / "v"), 2)
    row = lambda *r: spark.createDataFrame(list(r), "id string, vector array<double>, file string").coalesce(1)
    assert s.count("a/1") == 0
    s.upsert("a/1", row(("x", [1.0, 0.0], "f"), ("y", [0.0, 1.0], "g"), ("x", [0.5, 0.5], "f")))
    s.upsert("b", row(("x", [9.0, 9.0], "f")))
    s.upsert("a/1", row(("y", [2.0, 2.0], "g")))
    assert {r.id: r.vector for r in s.read("a/1").collect()} == {"x": [0.5, 0.5], "y": [2.0, 2.0]} and s.count("b") == 1
    with pytest.raises(Exception, match="dimension"):
        s.upsert("a/1", row(("z", [1.0], "f")))
    s.drop("a/1")
    assert s.count("a/1") == 0 and s.count("b") == 1


def test_store_selection(spark, tmp_path):
    v, t, notices = stores.open_stores(spark, None, str(tmp_path / "f"), 2)
    assert notices == ["store-not-configured"] and v.path.startswith(str(tmp_path / "f"))
    v, t, notices = stores.open_stores(spark, str(tmp_path / "own"), str(tmp_path / "f"), 2)
    assert notices == [] and t.path.startswith(str(tmp_path / "own"))
    (tmp_path / "file").write_text("x")
    v, t, notices = stores.open_stores(spark, str(tmp_path / "file" / "below"), str(tmp_path / "f"), 2)
    assert notices and v.path.startswith(str(tmp_path / "f"))


def test_other_stores(spark, tmp_path):
    t = stores.TextStore(spark, str(tmp_path / "t"))
    ids = spark.createDataFrame([("a",), ("z",)], "id string")
    assert t.get(ids).count() == 0
    t.put(spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string"))
    assert [tuple(r) for r in t.get(ids).collect()] == [("a", "x")]
    t.put(spark.createDataFrame([("a", "new")], "id string, text string"))
    t.put(spark.createDataFrame([("a", "other")], "id string, text string"), "space")
    assert [tuple(r) for r in t.get(ids).collect()] == [("a", "new")] and [tuple(r) for r in t.get(ids, "space").collect()] == [("a", "other")]
    t.compact("default")
    assert [tuple(r) for r in t.get(ids).collect()] == [("a", "new")] and t._rows("default").count() == t.count("default") == 2 and t.count("space") == 1
    c = stores.AnalysisCache(spark, str(tmp_path / "c"))
    rows = spark.sql("select 'r' as repo, string(id % 3) as sha, 1 as version, timestamp '2024-01-01' + make_interval(0, 0, 0, int(id)) as indexed_at, 'x' as result from range(5)")
    assert c.save(rows) == 3 and c.save(rows) == 0 and c.latest(2).count() == 2
    p = stores.pricing(spark.createDataFrame([('{"m": {"input": 1, "output": 2}, "bad": {"input": -1, "output": 2}, "none": {"input": 1}, "text": {"input": "x", "output": 2}, "no": 3}',), ("[1]",), ("{",), (None,)], "json string"))
    assert [tuple(r) for r in p.collect()] == [("m", 1.0, 2.0)]
    q = spark.createDataFrame([("1", "q", ["f"]), ("1", " ", None)], "id string, question string, expected_files array<string>")
    assert sorted(r.rule for r in stores.dataset_violations(q).collect()) == ["duplicate-id", "empty-question", "no-expectation"]
    stores.export_trace(spark.createDataFrame([(1, "a")], "span int, kind string"), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first().kind == "a"

    def refuses(spans):
        raise OSError("no")

    told = []
    assert stores.export_traces(c.read(), {"lines": lambda df: stores.export_trace(df, str(tmp_path / "u")), "broken": refuses, "count": lambda df: told.append(df.count())}) == {"lines": "ok", "broken": "failed: OSError", "count": "ok"}
    assert told == [3] and spark.read.json(str(tmp_path / "u")).count() == 3


def test_mmr_and_vectors(spark):
    alike = R.likeness(["x", "x", "y"], [None] * 3)
    assert R.mmr_order([1.0, 0.9, 0.8], ["a", "b", "c"], alike, 3, 0.7) == [0, 2, 1]
    assert R.mmr_order([1.0, 1.0], ["b", "a"], alike[:2, :2], 1, 1.0) == [1] and R.mmr_order([1.0], ["a"], alike[:1, :1], 0, 0.7) == []
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.6, 0.8])], "id long, v array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, v array<double>")
    assert [(r.id, r.score) for r in R.vector_topk(v, q, 5).orderBy("rank").collect()] == [(1, 1.0), (3, 0.6), (2, 0.0)]
    assert R.vector_topk(v, q, 5, files=[]).count() == 0 and [r.id for r in R.vector_topk(v, q, 5, files=[3]).collect()] == [3]
    with pytest.raises(Exception, match="dimension"):
        R.vector_topk(v, spark.createDataFrame([(7, [1.0])], "query_id long, v array<double>"), 5).collect()


def test_layers_and_status(spark):
    nodes = spark.createDataFrame([("g", s) for s in C.STAGES], "group string, node string")
    edges = spark.createDataFrame([("g", b, s) for s, reads in C.STAGES.items() for b in reads], "group string, before string, node string")
    got = {r.node: r.layer for r in C.layers(nodes, edges).collect()}
    assert got == {"ingest": 0, "orient": 1, "map": 1, "inventory": 2, "connect": 3, "rag": 3, "analyze": 4, "synthesize": 5}
    ring = spark.createDataFrame([("g", "a", "b"), ("g", "b", "a")], "group string, before string, node string")
    assert C.layers(spark.createDataFrame([("g", "a"), ("g", "b"), ("g", "c")], "group string, node string"), ring).count() == 1


def test_what_is_kept_follows_the_files(spark, tmp_path):
    from pathlib import Path

    path, made = str(tmp_path / "t"), []
    make = lambda: made.append(spark.read.parquet(path).count()) or made[-1]
    spark.range(3).write.parquet(path)
    assert (lineage.kept(spark, path, "n", make), lineage.kept(spark, path, "n", make), len(made)) == (3, 3, 1)
    spark.range(4).write.mode("append").parquet(path)
    assert (lineage.kept(spark, path, "n", make), len(made)) == (7, 2)
    assert Path(path).is_dir()


def test_idle_keys_are_forgotten(spark, tmp_path):
    path, rows = str(tmp_path / "in"), "key long, t long"
    spark.createDataFrame([(1, 0)], rows).coalesce(1).write.parquet(path)
    stream = S.rate_limits(spark.readStream.schema(rows).parquet(path), 1, 1, idle=1)
    q = stream.writeStream.format("memory").queryName("idle_keys").outputMode("update").trigger(processingTime="1 second").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(60):
            if q.lastProgress and q.lastProgress["stateOperators"] and q.lastProgress["stateOperators"][0]["numRowsRemoved"]:
                break
            time.sleep(1)
        spark.createDataFrame([(1, 10**9)], rows).coalesce(1).write.mode("append").parquet(path)
        for _ in range(60):
            if spark.table("idle_keys").count() > 1:
                break
            time.sleep(1)
    finally:
        q.stop()
    assert [tuple(r) for r in spark.table("idle_keys").collect()] == [(1, 1, 1), (1, 1, 1)]  # counted from the start again
