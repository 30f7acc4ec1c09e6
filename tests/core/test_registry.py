import pytest
from pyspark.sql import functions as F

from sparkloom.plans import registry as X


def test_defaults_and_additions(spark):
    r = X.defaults()
    files = spark.createDataFrame([("a.ts", "export class A {}"), ("b.py", "x = 1"), ("c.zz", "class C {}")], "path string, content string")
    r.parsers[".py"] = lambda lines: lines.select("path", F.lit("module").alias("kind"))
    got = r.parse(files)
    assert got[".ts"].first().name == "A" and got[".py"].first().kind == "module" and ".zz" not in got
    edges = spark.createDataFrame([(1, 2, "call"), (3, 2, "import")], "src long, dst long, kind string")
    assert r.tools["callers"]({"edges": edges}, 2).count() == 1 and r.tools["references"]({"edges": edges}, 2).count() == 2
    c = spark.createDataFrame([(1, 1, 0.2, 0.2, 0.2), (1, 2, 0.9, 0.1, 0.1)], "g long, candidate long, grounding double, coverage double, substance double")
    assert X.hybrid_scorer(c, r, "grounding", ["g"]).first().candidate == 2


def test_stages(spark):
    r = X.Registry(stages=[("one", lambda t: {"b": t["a"].filter("id > 0")}), ("two", lambda t: {"c": t["b"].filter("id > 1")})])
    assert r.run({"a": spark.range(4)})["c"].count() == 2
    r.stages.append(("three", lambda t: {"b": t["a"]}))
    with pytest.raises(ValueError, match="three"):
        r.run({"a": spark.range(4)})


def test_cross_encoder(spark):
    q = spark.createDataFrame([(1, "x")], "query_id long, text string")
    chunks = spark.createDataFrame([(i, "y" * i) for i in range(1, 40)], "id long, text string")
    cand = chunks.select(F.lit(1).cast("long").alias("query_id"), "id")
    out = X.cross_encoder("length", lambda qs, ts: [float(min(len(t), 20)) for t in ts], most_chars=30)(cand, q, chunks)
    assert [r.id for r in out.orderBy("rank").limit(3).collect()] == [20, 21, 22]
    with pytest.raises(Exception, match="returned 0 scores"):
        X.cross_encoder("none", lambda qs, ts: [])(cand, q, chunks).collect()


def test_udtf(spark):
    X.register_parser_udtf(spark)
    spark.createDataFrame([("a.py", "import os\nclass A:\n    def f(self): pass\n"), ("n.py", None)], "path string, content string").createOrReplaceTempView("sources")
    rows = spark.sql("select s.path, f.kind, f.name from sources s, lateral python_facts(s.path, s.content) f").collect()
    assert {tuple(r) for r in rows} == {("a.py", "import", "os"), ("a.py", "class", "A"), ("a.py", "method", "f")}
