import itertools
import random
import zlib

from cases import clashing, prose, rows, table
from pyspark.sql import functions as F

from sparkloom.llm import resharding as R
from sparkloom.llm.resharding import even, min_cost_flow, reshard, rewrite, solve


def cost(flow, c):
    return sum(f * c(i, j) for i, r in enumerate(flow) for j, f in enumerate(r))


def test_flow_is_feasible_and_least():
    r = random.Random(1)
    for _ in range(30):
        supply = [r.randrange(4) for _ in range(3)]
        capacity = even(sum(supply) + r.randrange(2), 3)
        prices = [[r.randrange(3) for _ in range(3)] for _ in range(3)]
        flow = min_cost_flow(supply, capacity, lambda i, j: prices[i][j])
        assert [sum(x) for x in flow] == supply and all(sum(f[j] for f in flow) <= capacity[j] for j in range(3))
        units = [i for i, n in enumerate(supply) for _ in range(n)]
        best = min(sum(prices[i][j] for i, j in zip(units, to, strict=True)) for to in itertools.product(range(3), repeat=len(units)) if all(to.count(j) <= capacity[j] for j in range(3)))
        assert cost(flow, lambda i, j: prices[i][j]) == best


def test_plan(spark):
    own = [(i, prose(i, 5 + i % 40 + (900 if i % 150 == 0 else 0)), "en", "s", 1) for i in range(3000)] + [(None, None, None, None, None), (5, "twice", None, None, 5), (5, "twice", None, None, 5)]
    got = reshard(table(spark, own)).collect()
    assert len(got) == len(own)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(r[0]), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in own)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    sizes = {k: sum(r.size for r in v) for k, v in by.items()}
    assert set(by) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= max(r.size for r in got)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    total = sum(sizes.values())
    held = [sum(r.size for r in got if r.old_shard == i) for i in range(6)]
    least = sum(max(0, h - total / 8) for h in held)
    moved = sum(r.size for r in got if r.old_shard != r.shard)
    assert moved <= least + 16 * max(r.size for r in got)


def test_rewrite_touches_changed_shards_only(spark, tmp_path):
    own = [(i, "same", None, None, 4) for i in range(160)]
    docs = table(spark, own)
    shard = F.when(F.col("doc_id") < 60, 0).when(F.col("doc_id") < 100, 1).when(F.col("doc_id") < 140, 2).otherwise(3)
    solved = solve(docs, 4, 4, shard)
    plan = reshard(docs, old_shard=shard, plan=solved)
    changed = rewrite(docs, solved, str(tmp_path / "out"))
    assert changed == [0, 3]
    back = spark.read.parquet(str(tmp_path / "out"))
    want = {(r.doc_id, r.shard, r.slot) for r in plan.collect() if r.shard in changed}
    assert {(r.doc_id, r.shard, r.slot) for r in back.collect()} == want and len(want) == 80


def test_rewrite_keeps_every_row_and_the_layout(spark, tmp_path):
    own = [(i, "same", "en", None, 4) for i in range(150)] + [(None, "same", "en", None, 4)] * 5 + [(3, "same", "en", None, 4), (3, "same", "fr", None, 4), (3, "more", None, None, 4), (None, None, None, None, None), (None, "a", None, None, 1)]
    shard = F.when(F.coalesce("doc_id", F.lit(0)) < 60, 0).when(F.col("doc_id") < 97, 1).when(F.col("doc_id") < 134, 2).otherwise(3)
    path, docs = str(tmp_path / "out"), table(spark, own)
    docs.withColumn("shard", shard).withColumn("slot", F.lit(0).cast("long")).write.partitionBy("shard").parquet(path)
    docs = spark.createDataFrame(own, docs.schema)
    every = sorted(own, key=str)
    for shards, old in ((4, 4), (2, 4)):
        solved = solve(docs, shards, old, shard)
        plan = reshard(docs, old_shard=shard, plan=solved)
        changed = rewrite(docs, solved, path)
        back = spark.read.parquet(path)
        assert sorted((tuple(r) for r in back.select(docs.columns).collect()), key=str) == every
        assert {r[0] for r in back.select("shard").distinct().collect()} == {r[0] for r in plan.select("shard").distinct().collect()}
        assert set(changed) <= set(range(4))
        for s in changed:
            rows_of = lambda df: sorted((str(r.doc_id), r.slot) for r in df.filter(F.col("shard") == s).collect())  # noqa: B023, E731
            assert rows_of(back) == rows_of(plan)
        docs.withColumn("shard", shard).withColumn("slot", F.lit(0).cast("long")).write.mode("overwrite").partitionBy("shard").parquet(path)


def test_rewrite_in_place_and_again(spark, tmp_path):
    """The layout is read and rewritten where it stands; what is left alone keeps its files."""
    path = str(tmp_path / "layout")
    own = [(i, prose(i, 3 + i % 9), "en", None, 4) for i in range(200)]
    at = F.when(F.col("doc_id") < 50, 0).when(F.col("doc_id") < 100, 1).otherwise(2)
    table(spark, own).withColumn("shard", at).withColumn("slot", F.lit(0).cast("long")).write.partitionBy("shard").parquet(path)
    for shards, old in ((4, 3), (4, 4), (2, 4)):
        held = {f.name: {g.name for g in f.glob("*.parquet")} for f in (tmp_path / "layout").glob("shard=*")}
        docs = spark.read.parquet(path)
        solved = solve(docs, shards, old, F.col("shard"))
        want = sorted((r.doc_id, r.shard, r.slot) for r in reshard(docs, old_shard=F.col("shard"), plan=solved).collect())
        changed = rewrite(docs, solved, path)
        back = spark.read.parquet(path)
        assert sorted(r.doc_id for r in back.collect()) == list(range(200)) and back.filter("text is null").isEmpty()
        assert [(r.doc_id, r.shard) for r in back.orderBy("doc_id").collect()] == [w[:2] for w in want]
        assert all(r in want for r in [(r.doc_id, r.shard, r.slot) for r in back.collect()] if r[1] in changed)
        for f in (tmp_path / "layout").glob("shard=*"):
            if int(f.name[6:]) not in changed:
                assert {g.name for g in f.glob("*.parquet")} == held[f.name]
    assert {r[0] for r in spark.read.parquet(path).select("shard").distinct().collect()} == {0, 1}


def test_rows_go_as_by_brute_force(spark, monkeypatch):
    """The assignment, row by row in plain Python, for whole classes and for classes in parts."""
    own = [(i, prose(i, 1 + i % 30 + (500 if i % 90 == 0 else 0)), "en", "s", 1) for i in range(700)] + [(None, "no id", None, None, 1)] * 3 + [(5, "twice", None, None, 5)] * 4 + [(9, None, None, None, None)]
    for rows_of_part in (10**6, 20):
        monkeypatch.setattr(R, "PART_ROWS", rows_of_part)
        docs = table(spark, own)
        keys = R._measured(docs, F.pmod(F.xxhash64("doc_id"), F.lit(6))).select("doc_id", "__size", "__crc", "__old", "__class", "__order").collect()
        n = {}
        for r in keys:
            n[r["__old"], r["__class"]] = n.get((r["__old"], r["__class"]), 0) + 1
        none_first = lambda x: (x is not None, x or 0)
        in_order = sorted((r["__old"], r["__class"], r["__order"] % -(-n[r["__old"], r["__class"]] // rows_of_part), -r["__size"], r["__order"], none_first(r["doc_id"]), r["__crc"]) for r in keys)
        supply = [sum(-r[3] for r in in_order if r[0] == i) for i in range(6)]
        flow = min_cost_flow(supply, even(sum(supply), 8), lambda i, j: int(i != j))
        at, want = [0] * 6, []
        for r in in_order:
            middle, first, shard = at[r[0]] + -r[3] // 2, 0, None
            for j in [r[0], *(j for j in range(8) if j != r[0])]:
                if flow[r[0]][j]:
                    shard = j if middle >= first else shard
                    first += flow[r[0]][j]
            at[r[0]] -= r[3]
            want.append((shard, r))
        want = [(shard, k, r[5][1] if r[5][0] else None, -r[3]) for shard in range(8) for k, r in enumerate(r for s, r in sorted(want) if s == shard)]
        got = [(r.shard, r.slot, r.doc_id, r.size) for r in reshard(docs).orderBy("shard", "slot").collect()]
        assert got == want


def test_edges(spark):
    assert reshard(clashing(spark)).count() == len(rows())
    assert reshard(table(spark, [])).count() == 0
    one = reshard(table(spark, [(1, "a", None, None, 1)])).collect()
    assert len(one) == 1 and one[0].slot == 0
