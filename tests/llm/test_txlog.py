import random
import zlib

import numpy as np
import pytest
from cases import clashing
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.llm import txlog as T


def plain(records, per_epoch=16):
    """The log record by record: (undone, states)."""
    order = sorted((r for r in records if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or "", r[4] is not None, r[4] or 0))
    open_, store, undone, states, commits = {}, {}, [], [], 0

    def end(source, by, kind, since=0):
        held = open_.setdefault(source, [])
        undone.extend((c[0], kind, by, c[1]) for c in held[since:] if c is not None)
        del held[since:]

    def close():
        states.append((len(states) + 1, len(store), sum(store.values())))

    for seq, source, kind, key, value in order:
        held = open_.setdefault(source, [])
        if kind == T.CHANGE:
            held.append((seq, key, value))
        elif kind == T.SAVEPOINT:
            held.append(None)
        elif kind == T.ROLLBACK:
            marks = [i for i, c in enumerate(held) if c is None]
            end(source, seq, T.ROLLBACK, marks[-1] + 1 if marks else 0)
        elif kind == T.ABORT:
            end(source, seq, T.ABORT)
        else:
            for c in held:
                if c is not None:
                    store.pop(c[1], None)
                    if c[2] is not None:
                        store[c[1]] = c[2]
            held.clear()
            commits += 1
            if commits % per_epoch == 0:
                close()
    if commits % per_epoch:
        close()
    for source in open_:
        end(source, None, T.END)
    return sorted(undone, key=repr), states


def got(spark, records, parts=6):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        undone, states = T.replay(spark.createDataFrame(records, T.RECORD).repartition(3))
        return sorted(map(tuple, undone.collect()), key=repr), sorted(map(tuple, states.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def made(n, seed, sources, keys, weights=(35, 2, 1, 2, 2)):
    r = random.Random(seed)
    kinds = r.choices(range(5), weights, k=n)
    return [(3 * i - 50, r.choice(sources), k, r.randrange(keys) if k == 0 else None, r.choice([None, *range(1, 9)]) if k == 0 else None) for i, k in enumerate(kinds)]


@pytest.mark.parametrize("seed", range(4))
def test_against_a_plain_replay(spark, seed):
    records = made(1500, seed, ["a", "a", "a", "b", None, ""], 12)
    assert got(spark, records, 3 + 4 * seed) == plain(records)


def test_transactions_longer_than_parts(spark):
    for seed, weights in enumerate([(200, 1, 0, 0, 0), (200, 0, 1, 1, 1), (200, 1, 1, 2, 0), (50, 1, 0, 3, 3), (1, 0, 0, 0, 0)]):
        records = made(600, seed, ["a", "a", "a", "a", "b"], 3, weights)
        assert got(spark, records, 11) == plain(records)


def test_marks_at_the_edges_of_parts(spark):
    # one source, parts of few records: each way in which a transaction goes on in a later part
    for tail in ([T.ROLLBACK, T.COMMIT], [T.SAVEPOINT, T.ROLLBACK, T.COMMIT], [T.ABORT], [T.SAVEPOINT, T.ABORT], [], [T.ROLLBACK], [T.COMMIT, T.ROLLBACK]):
        for lead in ([], [T.SAVEPOINT]):
            kinds = [T.CHANGE] * 4 + lead + [T.CHANGE] * 9 + tail + [T.CHANGE] * 5
            records = [(i, "s", k, i % 3, i) if k == T.CHANGE else (i, "s", k, None, None) for i, k in enumerate(kinds)]
            assert got(spark, records, 7) == plain(records)


def test_empty_logs_epochs_and_ties(spark):
    assert got(spark, []) == ([], [])
    commits = [(i, "s", T.COMMIT, None, None) for i in range(33)]
    assert got(spark, commits) == ([], [(1, 0, 0), (2, 0, 0), (3, 0, 0)])
    tied = [(1, s, T.CHANGE, 5, v) for s in (None, "a", "b") for v in (None, 3, 3, 9)] + [(2, s, T.COMMIT, None, None) for s in (None, "a", "b", "b")] + [(None, "a", T.COMMIT, None, None)]
    assert got(spark, tied) == plain(tied)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 0, 0, 1, 2, 3, 4, 5]), max_size=400))
def test_first_lower_heights(kinds):
    h = T.heights(np.array(kinds, np.int8))
    at = np.flatnonzero(np.array(kinds) == 0)
    want = [next((j for j in range(i + 1, len(h)) if h[j] < h[i]), len(h)) for i in at]
    assert T.first_lower(h, at).tolist() == want


def test_first_lower_over_many_blocks():
    r = np.random.default_rng(1)
    h = r.integers(0, 10**6, 200_000)
    at = r.integers(0, len(h), 300)
    want = [i + 1 + int(np.argmax(np.r_[h[i + 1 :] < h[i], True])) for i in at]
    assert T.first_lower(h, at).tolist() == want


def test_documents_as_records(spark):
    docs = clashing(spark).withColumn("seq", F.lit("mine")).withColumn("value", F.lit("mine")).withColumn("toxic", F.lit(1))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None), (31, 1), (31, 1)], "doc_id long, toxic int")
    want = []
    for r in docs.select("doc_id", "source", "text").collect():
        if r.doc_id is None:
            continue
        h = zlib.crc32(str(r.doc_id).encode())
        kind = [T.COMMIT] * 2 + [T.ABORT] + [T.SAVEPOINT] * 2 + [T.ROLLBACK] * 2
        kind = kind[h % 41] if h % 41 < 7 else T.CHANGE
        key = h // 100 % 3000 if kind == T.CHANGE else None
        lost = key is None or r.text is None or r.doc_id in (1, 31)
        want.append((r.doc_id, r.source, kind, key, None if lost else zlib.crc32(f"{key}:{r.text}".encode())))
    assert sorted(map(tuple, T.records_of(docs, labels).collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_a_plain_replay(spark, sf):
    folder = f"/root/testdata/{sf}"
    records = [tuple(r) for r in T.records_of(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()]
    undone, states = plain(records)
    want = [("rollback" if k == T.ROLLBACK else "abort", i, by, key) for i, k, by, key in undone] + [("state", *s) for s in states]
    assert states and undone
    assert sorted(map(tuple, T.op11_txlog(spark, folder).collect()), key=repr) == sorted(want, key=repr)
