import random

import numpy as np
from cases import clashing, edited, prose, rows, table

from sparkloom.llm import decontamination as D

ITEMS = "item_id long, text string"


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_align_is_smith_waterman():
    r = np.random.default_rng(0)
    for _ in range(40):
        windows, item = r.integers(0, 5, (4, 20)), r.integers(1, 5, 9)
        assert D.align(windows, item).tolist() == [smith_waterman(w, item) for w in windows]


def test_exact_edited_and_clean(spark):
    r = random.Random(5)
    passages = [" ".join(r.choices("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split(), k=r.randrange(16, 50))) for _ in range(12)]
    items = spark.createDataFrame([*enumerate(passages), (90, None), (91, ""), (92, "..."), (93, "alpha"), (0, passages[0])], ITEMS)
    own, want = [(i, prose(i, 400), "en", "s", 1) for i in range(200)], set()
    for k, p in enumerate(passages):
        own.append((1000 + k, f"{prose(k, 60)} {p.upper()}, {prose(k + 7, 60)}", "en", "s", 1))
        own.append((2000 + k, f"{prose(k + 3, 200)}\n{edited(p, k, len(p.split()) // 6)} end", "en", "s", 1))
        words = p.split()
        own.append((3000 + k, prose(k + 9, 90) + " " + " ".join(words[: len(words) // 2] + ["very", "much"] + words[len(words) // 2 :]), "en", "s", 1))
        want |= {(j * 1000 + k, k) for j in (1, 2, 3)}
    got = D.contaminated(table(spark, own), items).collect()
    pairs = {(x.doc_id, x.item_id) for x in got}
    assert pairs - {(d, 93) for d, _ in pairs} == want
    for x in got:
        if x.item_id != 93:
            text = next(t for i, t, *_ in own if i == x.doc_id)
            assert x.score == smith_waterman(D.words_of(text), D.words_of(passages[x.item_id]))
    assert all(x.score >= D.least_score(x.item_words) and abs(x.similarity - x.score / x.item_words) < 1e-12 for x in got)


def test_items_in_slices_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(i, prose(i, 30)) for i in range(20)], ITEMS)
    docs = table(spark, [(i, prose(i, 30) + " more", "en", "s", 1) for i in range(0, 40, 2)])
    whole = sorted(map(tuple, D.contaminated(docs, items).collect()))
    monkeypatch.setattr(D, "SLICE_CHARS", 500)
    assert sorted(map(tuple, D.contaminated(docs, items).collect())) == whole and len(whole) >= 10


def test_edges(spark):
    items = spark.createDataFrame([(1, prose(1, 40)), (2, None)], ITEMS)
    assert {(r.doc_id, r.item_id) for r in D.contaminated(clashing(spark), items).collect()} >= {(1, 1), (12, 1), (13, 1)}
    assert D.contaminated(table(spark, []), items).count() == 0
    assert D.contaminated(table(spark), spark.createDataFrame([], ITEMS)).count() == 0
    common = spark.createDataFrame([(1, prose(0, 60))], ITEMS)
    many = table(spark, [(i, prose(0, 60), "en", "s", 1) for i in range(300)])
    assert D.contaminated(many, common).count() == 300
    assert len(rows()) > 0


def test_windows_dont_pile_up(spark, monkeypatch):
    """A passage in very many places: results are the same however few windows may wait."""
    item = " ".join(prose(7, 30).split())
    items = spark.createDataFrame([(1, item)], ITEMS)
    own = [(i, " . ".join([item] * 40), "en", "s", 1) for i in range(20)]
    whole = sorted(map(tuple, D.contaminated(table(spark, own), items).collect()))
    monkeypatch.setattr(D, "HELD_WORDS", 100)
    assert whole == sorted(map(tuple, D.contaminated(table(spark, own), items).collect())) and len(whole) == 20


def test_query_against_all_alignments(spark):
    """Each document of the smallest tables aligned with each item as a whole, without seeds."""
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, D.words_of(r.text or "")) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    tests = [(r.item_id, D.words_of(r.text or "")) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    number = {w: i + 1 for i, w in enumerate({w for _, own in tests for w in own})}
    coded = [(i, np.array([number.get(w, 0) for w in own], np.int64)) for i, own in docs]
    want = {}
    for item, own in tests:
        code = np.array([number[w] for w in own], np.int64)
        for at in range(0, len(coded), 32):
            part = coded[at : at + 32]
            windows = np.full((len(part), max(len(c) for _, c in part)), -1, np.int64)
            for row, (_, c) in enumerate(part):
                windows[row, : len(c)] = c
            for (doc, _), s in zip(part, D.align(windows, code).tolist(), strict=True):
                if own and s >= D.least_score(len(own)):
                    want[doc, item] = max(want.get((doc, item), 0), s)
    got = {(r.doc_id, r.item_id): r.score for r in D.op3_decontamination(spark, folder).collect()}
    assert got == want and got
