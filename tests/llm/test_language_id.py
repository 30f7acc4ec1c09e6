import zlib

import numpy as np
from cases import clashing, rows, table
from pyspark.sql import functions as F

from sparkloom.llm import language_id as L

SYLLABLES = {"aa": "ka na ra ta sa ma".split(), "bb": "éu öt üz ßi äl".split(), "cc": "что это как для".split()}


def corpus(n):
    r = np.random.default_rng(1)
    langs = sorted(SYLLABLES)
    out = []
    for i in range(n):
        lang = langs[i % 3]
        words = ["".join(r.choice(SYLLABLES[lang], r.integers(1, 4))) for _ in range(r.integers(5, 120))]
        out.append((i, " ".join(words), lang, "s", 1))
    return out


def test_gradients():
    m = L.train(np.zeros((4, 6), np.uint8), np.array([0, 0, 1, 1]), ["a", "b"], steps=1)
    r = np.random.default_rng(0)
    for name in ("inputs", "state", "labels", "bias"):
        setattr(m, name, getattr(m, name).astype(np.float64))
    windows, truth = r.integers(0, 256, (5, 7), dtype=np.uint8), np.array([0, 1, 1, 0, 1])

    def loss():
        byte = windows.T
        k, u = 2 * L.UNITS, L.UNITS
        h = np.zeros((k, 5))
        logits = np.zeros((7, 2, 5)) + m.bias[:, None]
        for t in range(7):
            x = m.inputs[:, byte[t]].copy()
            for i in range(3):
                x[i * k + u : (i + 1) * k] = m.inputs[i * k + u : (i + 1) * k, byte[6 - t]]
            g = m.state @ h
            gate = 0.5 + 0.5 * L._soft(x[: 2 * k] + g[: 2 * k])
            new = L._soft(x[2 * k :] + gate[k:] * g[2 * k :])
            h = new + gate[:k] * (h - new)
            logits[t] += m.labels[:, :u] @ h[:u]
            logits[6 - t] += m.labels[:, u:] @ h[u:]
        p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
        return -np.log(p[:, truth, np.arange(5)]).mean()

    grads = L._gradients(m, windows, truth)
    block = np.kron(np.ones((3, 1)), np.kron(np.eye(2), np.ones((L.UNITS, L.UNITS))))
    for name, grad in grads.items():
        value = getattr(m, name)
        spots = np.argwhere((block > 0) if name == "state" else np.ones(value.shape, bool))
        if name == "inputs":
            spots = spots[np.isin(spots[:, 1], windows)]
        for at in map(tuple, spots[r.choice(len(spots), min(12, len(spots)), replace=False)]):
            old = value[at]
            value[at] = old + 1e-5
            up = loss()
            value[at] = old - 1e-5
            down = loss()
            value[at] = old
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-4, (name, at)


def test_held_out_accuracy_and_whole_texts(spark):
    own = corpus(600) + [(1000, None, "aa", "s", 0), (1001, "", "aa", "s", 0), (1002, "123 !?", "aa", "s", 0), (1003, "kanara ta", None, "s", 0), (None, "что это как", "cc", "s", 1)]
    df = table(spark, own)
    model = L.fit(df)
    assert model.langs == sorted(SYLLABLES)
    out = {r.doc_id: r for r in L.identify(df.drop("lang", "source"), model).withColumn("h", L.held_out()).collect()}
    true = {r[0]: r[2] for r in own}
    tested = [r for r in out.values() if r.h and r.doc_id is not None and r.doc_id < 600]
    assert len(tested) > 150 and np.mean([r.lang_pred == true[r.doc_id] for r in tested]) > 0.97
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out.values() if r.doc_id is not None)
    assert [out[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and out[1002].score == 0
    assert all(0 <= r.score <= 1 for r in out.values()) and out[None].lang_pred == "cc"
    # the end of a long text counts as its start does
    long = [(0, own[0][1] + " " + " ".join(["что это"] * 2000), None, None, 1)]
    assert L.identify(table(spark, long), model).first().lang_pred == "cc"


def test_windows_and_batches_dont_change_results(monkeypatch):
    own = [t.encode() for _, t, *_ in corpus(40)]
    m = L.train(np.random.default_rng(0).integers(0, 255, (8, 32), dtype=np.uint8), np.arange(8) % 3, ["a", "b", "c"], steps=3)
    whole = m.document_probabilities(own)
    monkeypatch.setattr(L, "BATCH", 3)
    assert np.allclose(whole, m.document_probabilities(own), atol=1e-5)
    assert np.allclose(whole, np.concatenate([m.document_probabilities([t]) for t in own]), atol=1e-5)
    # the labels of every position, one by one
    t = own[0]
    p = m.run(np.frombuffer(t.ljust(-(-len(t) // L.WINDOW) * L.WINDOW), np.uint8).reshape(-1, L.WINDOW))
    flat = p.transpose(2, 0, 1).reshape(-1, 3)[: len(t)]
    assert np.allclose(flat.mean(axis=0), whole[0], atol=1e-5)


def test_held_out_documents_never_teach(spark):
    own = corpus(120)
    wrong = [(i, t, "cc" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, s, n) for i, t, lang, s, n in own]
    a, b = L.fit(table(spark, own)), L.fit(table(spark, wrong))
    assert np.array_equal(a.inputs, b.inputs) and np.array_equal(a.labels, b.labels)


def test_edges(spark):
    df = clashing(spark)
    out = L.identify(df, L.fit(df))
    assert out.count() == len(rows()) and out.filter(F.col("score").isNull()).count() == 0
    assert L.identify(table(spark, []), L.fit(table(spark, []))).count() == 0
    none = L.identify(table(spark), None)
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}


def test_own_columns_stay(spark):
    df = clashing(spark)
    out = L.identify(df, None)
    assert set(out.columns) == set(df.columns) and out.filter("__letters = 'mine' and __id = 'mine'").count() == len(rows())


def test_numbers_arent_letters(spark):
    m = L.train(np.random.default_rng(0).integers(0, 255, (8, 32), dtype=np.uint8), np.arange(8) % 3, ["a", "b", "c"], steps=3)
    own = [(i, t, None, None, None) for i, t in enumerate(["½ ²²² Ⅷ", "_", "١٢٣", "ª", "ʰ", "𝒳", "中"])]
    assert [r.lang_pred == "und" for r in L.identify(table(spark, own), m).orderBy("doc_id").collect()] == [True] * 3 + [False] * 4


def test_a_language_of_few_repeated_documents_is_learnt(spark):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1]
    own = corpus(60) + [(ids[0], "zzz yyy xxx " * 20, "zz", "s", 1)] * 4000
    assert "zz" in L.fit(table(spark, own)).langs


def test_run_is_the_network_step_by_step():
    """A scalar forward pass, position by position."""
    r = np.random.default_rng(4)
    m = L.train(r.integers(0, 255, (8, 16), dtype=np.uint8), np.arange(8) % 3, ["a", "b", "c"], steps=3)
    text = r.integers(0, 255, 9, dtype=np.uint8)
    u, k = L.UNITS, 2 * L.UNITS
    squash = lambda x: x / (1 + abs(x))
    state = {}
    for way, at in ((0, range(9)), (1, range(8, -1, -1))):
        h = [0.0] * u
        for t in at:
            x = [[m.inputs[g * k + way * u + i, text[t]] for i in range(u)] for g in range(3)]
            s = [[sum(m.state[g * k + way * u + i, way * u + c] * h[c] for c in range(u)) for i in range(u)] for g in range(3)]
            z, reset = ([0.5 + 0.5 * squash(x[g][i] + s[g][i]) for i in range(u)] for g in (0, 1))
            new = [squash(x[2][i] + reset[i] * s[2][i]) for i in range(u)]
            h = [new[i] + z[i] * (h[i] - new[i]) for i in range(u)]
            state[way, t] = h
    for t in range(9):
        logits = [m.bias[c] + sum(m.labels[c, i] * state[0, t][i] + m.labels[c, u + i] * state[1, t][i] for i in range(u)) for c in range(3)]
        p = np.exp(logits) / np.exp(logits).sum()
        assert np.allclose(m.run(text[None])[t, :, 0], p, atol=1e-5)
