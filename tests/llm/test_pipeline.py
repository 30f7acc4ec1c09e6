import zlib

import corpus_pipeline as P
import numpy as np
from cases import clashing, edited, prose, rows, table

from sparkloom.llm.packing import _encoder


def corpus(spark, tmp_path):
    shared = "This very line of a licence stands in a great many documents."
    item = prose(777, 40).replace("\n", " ")
    own = [(i, f"{prose(i, 200)}\n{shared}", "en", "s", 1) for i in range(12)]
    own += [(100, own[3][1], "en", "s", 1), (101, f"{edited(prose(4, 200), 1, 3)}\n{shared}", "en", "s", 1), (102, prose(60, 100) + " " + item + " " + prose(61, 50), "en", "s", 1), (103, "1234 !!", "en", "s", 7), (104, None, None, None, None)]
    table(spark, own).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item), (1, prose(888, 30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return own, shared


def test_stages_against_what_they_should_keep(spark, tmp_path):
    own, shared = corpus(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = [docs]
    for _, stage in P.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], str(tmp_path)))
        assert kept[-1].columns == docs.columns and kept[-1].dtypes == docs.dtypes
    ids = [{r.doc_id for r in k.collect()} for k in kept]
    assert ids[1] == ids[0] - {103, 104}
    lines = {r.doc_id: r for r in kept[2].collect()}
    assert set(lines) == ids[1] and sum(shared in r.text for r in lines.values()) == 1 and shared in lines[101].text
    assert all(r.n_chars in (len(r.text), 1) for r in lines.values())
    assert ids[3] == ids[2] - {100, 101}
    assert ids[4] == ids[3] - {102}
    got = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == ids[4] and "ids" not in got[0].asDict()
    texts = {r.doc_id: r.text for r in kept[4].collect()}
    want = {d: len(_encoder("byte_bpe_50k.json")(t)) // 2 + 1 for d, t in texts.items()}
    n = {}
    for r in got:
        n[r.doc_id] = n.get(r.doc_id, 0) + r.length
        assert r.doc_tokens == want[r.doc_id]
    assert n == want and len({r.sequence_id for r in got}) == -(-sum(want.values()) // 2048)
    assert np.all([r.offset + r.length <= 2048 for r in got])


def test_no_language_to_learn_from_keeps_all_with_letters(spark, tmp_path):
    texts = [prose(1, 60), "Ein kurzer Satz.", "слово", "12 34 !!", "", None]
    unlabelled = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(None, "no id", None, None, None)]
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 == 1][: len(texts)]
    for own in (unlabelled, [(i, t, "de", None, None) for i, t in zip(held, texts, strict=True)]):
        got = P.language(spark, table(spark, own), str(tmp_path))
        assert sorted(r.text for r in got.collect()) == sorted(r[1] for r in own if r[1] and any(c.isalpha() for c in r[1]))


def test_rows_are_judged_one_by_one(spark, tmp_path):
    item = prose(777, 40).replace("\n", " ")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    bad, same = f"{prose(60, 100)} {item} {prose(61, 50)}", prose(70, 150)
    own = [(None, bad), (None, prose(62, 150)), (None, prose(63, 150)), (5, bad), (5, prose(64, 150)), (6, bad), (6, bad), (7, prose(65, 150))]
    got = P.benchmark(spark, table(spark, [(*r, None, None, None) for r in own]), str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted((r for r in own if r[1] != bad), key=str)
    near = edited(same, 1, 1)
    own = [(None, same), (None, same), (None, near), (None, prose(71, 150)), (3, prose(72, 150)), (3, prose(72, 150)), (4, near), (4, prose(73, 150)), (9, prose(74, 150)), (8, edited(prose(74, 150), 2, 1)), (8, prose(75, 150))]
    got = [r.text for r in P.near_copies(spark, table(spark, [(*r, None, None, None) for r in own]), str(tmp_path)).collect()]
    assert len(got) == 6 and sum(t in (same, near) for t in got) == 1
    assert set(got) - {same, near} == {prose(71, 150), prose(72, 150), prose(73, 150), edited(prose(74, 150), 2, 1), prose(75, 150)}


def test_edges(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for k, own in enumerate([rows(), [], [(1, None, None, None, None)]]):
        d = tmp_path / str(k)
        table(spark, own).write.parquet(str(d / "documents.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
        out = P.run(spark, str(d))
        assert out.columns[0] == "doc_id" and (out.count() > 0) == (k == 0)


def test_columns_of_the_same_name_stay(spark, tmp_path):
    spark.createDataFrame([(0, prose(3, 60))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = clashing(spark)
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() > 0
        assert out.filter("score <> 'mine' or lang_pred <> 'mine' or n_lines <> 'mine' or n_dropped <> 'mine' or id <> 'mine'").count() == 0


def test_names():
    assert P.ORACLE_SQL is None and [n for n, _ in P.STAGES] == ["language ID", "line dedup", "MinHash near-dedup", "benchmark decontamination", "packing"]
