import public_tokenizers
import pytest
import sentencepiece
from cases import clashing, rows, table

from sparkloom.llm.token_counts import CACHE, count_tokens, count_with

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def brute():
    m = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return sorted(((r[0], len((r[1] or "").encode()), len(m.encode(r[1] or ""))) for r in rows()), key=str)


def test_whole_texts_and_cache(spark):
    for df in (table(spark), clashing(spark)):
        out, fresh = count_tokens(df, MODEL)
        assert sorted(map(tuple, out.select("doc_id", "n_bytes", "n_tokens").collect()), key=str) == brute()
    assert fresh.count() == len({r[1] or "" for r in rows()})
    out, more = count_tokens(table(spark), MODEL, cache=fresh)
    assert more.count() == 0 and sorted(map(tuple, out.select("doc_id", "n_bytes", "n_tokens").collect()), key=str) == brute()
    from pyspark.sql import functions as F

    _, other = count_tokens(table(spark), MODEL, cache=fresh.withColumn("tokenizer", F.lit("old")))
    assert other.count() == fresh.count()
    some = fresh.filter("n_tokens > 100")
    out, more = count_tokens(table(spark), MODEL, cache=some.union(some))
    assert more.count() == fresh.count() - some.count() and out.count() == len(rows())


def test_json_tokenizer(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    out, _ = count_tokens(table(spark), path)
    assert sorted((str(r.doc_id), r.n_tokens) for r in out.collect()) == sorted((str(r[0]), len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows())


def test_empty(spark):
    out, fresh = count_tokens(table(spark, []), MODEL)
    assert out.count() == fresh.count() == 0
    with pytest.raises(OSError):
        count_tokens(table(spark, []), "/nowhere.model")


def test_cache_in_a_folder(spark, tmp_path):
    folder = f"file://{tmp_path}/cache"
    cache = lambda: spark.read.schema(CACHE).parquet(folder)
    some = [r for r in rows() if r[0] != 30]
    count_with(table(spark, some), MODEL, folder)
    n = cache().count()
    for _ in range(2):
        out = count_with(table(spark), MODEL, folder)
        assert sorted(map(tuple, out.select("doc_id", "n_bytes", "n_tokens").collect()), key=str) == brute()
        assert cache().count() == cache().distinct().count() == n + 1


def test_query_reads_its_cache(spark, tmp_path, monkeypatch):
    from sparkloom.llm import token_counts as T

    table(spark).write.parquet(f"{tmp_path}/documents.parquet")
    known = []
    real = T.count_tokens
    monkeypatch.setattr(T, "count_tokens", lambda docs, path, cache: known.append(0 if cache is None else cache.count()) or real(docs, path, cache))
    one, two = (sorted(map(str, T.op6_token_counts(spark, str(tmp_path)).collect())) for _ in range(2))
    assert one == two and known == [0, len({r[1] or "" for r in rows()})]
