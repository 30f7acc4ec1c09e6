import random
import zlib
from itertools import product

import numpy as np
import public_tokenizers
from cases import clashing, edited, prose, rows, table
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm import packing
from sparkloom.llm.packing import curve_key, hilbert, pack

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


def encoded(text):
    return np.frombuffer(packing._encoder("byte_bpe_50k.json")(text), "<u2").tolist()


def test_hilbert_curve_visits_every_cell_by_single_steps():
    cells = sorted(product(range(8), repeat=3), key=lambda p: hilbert(list(p), 3))
    assert sorted(hilbert(list(p), 3) for p in cells) == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in zip(cells, cells[1:], strict=False))


def test_ids_are_those_of_the_tokenizer():
    r = random.Random(3)
    texts = ["", " ", "a  b\n\n c\t", "<|endoftext|>", "x<|endoftext|>y <|endoftext|><|endoftext|>", "l'été ſtraße ＡＢ 𝒳 ​   ", "\r\n \r", "don't I'LL '''", "中文字符 العربية हिन्दी", "0123456789" * 5, " " * 300]
    texts += ["".join(r.choice(" \n\taZé9'.%<|>endofx中 ") for _ in range(r.randrange(80))) for _ in range(500)]
    for t in texts:
        assert encoded(t) == ids(t)[:-1], t


def test_ids_of_very_long_white_space():
    r = random.Random(4)
    n = 2_500_000
    texts = ["word " + " " * n + "end", "\n" * n, "a" + "\n" * n + "b" + " " * n, " " * n + "<|endoftext|>" + "\n" * n + "1", "x" + "".join(r.choice(" \n\t\r\u3000\xa0\u2009\x85\x0b") for _ in range(n)) + "\ty"]
    texts += [a + c * k + b for a in ("", "a", "'") for b in ("", "b", "'s", "1", "!", "\x1c", "<|endoftext|>") for c in (" ", "\n") for k in (99_999, 100_000, 100_001)]
    for t in texts:
        assert encoded(t) == ids(t)[:-1], (t[:5], t[-20:], len(t))


def test_ids_of_a_text_do_not_depend_on_slices_or_memory(monkeypatch):
    r = random.Random(5)
    texts = ["".join(r.choice(["  ", " ", "\n", "\u3000", "a", "Zé", "can't", "'s", "<|endoftext|>", "9", "!", "中", "\x1c"]) for _ in range(r.randrange(60))) for _ in range(500)]
    want = [ids(t)[:-1] for t in texts]
    for held, size in ((10**9, 1), (0, 7), (20, 10**9)):
        monkeypatch.setattr(packing, "KNOWN", held)
        monkeypatch.setattr(packing, "SLICE", size)
        assert [encoded(t) for t in texts] == want


def test_files_that_chunks_do_not_fit_are_read_whole():
    name = "word_bpe_49k.json"
    own = Tokenizer.from_file(public_tokenizers.path(name))
    for t in ("", "Two  Words, l'été 中文 <|endoftext|>x", " a\n b "):
        assert np.frombuffer(packing._encoder(name)(t), "<u2").tolist() == own.encode(t, add_special_tokens=False).ids


def check(pieces, own, length):
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append(p)
        assert p.length > 0 and p.offset + p.length <= length and zlib.crc32(np.frombuffer(p.ids, "<u2").astype("<u4").tobytes()) == p.ids_crc32
    assert sorted(by) == list(range(len(by)))
    for k, v in by.items():
        at = 0
        for p in sorted(v, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == length or k == len(by) - 1
    # whole documents come back: pieces that touch make up each text's ids
    ends = {}
    for p in pieces:
        ends.setdefault((p.doc_id, p.doc_tokens, p.start), []).append(p)
    got = []
    for (doc, n, start), firsts in ends.items():
        if start == 0:
            for p in firsts:
                data, at = p.ids, p.length
                while at < n:
                    nxt = [x for x in ends[doc, n, at] if x.sequence_id * length + x.offset == p.sequence_id * length + p.offset + p.length]
                    p = nxt[0]
                    data, at = data + p.ids, at + p.length
                got.append((doc, np.frombuffer(data, "<u2").tolist()))
    assert sorted(map(str, got)) == sorted(str((r[0], ids(r[1]))) for r in own)


def test_round_trip(spark, monkeypatch):
    for df in (table(spark), clashing(spark)):
        check(pack(df).collect(), rows(), 2048)
    monkeypatch.setattr(packing, "PART_TOKENS", 1000)
    check(pack(table(spark), length=64).collect(), rows(), 64)
    assert pack(table(spark, [])).count() == 0


def test_neighbours_share_a_region():
    near, far = [], []
    for i in range(60):
        a = np.array(ids(prose(i, 300)))
        near.append(abs(curve_key(a) - curve_key(np.array(ids(edited(prose(i, 300), i, 2))))))
        far.append(abs(curve_key(a) - curve_key(np.array(ids(prose(i + 500, 300))))))
    assert np.median(near) < np.median(far) / 2


def test_sequences_follow_the_curve(spark, monkeypatch):
    """Documents lie in the order of their Hilbert keys, over all parts; copies and rows without doc_id are spread too."""
    monkeypatch.setattr(packing, "PART_TOKENS", 1000)
    own = rows() + [(100 + i, prose(i, 40), "en", "s", 1) for i in range(150)] + [(None, prose(3, 40), "en", "s", 1)] * 60
    pieces = sorted(pack(table(spark, own), length=64).collect(), key=lambda p: (p.sequence_id, p.offset))
    tokens = {r[0]: ids(r[1]) for r in own}
    first = [p for p in pieces if p.start == 0]
    assert len(first) == len(own)
    keys = []
    for p in first:
        known = [ids(r[1]) for r in own if r[0] == p.doc_id and len(ids(r[1])) == p.doc_tokens and np.array(ids(r[1])[: p.length], "<u2").tobytes() == p.ids]
        keys.append({curve_key(np.array(k[:-1], dtype=np.int64)) for k in known})
    assert all(keys) and len(tokens) > 100
    at = 0
    for k in keys:  # some choice of keys ascends
        at = min(x for x in k if x >= at)


def test_parts_hold_their_share(spark, monkeypatch):
    """Rows without doc_id that are all alike don't fall into one part."""
    monkeypatch.setattr(packing, "PART_TOKENS", 2000)
    df = pack(table(spark, [(None, prose(1, 30), "en", "s", 1)] * 400), length=64)
    by = df.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(by) >= 4 and max(r["count"] for r in by) <= sum(r["count"] for r in by) / 2


def test_words_skip_pre_tokenisation(monkeypatch):
    """op1_packing was over its CPU seconds: words met first go to the model at once, letters of Latin-1 and what follows them apart; the same ids."""
    r = random.Random(6)
    letters = [chr(c) for c in (*range(1, 0x180), 0x300, 0x2009, 0x3000, 0x4E2D, 0x1F600, 0x200B)] + [*" \n abc\xe9\xdf\xed\xff\xc0'" * 12, "'s", "<|endoftext|>"]
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(5000)]
    for most in (10**7, 50):
        monkeypatch.setattr(packing, "KNOWN", most)
        assert [encoded(t) for t in texts] == [ids(t)[:-1] for t in texts]
    assert packing._CHUNK.findall(" stra\xdfe, na") == [" stra\xdfe", ",", " na"]


def test_what_is_met_again_stays_known(monkeypatch):
    monkeypatch.setattr(packing, "KNOWN", 40)
    known = packing._Known(TOKENIZER)
    for i in range(100):
        assert known[f" w{i}"] and known[" again"]
        if i:
            assert " again" in known or " again" in known.older


def test_keys_of_many_rows_are_those_of_each():
    r = random.Random(7)
    points = [[r.randrange(1 << packing.BITS) for _ in range(3)] for _ in range(500)] + [[0, 0, 0]]
    assert packing.hilberts(np.array(points)).tolist() == [hilbert(p) for p in points]
