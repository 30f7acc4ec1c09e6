"""Packing along a space-filling curve."""

from __future__ import annotations

import functools
import json
import math
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blank

LENGTH, END_ID = 2048, 1
_END = END_ID.to_bytes(2, "little")
BUCKETS, AXES, BITS = 256, 3, 10
#: Below the curve's key; both together are 52 bits, which quantiles, being doubles, tell apart.
LOW_BITS = 22
PART_TOKENS, MOST_PARTS = 8_000_000, 20_000
#: Texts that go to Python in one batch.
TEXTS = 1024
#: The pattern's \s.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters by any version of Unicode, which byte-level pre-tokenisation therefore keeps together.
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: Chunks of a text that byte-level pre-tokenisation takes apart on its own: white space before other characters never
#: belongs to what precedes it, nor does an ASCII character that is no letter to the letters before it.
_CHUNK = re.compile(rf" ?[{LETTERS}]++(?![^\x00-\x7f])|[{SPACE}]*+[^{SPACE}]+|[{SPACE}]+")
#: What pre-tokenisation leaves in one piece, and how it writes the bytes of that for the model.
_WORD = re.compile(rf" ?[{LETTERS}]+")
_WRITTEN = {ord(c): "".join(chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else chr(256 + b - (0 if b <= 32 else 94 if b < 161 else 106)) for b in c.encode()) for c in " " + "".join(map(chr, range(0xC0, 0x100)))}
_SPACE = _WRITTEN[32]
_CUT = re.compile(f"[^{SPACE}](?=[{SPACE}])")
#: Characters of a text whose chunks are held at once, and of the chunks whose ids are remembered.
SLICE, KNOWN = 1_000_000, 10_000_000


def _by_chunks(told: dict) -> bool:
    """Whether a tokenizers file gives the ids of a text as those of its chunks one after the other."""
    pre = told["pre_tokenizer"] or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"]
    return plain and not any(told[x] for x in ("normalizer", "post_processor", "truncation", "padding")) and all(
        re.match(rf"[^{LETTERS}{SPACE}][^{SPACE}]*$", x["content"]) and not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"])
        for x in told["added_tokens"]
    )


class _Known(dict):
    """Ids of the chunks met, as bytes. Words go to the library's model at once, without its pre-tokenisation, which would leave them
    whole; other chunks take all of it. Half of what is remembered is let go at once, less what was met again meanwhile."""

    def __init__(self, own):
        super().__init__()
        self.own, self.model, self.held, self.older = own, own.model, 0, {}

    def __missing__(self, chunk: str) -> bytes:
        if self.held > KNOWN // 2:
            self.older = dict(self)
            self.clear()
            self.held = 0
        self.held += len(chunk)
        got = self.older.get(chunk)
        if got is not None:
            self[chunk] = got
            return got
        if chunk.isascii() and chunk[0] == " " and chunk[1:].isalpha():
            ids = [x.id for x in self.model.tokenize(_SPACE + chunk[1:])]
        elif _WORD.fullmatch(chunk):
            ids = [x.id for x in self.model.tokenize(chunk.translate(_WRITTEN))]
        else:
            ids = self.own.encode_batch_fast([chunk], add_special_tokens=False)[0].ids
        got = self[chunk] = array("H", ids).tobytes()
        return got


@functools.cache
def _encoder(name: str):
    """Ids of a text, as unsigned 16-bit numbers, by the tokenizers library. Where the file allows it, each chunk that
    isn't remembered goes to the library once; what is remembered is bounded, and only speed depends on it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks have a core each
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path(name))
    if not _by_chunks(json.loads(own.to_str())):
        return lambda text: np.array(own.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
    known = _Known(own)

    def encode(text: str) -> bytes:
        out, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + SLICE)
            end = cut.end() if cut else len(text)
            out.append(b"".join(map(known.__getitem__, _CHUNK.findall(text, at, end))))
            at = end
        return b"".join(out)

    return encode


@functools.cache
def _projection() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and sign of each id, and the directions; fixed by their seed."""
    r = np.random.default_rng(20)
    ids = np.arange(1 << 16, dtype=np.uint64)
    h = (ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    signs = np.where((h >> np.uint64(20)) & np.uint64(1), 1.0, -1.0)
    return (h % np.uint64(BUCKETS)).astype(np.int64), signs, r.standard_normal((BUCKETS, AXES))


def hilbert(point: list[int], bits: int = BITS) -> int:
    """The place of a grid point on the Hilbert curve through the grid of 2**bits to a side: Gray-code the
    axes from the highest bit down, undoing at each level the reflections and exchanges of the level above."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    key = 0
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | ((x[i] ^ t) >> b & 1)
    return key


def hilberts(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """hilbert of each row."""
    x = np.array(points, np.int64).T.copy()
    for b in range(bits - 1, 0, -1):
        q = 1 << b
        for i in range(len(x)):
            turn = x[i] & q != 0
            t = np.where(turn, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(turn, q - 1, t)
            x[i] ^= t
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        t ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(len(x)):
            key = key << 1 | ((x[i] ^ t) >> b & 1)
    return key


def curve_key(ids: np.ndarray) -> int:
    """Hashed token counts (root-damped, unit length) -> AXES projections -> normal quantiles -> Hilbert key."""
    return hilbert(_grid(ids))


def _grid(ids: np.ndarray) -> list[int]:
    buckets, signs, directions = _projection()
    v = np.bincount(buckets[ids], weights=signs[ids], minlength=BUCKETS)
    v = np.sign(v) * np.sqrt(np.abs(v))
    norm = math.sqrt(float(v @ v))
    if not norm:
        return [0] * AXES
    at = v @ directions / norm
    return [min((1 << BITS) - 1, int((1 + math.erf(a / math.sqrt(2))) / 2 * (1 << BITS))) for a in at]


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str = "byte_bpe_50k.json", tables: Scratch | None = None) -> DataFrame:
    """Cuts the documents, laid end to end in the order of their Hilbert keys, into sequences of `length` tokens.

    Only the last sequence is not full. The key gets the hash of doc_id below it, so that a group of equal texts of
    any size is spread like other rows, and below that a hash of the row's number, which does the same for rows without or
    with one doc_id. Tokens are encoded once, into a table; the curve is cut at approximate
    quantiles of the key into parts of about PART_TOKENS (at most MOST_PARTS parts), whose sums of tokens go to
    the driver, and each part is then sorted and cut on its own from its known first position.

    Returns one row per piece: doc_id, start (the document's ids before it), length, ids (unsigned 16-bit,
    little-endian), ids_crc32 (of 32-bit ids), doc_tokens, sequence_id, offset. A null or empty text is its end id
    alone; a very long one is encoded whole and runs through as many sequences as it takes; repeated and null doc_ids are documents as any other; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    work = tables or Scratch(spark, "packing")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _encoder(tokenizer)
        for b in batches:
            for at in range(0, len(b), 512):
                x, ids, grids = b.slice(at, 512), [], []
                for text in x.column("text").to_pylist():
                    own = ids_of(text)
                    ids.append(own + _END)
                    grids.append(_grid(np.frombuffer(own, "<u2")))
                yield pa.record_batch({"doc_id": x.column("doc_id"), "low": x.column("low"), "key": pa.array(hilberts(np.array(grids))), "n": pa.array([len(i) // 2 for i in ids], pa.int64()), "ids": pa.array(ids, pa.binary())})

    low = F.shiftleft(F.xxhash64("doc_id").bitwiseAND(2 ** (LOW_BITS - 8) - 1), 8).bitwiseOR(F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(255))
    source = docs.select(F.col("doc_id").cast("long"), blank("text").alias("text"), low.alias("low"))
    rows = work.table(source.mapInArrow(encode, "doc_id long, low long, key long, n long, ids binary").withColumn("key", F.shiftleft("key", LOW_BITS).bitwiseOR(F.col("low"))).drop("low"), TEXTS)
    total = rows.agg(F.sum("n")).first()[0] or 0
    parts = max(1, min(MOST_PARTS, total // PART_TOKENS))
    bounds = rows.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] if parts > 1 else []
    bounds = np.unique(np.array(bounds or [], dtype=np.int64))

    def part(keys):
        import pandas as pd

        return pd.Series(np.searchsorted(bounds, keys.to_numpy(), side="right"))

    rows = rows.withColumn("part", F.pandas_udf(part, "long")("key"))
    first, at = {}, 0
    for p, n in sorted(tuple(r) for r in rows.groupBy("part").agg(F.sum("n")).collect()):  # at most MOST_PARTS rows
        first[p], at = at, at + n

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pos = None, 0
        for b in batches:
            out: list[tuple] = []
            for doc, p, ids in zip(b.column("doc_id").to_pylist(), b.column("part").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if p != now:
                    now, pos = p, first[p]
                wide = np.frombuffer(ids, dtype="<u2").astype("<u4")
                start = 0
                while start < len(wide):
                    n = min(len(wide) - start, length - pos % length)
                    out.append((doc, start, n, ids[2 * start : 2 * (start + n)], zlib.crc32(wide[start : start + n].tobytes()), len(wide), pos // length, pos % length))
                    start, pos = start + n, pos + n
            columns = list(zip(*out, strict=True)) if out else [[]] * len(_PIECE)
            yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(columns, _PIECE, strict=True)], names=[n for n, _ in _PIECE])

    schema = ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n, _ in _PIECE)
    return rows.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "key", "doc_id", "ids").mapInArrow(cut, schema)


_PIECE = [(n, pa.binary() if n == "ids" else pa.int64()) for n in ("doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset")]


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")
