"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blank

GRAM = 3
#: A gram is rare if at most this share of the documents hold it, or so few of them, or if it is in the rarer half of
#: its item's grams. (Were the rarer half all, the grams that an edited copy lacks would be the first to be chosen.)
RARE, FEW = 1e-4, 100
#: A match scores 1, a mismatch or a gap -1. An alignment counts from SHARE of the
#: words of the item on (copies with three words in ten replaced), at least SHORT of them, or from LONG.
SHARE, LONG, SHORT = 0.4, 50, 5
#: Items that are held in memory at once, in characters; more are taken in as many passes.
SLICE_CHARS = 2_000_000
#: Words in windows that wait for their alignment at most, but for those of one document and item.
HELD_WORDS = 2_000_000
_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class _Items:
    """Test items as word numbers, and their grams; a gram's code is a number in the base of the vocabulary."""

    def __init__(self, items: list[tuple]):
        words = [(k, words_of(t or "")) for k, t in items]
        self.ids = [k for k, w in words if w]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({x for _, w in words for x in w}))}
        self.words = [np.array([self.vocabulary[x] for x in w], np.int64) for _, w in words if w]
        self.base = len(self.vocabulary) + 1
        if self.base >= 2**21:
            raise ValueError("one item has over two million different words")  # codes are below 2**63
        rows = [(c, k, at) for k, w in enumerate(self.words) for n in [min(GRAM, len(w))] for at, c in enumerate(self.codes(w, n).tolist())]
        rows.sort()
        self.code, self.item, self.at = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        self.grams = np.unique(self.code)
        self.sizes = sorted({min(GRAM, len(w)) for w in self.words})

    def codes(self, words: np.ndarray, n: int) -> np.ndarray:
        """Codes of all n-grams; -1 where a word isn't in the vocabulary. Shorter grams end in zeros."""
        m = max(0, len(words) - n + 1)
        out, known = np.zeros(m, np.int64), np.ones(m, bool)
        for i in range(GRAM):
            out = out * self.base + (words[i : i + m] if i < n else 0)
            if i < n:
                known &= words[i : i + m] > 0
        return np.where(known, out, -1)

    def number(self, text: str) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words_of(text)], np.int64)

    def found(self, words: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in words, and indexes of grams there."""
        where, which = [], []
        for n in self.sizes:
            codes = self.codes(words, n)
            at = np.flatnonzero(codes >= 0)
            k = np.minimum(np.searchsorted(grams, codes[at]), len(grams) - 1)
            hit = grams[k] == codes[at] if len(grams) else np.zeros(0, bool)
            where.append(at[hit])
            which.append(k[hit])
        return np.concatenate(where or [np.zeros(0, np.int64)]), np.concatenate(which or [np.zeros(0, np.int64)])


def align(windows: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Smith-Waterman scores of each row of windows against item; 0 and -1 in windows match nothing.

    Row by row over the item; a gap along the window is a running maximum."""
    h = np.zeros((len(windows), windows.shape[1] + 1), np.int32)
    best = np.zeros(len(windows), np.int32)
    step = np.arange(windows.shape[1] + 1, dtype=np.int32)
    for word in item:
        new = np.zeros_like(h)
        new[:, 1:] = np.maximum(h[:, :-1] + np.where(windows == word, 1, -1), h[:, 1:] - 1)
        np.maximum(new, 0, out=new)
        h = np.maximum.accumulate(new + step, axis=1) - step
        np.maximum(best, h.max(axis=1), out=best)
    return best


def least_score(n: int) -> int:
    return min(max(int(np.ceil(SHARE * n)), min(n, SHORT)), LONG)


def _slice(docs: DataFrame, items: _Items, total: int, work: Scratch) -> DataFrame:
    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(items.grams), np.int64)
        for b in batches:
            for text in b.column("text").to_pylist():
                n[np.unique(items.found(items.number(text), items.grams)[1])] += 1
        some = np.flatnonzero(n)
        yield pa.record_batch({"gram": pa.array(some, pa.int64()), "n": pa.array(n[some], pa.int64())})

    df = np.zeros(len(items.grams), np.int64)
    # one row at most for each gram of the items in memory
    for g, n in docs.select("text").mapInArrow(holders, "gram long, n long").groupBy("gram").agg(F.sum("n")).collect():
        df[g] = n
    own = df[np.searchsorted(items.grams, items.code)]
    seed = own <= max(FEW, RARE * total)
    for k in range(len(items.words)):
        of = np.flatnonzero(items.item == k)
        seed[of[np.argsort(own[of], kind="stable")[: (len(of) + 1) // 2]]] = True
    code, item, at = items.code[seed], items.item[seed], items.at[seed]
    seeds = np.unique(code)
    first, last = np.searchsorted(code, seeds, "left"), np.searchsorted(code, seeds, "right")

    def aligned(todo: dict[int, list]) -> pa.RecordBatch:
        out = []
        for k, rows in todo.items():
            n = len(items.words[k])
            best: dict = {}
            for lo in range(0, len(rows), 256):
                part = rows[lo : lo + 256]
                for (doc, _), s in zip(part, align(np.stack([w for _, w in part]), items.words[k]).tolist(), strict=True):
                    best[doc] = max(best.get(doc, 0), s)
            out += [(doc, items.ids[k], s, n, s / n) for doc, s in best.items() if s >= least_score(n)]
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "score", "item_words", "similarity"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            todo: dict[int, list] = {}
            held = 0
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = items.number(text)
                where, which = items.found(words, seeds)
                diagonals: dict[int, set] = {}
                for p, g in zip(where.tolist(), which.tolist(), strict=True):
                    for r in range(first[g], last[g]):
                        diagonals.setdefault(int(item[r]), set()).add(p - int(at[r]))
                for k, starts in diagonals.items():
                    n = len(items.words[k])
                    slack, end = max(4, n // 4), None
                    for d in sorted(starts):
                        if end is None or d > end:
                            end = d + slack  # one window for all diagonals up to here
                            window = np.full(n + 3 * slack, -1, np.int64)
                            lo, hi = max(0, d - slack), min(len(words), d + n + 2 * slack)
                            window[lo - (d - slack) : hi - (d - slack)] = words[lo:hi]
                            todo.setdefault(k, []).append((doc, window))
                            held += len(window)
                    if held > HELD_WORDS:
                        yield aligned(todo)
                        todo, held = {}, 0
            yield aligned(todo)

    found = docs.mapInArrow(score, "doc_id long, item_id long, score long, item_words long, similarity double")
    return work.table(found)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs of a document and a test item of which it holds an exact, edited or shortened copy.

    One pass over docs counts in how many documents each gram of the items stands; rare grams are the seeds. A
    second pass joins every passage to the items whose seeds it holds and aligns each item with the passage around
    the seeds' diagonals. Words are runs of letters, digits and underscores, in lower case.

    Returns doc_id, item_id, score, item_words, similarity (score / item_words), once for each doc_id and item_id,
    the best. Whole texts are looked through, however long, and windows are aligned as soon as HELD_WORDS wait. Null texts hold nothing; items without words match nothing; rows with one doc_id are one document;
    a null doc_id comes back as null; empty tables give an empty table.
    """
    spark, work = docs.sparkSession, Scratch(docs.sparkSession, "decontamination")
    source = docs.select(F.col("doc_id").cast("long"), blank("text").alias("text"))
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), blank("text").alias("text")).distinct()
    chars = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = -(-chars // SLICE_CHARS)
    total = source.count() if slices else 0
    found = []
    for k in range(slices):  # a slice holds SLICE_CHARS characters or so, whatever the table's size
        items = _Items([tuple(r) for r in tests.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).collect()])
        if items.words:
            found.append(_slice(source, items, total, work))
    if not found:
        return spark.createDataFrame([], "doc_id long, item_id long, score long, item_words long, similarity double")
    best = reduce(DataFrame.union, found).groupBy("doc_id", "item_id").agg(F.max_by(F.struct("score", "item_words", "similarity"), "similarity").alias("x"))
    return best.select("doc_id", "item_id", "x.*")


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
