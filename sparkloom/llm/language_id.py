"""Language identification by a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hidden, shown

#: Units of each direction; bytes of a window, in which both directions start anew; windows run at once.
UNITS, WINDOW, BATCH = 8, 128, 2048
#: The model learns from at most this many documents of each language, those with the least hash, and from at most
#: this many windows of each, spread over the whole text.
DOCS_PER_LANG, WINDOWS_PER_DOC = 400, 4
STEPS, STEP_WINDOWS, RATE, SEED = 400, 64, 0.02, 10
UNDECIDED = "und"
#: What a text must hold to be in a language.
LETTER = r"\p{L}"


def _soft(x: np.ndarray) -> np.ndarray:
    """The network's squashing function, x / (1 + |x|); a gate is half of it and a half."""
    return x / (1 + np.abs(x))


@dataclass
class Model:
    """Weights of both directions, feature first: of the inputs (6U, 256) by byte, of the state (6U, 2U), two
    blocks, and of the labels (labels, 2U). Features are update, reset and candidate, each forward then backward."""

    langs: list[str]
    inputs: np.ndarray
    state: np.ndarray
    labels: np.ndarray
    bias: np.ndarray

    def run(self, windows: np.ndarray) -> np.ndarray:
        """Label probabilities of every position: (positions, labels, windows)."""
        n, size = windows.shape
        k, u = 2 * UNITS, UNITS
        byte = np.ascontiguousarray(windows.T).astype(np.intp)
        h = np.zeros((k, n), np.float32)
        logits = np.zeros((size, len(self.langs), n), np.float32)
        x, g, half, size_of = (np.empty((3 * k, n), np.float32) for _ in range(4))
        ahead = np.concatenate([np.arange(i, i + u) for i in (0, k, 2 * k)])
        fore, back = np.ascontiguousarray(self.inputs[ahead]), np.ascontiguousarray(self.inputs[ahead + u])
        one, two = np.empty((3 * u, n), np.float32), np.empty((3 * u, n), np.float32)
        for t in range(size):
            np.take(fore, byte[t], axis=1, out=one, mode="clip")
            np.take(back, byte[size - 1 - t], axis=1, out=two, mode="clip")
            for i in range(3):
                x[i * k : i * k + u], x[i * k + u : (i + 1) * k] = one[i * u : (i + 1) * u], two[i * u : (i + 1) * u]
            np.matmul(self.state, h, out=g)
            gates = x[: 2 * k]
            gates += g[: 2 * k]
            np.abs(gates, out=half[: 2 * k])
            half[: 2 * k] += 1
            gates /= half[: 2 * k]
            gates *= 0.5
            gates += 0.5
            new = x[2 * k :]
            g[2 * k :] *= gates[k:]
            new += g[2 * k :]
            np.abs(new, out=size_of[:k])
            size_of[:k] += 1
            new /= size_of[:k]
            h -= new
            h *= gates[:k]
            h += new
            logits[t] += self.labels[:, :u] @ h[:u]
            logits[size - 1 - t] += self.labels[:, u:] @ h[u:]
        logits += self.bias[:, None]
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def document_probabilities(self, texts: list[bytes]) -> np.ndarray:
        """The mean over all of a text's bytes of the probabilities of their labels. Texts mustn't be empty."""
        count = [-(-len(t) // WINDOW) for t in texts]
        flat = np.frombuffer(b"".join(t.ljust(c * WINDOW) for t, c in zip(texts, count, strict=True)), np.uint8).reshape(-1, WINDOW)
        fill = np.full(len(flat), WINDOW)
        last = np.cumsum(count) - 1
        fill[last] = [len(t) - (c - 1) * WINDOW for t, c in zip(texts, count, strict=True)]
        sums = np.empty((len(flat), len(self.langs)))
        for at in range(0, len(flat), BATCH):
            p = self.run(flat[at : at + BATCH])
            real = np.arange(WINDOW)[:, None] < fill[None, at : at + BATCH]
            if not real.all():
                p *= real[:, None, :]
            sums[at : at + BATCH] = p.sum(axis=0).T
        return np.add.reduceat(sums, last - np.array(count) + 1, axis=0) / np.array([len(t) for t in texts])[:, None]


def _gradients(m: Model, windows: np.ndarray, truth: np.ndarray) -> dict[str, np.ndarray]:
    """Backpropagation through time of the mean cross-entropy over all positions; truth: a label for each window."""
    n, size = windows.shape
    k, u = 2 * UNITS, UNITS
    byte = windows.T.astype(np.intp)
    h = [np.zeros((k, n), np.float32)]
    kept = []
    for t in range(size):
        x = np.empty((3 * k, n), np.float32)
        for i in range(3):
            x[i * k : i * k + u] = m.inputs[i * k : i * k + u, byte[t]]
            x[i * k + u : (i + 1) * k] = m.inputs[i * k + u : (i + 1) * k, byte[size - 1 - t]]
        g = m.state @ h[-1]
        a = x[: 2 * k] + g[: 2 * k]
        gate = 0.5 + 0.5 * _soft(a)
        z, r = gate[:k], gate[k:]
        c = x[2 * k :] + r * g[2 * k :]
        new = _soft(c)
        kept.append((a, z, r, g[2 * k :], c, new))
        h.append(new + z * (h[-1] - new))
    f = np.stack([x[:u] for x in h[1:]])
    b = np.stack([x[u:] for x in h[:0:-1]])
    both = np.concatenate([f, b], axis=1)  # (positions, 2U, windows)
    logits = m.labels @ both + m.bias[:, None]
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[:, truth, np.arange(n)] -= 1
    p /= n * size
    d_labels = np.tensordot(p, both, axes=([0, 2], [0, 2]))
    d_both = m.labels.T @ p
    d_inputs, d_state = np.zeros_like(m.inputs), np.zeros_like(m.state)
    dh = np.zeros((k, n), np.float32)
    for t in range(size - 1, -1, -1):
        dh[:u] += d_both[t, :u]
        dh[u:] += d_both[size - 1 - t, u:]
        a, z, r, gn, c, new = kept[t]
        dc = dh * (1 - z) / (1 + np.abs(c)) ** 2
        da = np.concatenate([dh * (h[t] - new), dc * gn]) * 0.5 / (1 + np.abs(a)) ** 2
        dx = np.concatenate([da, dc])
        dg = np.concatenate([da, dc * r])
        for i in range(3):
            for part, at in ((slice(i * k, i * k + u), t), (slice(i * k + u, (i + 1) * k), size - 1 - t)):
                _scatter(d_inputs, part, byte[at], dx[part])
        d_state += dg @ h[t].T
        dh = dh * z + m.state.T @ dg
    block = np.kron(np.ones((3, 1)), np.kron(np.eye(2), np.ones((u, u))))
    return {"inputs": d_inputs, "state": d_state * block, "labels": d_labels, "bias": p.sum(axis=(0, 2))}


def _scatter(out: np.ndarray, rows: slice, at: np.ndarray, values: np.ndarray) -> None:
    hot = np.zeros((len(at), 256), np.float32)
    hot[np.arange(len(at)), at] = 1
    out[rows] += values @ hot


def train(windows: np.ndarray, truth: np.ndarray, langs: list[str], steps: int = STEPS) -> Model:
    """Adam over batches with as many windows of each language."""
    r = np.random.default_rng(SEED)
    k, u = 2 * UNITS, UNITS
    block = np.kron(np.ones((3, 1)), np.kron(np.eye(2), np.ones((u, u))))
    m = Model(langs, r.normal(0, 0.3, (3 * k, 256)).astype(np.float32), (r.normal(0, 0.3, (3 * k, k)) * block).astype(np.float32), r.normal(0, 0.3, (len(langs), k)).astype(np.float32), np.zeros(len(langs), np.float32))
    m.inputs[:k] += 1  # keep the state for longer at first
    of = [np.flatnonzero(truth == i) for i in range(len(langs))]
    mean = {n: np.zeros_like(getattr(m, n)) for n in ("inputs", "state", "labels", "bias")}
    square = {n: np.zeros_like(x) for n, x in mean.items()}
    for step in range(1, steps + 1):
        pick = np.concatenate([r.choice(x, max(1, STEP_WINDOWS // len(langs))) for x in of])
        rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
        for name, g in _gradients(m, windows[pick], truth[pick]).items():
            mean[name] = (0.9 * mean[name] + 0.1 * g).astype(np.float32)
            square[name] = (0.99 * square[name] + 0.01 * g * g).astype(np.float32)
            now = getattr(m, name)
            now -= rate * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-8)
    return m


def held_out():
    """Documents never learnt from: crc32 of doc_id as text has the remainder 1 by 3, or there is no doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame) -> Model | None:
    """Learns from text and lang of documents that aren't held out; None if no language is given there.

    The bound is DOCS_PER_LANG documents of each language. Of a language with more, a share by hash of doc_id and text
    goes on, about four times as many; those with the least hash are taken, of each a few windows only. A language
    of which no row is drawn, as few different ones repeat, is drawn from again without the share.
    """
    own = docs.filter(~held_out()).filter("lang is not null and text is not null").filter(F.col("text").rlike(LETTER))
    counts = {r[0]: r[1] for r in own.groupBy("lang").count().collect()}  # languages, not documents
    if not counts:
        return None
    rows = _draw(own, {lang: min(1.0, 4 * DOCS_PER_LANG / n) for lang, n in counts.items()})
    missed = set(counts) - {x[0] for x in rows}
    if missed:
        rows += _draw(own.dropDuplicates(["lang", "doc_id", "text"]), dict.fromkeys(missed, 1.0))
    langs = sorted({x[0] for x in rows})
    windows = [np.frombuffer(t.encode()[:WINDOW].ljust(WINDOW), np.uint8) for _, _, spots in rows for t in spots]
    truth = [langs.index(lang) for lang, _, spots in rows for _ in spots]
    return train(np.stack(windows), np.array(truth), langs)


def _draw(own: DataFrame, shares: dict[str, float]) -> list[tuple]:
    """Sorted (language, number, windows) of at most DOCS_PER_LANG documents of each of these languages."""
    share = F.element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col("lang"))
    own = own.filter(F.col("lang").isin(list(shares))).withColumn("h", F.xxhash64("doc_id", "text")).filter(F.pmod("h", F.lit(1_000_003)) < share * 1_000_003)
    room = F.greatest(F.char_length("text") - WINDOW, F.lit(0))
    spots = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(WINDOWS_PER_DOC - 1)), lambda i: F.substr(F.col("text"), (i * room / (WINDOWS_PER_DOC - 1)).cast("int") + 1, F.lit(WINDOW))))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "spots"))
    picked = own.select("lang", "h", spots.alias("spots")).withColumn("k", rank).filter(F.col("k") <= DOCS_PER_LANG)
    return sorted(tuple(x) for x in picked.select("lang", "k", "spots").collect())


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds lang_pred and score to docs (they replace columns of that name); only the text is looked at.

    Every byte of the whole text gets a label's probabilities from its window, and their mean decides; ties go to
    the first language by name. score is that mean. A null text, one without letters, or no model give `und` and 0;
    a text of any length is read whole. Rows stay apart, repeated or not; an empty table stays empty.
    """
    docs = hidden(docs.drop("lang_pred", "score"))
    at = docs.columns.index("text")
    told = docs.withColumn("__letters", F.coalesce(F.col("text").rlike(LETTER), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 512):
                x = b.slice(lo, 512)
                texts, letters = x.column(at).to_pylist(), x.columns[-1].to_pylist()
                known = [i for i, t in enumerate(texts) if model and letters[i]]
                langs, scores = [UNDECIDED] * len(texts), [0.0] * len(texts)
                if known:
                    p = model.document_probabilities([texts[i].encode("utf-8", "replace") for i in known])
                    for i, k, s in zip(known, p.argmax(axis=1), p.max(axis=1), strict=True):
                        langs[i], scores[i] = model.langs[k], min(1.0, round(float(s), 6))
                yield pa.RecordBatch.from_arrays([*x.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*x.schema.names[:-1], "lang_pred", "score"])

    schema = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return shown(told.mapInArrow(run, schema))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
