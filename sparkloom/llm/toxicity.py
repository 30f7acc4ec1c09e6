"""Toxic documents by a weighted grammar of clauses, its words and weights learned from labels."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import Scratch, batches_of

#: Training rows of each label at most, those whose doc_id has the least hash; stems learned at most.
SAMPLE, STEMS = 8192, 50_000
#: Letters of a stem; toxic texts that must have it; what a stem counts before any is seen, in texts; the least weight that counts.
SHORT, LONG, SUPPORT, SHRINK, LEAST = 3, 12, 3, 4, 1.5
#: A document is called toxic from this score on.
LIMIT = 0.7
#: Texts of a batch, remembered words of a task, letters read at once (up to the end of a clause).
TEXTS, WORDS, PIECE = 512, 400_000, 2**20

#: What a word is to the grammar.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)
#: What the grammar makes of an insult or a threat, and of a target after one (TO).
NEGATED, REPORTED, ADDRESSED, MENACE, NEGATED_THREAT, REPORTED_THREAT, TO = range(7, 14)
#: Words within which a negation works, and a target on either side.
REACH, NEAR = 3, 4

#: Insults aren't listed, they are learned.
LISTS = {
    THREAT: "kill hurt destroy stab strangle murder crush tuer frapper détruire étrangler écraser töten umbringen schlagen zerstören erwürgen matar golpear destruir apuñalar aplastar",
    TARGET: "you your yours yourself he she they him them tu toi vous ton votre vos ils elles lui du dich dir ihr euch dein euer sie ihn tú usted ustedes vosotros tuyo ellos ellas",
    NEGATION: "not no never nobody none without isn aren wasn weren don doesn didn won ne pas jamais aucun aucune nicht kein keine keinen nie niemals ohne nunca jamás ningún ninguna",
    REPORT: "said says say called calls quoted quotes wrote reported claims claimed allegedly dit disait écrit appelle prétend sagte sagt schrieb nannte behauptet angeblich dijo dice escribió llamó afirma",
}
KNOWN = {w: symbol for symbol, words in LISTS.items() for w in words.split()}
#: What a listed threat weighs, as stems do: the logarithm of how much likelier it makes a toxic text.
THREAT_WEIGHT = 3.0

TOKEN = re.compile(r'[^\W\d_]+|[.!?;\n]|["“”«»„]')
END = re.compile(r"[.!?;\n]")
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Transducer:
    """Reads a symbol, writes one: step(state, symbol) -> (state, symbol); symbols that it doesn't work on pass."""

    start: tuple
    step: Callable


def _negation(left: int, symbol: int) -> tuple[int, int]:
    if symbol == NEGATION:
        return REACH, symbol
    out = {INSULT: NEGATED, THREAT: NEGATED_THREAT}.get(symbol, symbol) if left else symbol
    return max(left - 1, 0), out


def _report(inside: int, symbol: int) -> tuple[int, int]:
    """After a word of reporting up to the clause's end, and between quotation marks."""
    if symbol == REPORT:
        return 2, symbol
    if symbol == QUOTE:
        return {0: 1, 1: 0, 2: 2}[inside], symbol
    return inside, ({INSULT: REPORTED, THREAT: REPORTED_THREAT}.get(symbol, symbol) if inside else symbol)


def _target(state: tuple[int, int], symbol: int) -> tuple[tuple[int, int], int]:
    """(words that a target still reaches, words in which one may still follow an insult)."""
    near, pending = state
    if symbol == TARGET:
        return (NEAR, 0), TO if pending else symbol
    if symbol in (INSULT, THREAT):
        return (max(near - 1, 0), 0 if near else NEAR), {INSULT: ADDRESSED, THREAT: MENACE}[symbol] if near else symbol
    return (max(near - 1, 0), max(pending - 1, 0)), symbol


def compose(*machines: Transducer) -> tuple[np.ndarray, np.ndarray]:
    """One machine in place of several, each reading what the one before writes: tables of its reachable states."""
    start = tuple(m.start for m in machines)
    number, todo, nexts, outs = {start: 0}, [start], [], []
    for state in todo:
        row, out = [], []
        for symbol in range(QUOTE + 1):
            to, said = [], symbol
            for m, s in zip(machines, state, strict=True):
                s, said = m.step(s, said)
                to.append(s)
            if tuple(to) not in number:
                number[tuple(to)] = len(number)
                todo.append(tuple(to))
            row.append(number[tuple(to)])
            out.append(said)
        nexts.append(row)
        outs.append(out)
    return np.array(nexts), np.array(outs)


#: Insults and threats as they come; negations before, reports around and targets beside them.
NEXT, SAYS = (t.tolist() for t in compose(Transducer(0, _negation), Transducer(0, _report), Transducer((0, 0), _target)))

#: Features of a document: its best match of each kind, and the best match outside the clause of the best.
KINDS = (INSULT, ADDRESSED, NEGATED, REPORTED, THREAT, MENACE, NEGATED_THREAT, REPORTED_THREAT)
SLOT = {k: i for i, k in enumerate(KINDS)}
#: What features count for where labels don't say otherwise, and how firmly this holds.
PRIOR, FIRM = np.array([1.0, 1.2, 0.3, 0.4, 0.6, 1.2, 0.1, 0.1, 0.3]), 0.5


def pieces(text: str) -> Iterator[str]:
    """text in pieces that end with clauses."""
    at = 0
    while len(text) - at > PIECE:
        cut = END.search(text, at + PIECE)
        if not cut:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


class Lexicon(dict):
    """(symbol, weight) of each word met so far. A word is an insult with the best weight of the stems that it begins with."""

    def __init__(self, stems: dict[str, float]):
        super().__init__()
        self.stems = stems

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) > WORDS:
            self.clear()
        weight = max((self.stems.get(word[:n], 0.0) for n in range(SHORT, min(len(word), LONG) + 1)), default=0.0)
        symbol = KNOWN.get(word, OTHER)
        if symbol == OTHER and word in '"“”«»„':
            symbol = QUOTE
        out = (INSULT, weight) if weight >= LEAST else (symbol, THREAT_WEIGHT if symbol == THREAT else 0.0)
        self[word] = out
        return out


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The best match of each kind in the clauses of a whole text (the weight of a clause is that of its best path), and
    the second best clause's."""
    best, clauses = [0.0] * len(KINDS), [0.0, 0.0]
    for piece in pieces((text or "").lower()):
        tokens = TOKEN.findall(piece)
        seen = [lexicon[t] for t in tokens]
        hits = [i for i, s in enumerate(seen) if s[1]]
        done = 0
        for i in hits:
            if i < done:
                continue
            low = i
            while low and tokens[low - 1] not in ".!?;\n":
                low -= 1
            state, own, last = 0, 0.0, None
            for done in range(low, len(tokens) + 1):
                if done == len(tokens) or tokens[done] in ".!?;\n":
                    break
                symbol, weight = seen[done]
                said, state = SAYS[state][symbol], NEXT[state][symbol]
                if weight:
                    slot, last = SLOT[said], (symbol, weight)
                    best[slot], own = max(best[slot], weight), max(own, weight)
                elif said == TO and last:
                    slot = SLOT[ADDRESSED if last[0] == INSULT else MENACE]
                    best[slot] = max(best[slot], last[1])
            done += 1
            clauses = sorted([*clauses, own])[1:]
    return [*best, clauses[0]]


@dataclass
class Model:
    stems: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.r_[PRIOR, -2.2])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def learned_from(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("long").cast("string")) % 3 != 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of each fold and label each stem begins a word."""
    seen: Counter = Counter()

    def rows() -> pa.RecordBatch:
        keys = list(seen)
        return pa.record_batch({"stem": pa.array([k[0] for k in keys], pa.string()), "kind": pa.array([k[1] for k in keys], pa.int32()), "n": pa.array([seen[k] for k in keys], pa.int64())})

    for b in batches:
        for text, kind in zip(b.column("text").to_pylist(), b.column("kind").to_pylist(), strict=True):
            words = set()
            for piece in pieces(text.lower()):
                words.update(WORD.findall(piece))
            seen.update((s, kind) for s in {w[:n] for w in words for n in range(SHORT, min(len(w), LONG) + 1)})
            if len(seen) > 4 * WORDS:
                yield rows()
                seen.clear()
    yield rows()


def _weights(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """How much likelier each stem makes a toxic text than it is anyway, as a logarithm, drawn to zero where few texts have it."""
    prior = (toxic + 1) / (toxic + clean + 2)
    out = {}
    for stem, t, c in counts:
        p = (t + SHRINK * prior) / (t + c + SHRINK)
        w = math.log(p / (1 - p)) - math.log(prior / (1 - prior))
        if t >= SUPPORT and w >= LEAST:
            out[stem] = w
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and, last, the bias, by Newton's method; the weights are drawn to PRIOR."""
    x = np.c_[x, np.ones(len(x))]
    mean, firm = np.r_[PRIOR, 0.0], np.r_[np.full(len(PRIOR), FIRM), 1e-3]
    w = np.r_[PRIOR, -2.2]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(firm), x.T @ (p - y) + firm * (w - mean))
        w = w - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Stems and weights from texts whose crc32(doc_id) mod 3 isn't 1 and their labels (doc_id, toxic 0 or 1).

    Of each label at most SAMPLE doc_ids are used, those with the least hash; equal texts count once, as toxic if any row says so,
    and each whole. Stems are counted in two folds, and those of one give the features of the other that the weights of
    matches are fitted on. Only counts of at most STEMS stems and the features of the sample go to the driver. Null labels and
    texts are left out; without any, or with one label only, the model has no stems and the weights it starts from."""
    work = Scratch(docs.sparkSession, "toxicity")
    told = labels.filter(F.col("toxic").isin(0, 1) & learned_from()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = None
    for t in (0, 1):
        some = told.filter(F.col("toxic") == t).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
        chosen = some if chosen is None else chosen.union(some)
    chosen = work.table(chosen)
    rows = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(chosen), "id")  # of a fixed size
    kind = 2 * F.pmod(F.xxhash64("text"), F.lit(2)).cast("int") + F.col("toxic")
    sample = work.table(rows.groupBy("text").agg(F.max("toxic").alias("toxic")).select("text", kind.alias("kind")))
    n = {k: 0 for k in range(4)} | {r[0]: r[1] for r in sample.groupBy("kind").count().collect()}
    if not (n[0] + n[2] and n[1] + n[3]):
        return Model()
    with batches_of(docs.sparkSession, TEXTS):
        by_kind = sample.mapInArrow(_count, "stem string, kind int, n long").groupBy("stem").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(4)])
        counts = by_kind.filter(F.col("n1") + F.col("n3") >= SUPPORT).orderBy(F.desc(F.col("n1") + F.col("n3")), F.col("n0") + F.col("n2"), "stem").limit(STEMS).collect()
        halves = [_weights([(r.stem, r[2 + 2 * other], r[1 + 2 * other]) for r in counts], n[2 * other + 1], n[2 * other]) for other in (1, 0)]

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lexicons = [Lexicon(h) for h in halves]
            for b in batches:
                x = [features(t, lexicons[k // 2]) for t, k in zip(b.column("text").to_pylist(), b.column("kind").to_pylist(), strict=True)]
                yield pa.record_batch({"x": pa.array(x, pa.list_(pa.float64())), "y": pa.array([k % 2 for k in b.column("kind").to_pylist()], pa.int32())})

        seen = sample.mapInArrow(measure, "x array<double>, y int").collect()
    work.drop(chosen, sample)
    stems = _weights([(r.stem, r.n1 + r.n3, r.n0 + r.n2) for r in counts], n[1] + n[3], n[0] + n[2])
    return Model(stems, _logistic(np.array([r[0] for r in seen]), np.array([r[1] for r in seen], float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1, higher is more likely toxic) and predicted (1 from LIMIT on), in place of columns of that name.

    A score depends on the text alone. Each row comes back, equal ones and null doc_ids too; null and empty texts get
    the score of a text without matches; long texts are read whole, piece by piece; an empty table stays empty. The result is a
    table in the shared folder."""
    own = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.stems)
        for b in batches:
            x = np.array([features(t, lexicon) for t in b.column("text").to_pylist()]).reshape(len(b), len(PRIOR))
            s = model.scores(x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array((s >= LIMIT).astype(np.int32), pa.int32())], names=[*b.schema.names, "score", "predicted"])

    schema = StructType([*own.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return Scratch(docs.sparkSession, "toxic").table(own.mapInArrow(run, schema), TEXTS)


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", (~F.coalesce(learned_from(), F.lit(True))).alias("held_out"), "score", "predicted")
