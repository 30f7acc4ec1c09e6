"""MinHash near-dedup by a multi-index Hamming join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, afresh, blank, given_id, known_id
from .components import components

#: A signature is SYMBOLS minima of 16 bits each, in CHUNKS chunks. Two signatures that differ in at most
#: CHUNKS * (ERRORS + 1) - 1 symbols have a chunk with at most ERRORS differences, by the pigeonhole principle.
SYMBOLS, CHUNKS, ERRORS = 96, 20, 1
SIMILARITY = 80  # per cent
WORDS = 5
#: Rows that go to Python in one batch: texts, and pairs or rows with whole sets.
TEXTS, SETS = 1024, 256
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_RNG = np.random.default_rng(4)
_A = _RNG.integers(0, 2**32, SYMBOLS, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 2**32, SYMBOLS, dtype=np.uint32)


class _Words(dict):
    """Hashes of words met before; emptied when full, as only speed depends on it."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int, seen: dict) -> np.ndarray:
    """Sorted hashes of the distinct word shingles: A-Z lower-cased, words cut at ASCII white space."""
    own = text.encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return np.empty(0, np.uint64)
    n = min(words, len(own))
    h = np.fromiter(map(seen.__getitem__, own), np.uint64, len(own))
    out = np.full(len(own) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mix(out + h[i : len(own) - n + 1 + i] + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    least = np.full(SYMBOLS, 2**32 - 1, np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(least, (_A[:, None] * x[None, at : at + 2048] + _B[:, None]).min(axis=1), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2")


def chunk_keys(sigs: np.ndarray) -> np.ndarray:
    """For each signature the keys under which it is filed: of each chunk, every choice of ERRORS symbols left out."""
    part = _mix(sigs.astype(np.uint64) + (np.arange(SYMBOLS, dtype=np.uint64) << np.uint64(16)) + np.uint64(1))
    out = []
    for k, at in enumerate(np.array_split(np.arange(SYMBOLS), CHUNKS)):
        total = part[:, at].sum(axis=1)
        for left in combinations(at, ERRORS):
            out.append(_mix(total - part[:, left].sum(axis=1) + np.uint64((k << 32) + sum(int(i) << (8 * j) for j, i in enumerate(left)))))
    return np.stack(out, axis=1)


def _read(words: int, full: bool):
    """full: the sets; else signatures and set sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Words()
        for b in batches:
            for at in range(0, len(b), 512):
                x = b.slice(at, 512)
                sets = [shingles(t, words, seen) for t in x.column("text").to_pylist()]
                digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                if full:
                    yield pa.record_batch({"digest": digests, "set": pa.array([s.tobytes() for s in sets], pa.binary())})
                else:
                    sigs = [signature(s) for s in sets]
                    low = [s.astype(np.uint8).view("<i8") for s in sigs]
                    yield pa.record_batch({"id": x.column("id"), "digest": digests, "n": pa.array([len(s) for s in sets], pa.int64()), "sig": pa.array([s.tobytes() for s in sigs], pa.binary()), "sketch": pa.array(low, pa.list_(pa.int64()))})

    return run


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, len(b), 2048):
            x = b.slice(at, 2048)
            keys = chunk_keys(np.frombuffer(b"".join(x.column("sig").to_pylist()), "<u2").reshape(-1, SYMBOLS))
            nodes = np.repeat(x.column("node").to_numpy(), keys.shape[1])
            yield pa.record_batch({"key": pa.array(keys.reshape(-1).view(np.int64)), "node": pa.array(nodes)})


def _distance(a: str, b: str) -> Column:
    """In how many symbols two signatures differ, by their low bytes: eight to a number of the arrays a and b.
    Of each byte of the numbers' difference all bits are brought together in the lowest one and counted."""
    terms = []
    for i in range(SYMBOLS // 8):
        x = f"({a}[{i}] ^ {b}[{i}])"
        terms.append(f"bit_count(({' | '.join([x, *(f'shiftrightunsigned({x}, {k})' for k in range(1, 8))])}) & {0x0101010101010101})")
    return F.expr(" + ".join(terms))


def _near(a: str, b: str) -> Column:
    """Whether two nodes are under the signature-distance threshold; sizes that rule out the similarity are tested first."""
    sizes = (100 * F.least(f"n_{a}", f"n_{b}") >= SIMILARITY * F.greatest(f"n_{a}", f"n_{b}"))
    return sizes & (_distance(f"sketch_{a}", f"sketch_{b}") <= CHUNKS * (ERRORS + 1) - 1)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose full sets are similar enough."""
    for b in batches:
        keep = []
        for x, y in zip(b.column("set_a").to_pylist(), b.column("set_b").to_pylist(), strict=True):
            either = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]), kind="stable")
            both = int((either[1:] == either[:-1]).sum())
            keep.append(100 * both >= SIMILARITY * (len(either) - both))
        keep = pa.array(keep, pa.bool_())
        yield pa.record_batch({c: b.column(c).filter(keep) for c in ("a", "b")})


#: Rows of a key and of a family that are compared with each other in one task, and their shingles; larger groups are
#: cut into blocks, and each two blocks meet in a task of their own.
KEY_BLOCK, FAMILY_BLOCK, BLOCK_SHINGLES = 4096, 2048, 1_000_000
_PAIRS = 30_000


def _in_blocks(rows: DataFrame, group: str, block: int) -> DataFrame:
    """rows (group, node, n, ...) with block and the two blocks pa and pb that meet, once for each meeting."""
    size = rows.groupBy(group).agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    own = rows.join(afresh(size, group), group).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meet = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("pa"), F.greatest("block", j).alias("pb")))
    own = own.withColumn("meet", F.explode(meet)).select("*", "meet.pa", "meet.pb").drop("meet", "blocks")
    return own.repartition(group, "pa", "pb").sortWithinPartitions(group, "pa", "pb", "node")


def _groups(batches: Iterator[pa.RecordBatch], group: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, and where the groups start and the last one ends; rows come sorted by group."""
    left = None
    for b in _ended(batches):
        now = left if b is None else pa.Table.from_batches([b]) if left is None else pa.concat_tables([left, pa.Table.from_batches([b])])
        if now is None or not len(now):
            continue
        ids = np.stack([now.column(c).to_numpy() for c in (group, "pa", "pb")])
        starts = np.flatnonzero(np.r_[True, (ids[:, 1:] != ids[:, :-1]).any(axis=0)])
        whole = len(now) if b is None else int(starts[-1])
        left = now.slice(whole)
        if whole:
            yield now.slice(0, whole), np.append(starts[starts < whole], whole)


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _signatures(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u2").reshape(-1, SYMBOLS)


class _Union(dict):
    def find(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = x = self.get(up, up)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self[max(x, y)] = min(x, y)
        return x != y


def _pairs(starts: np.ndarray, blocks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs of rows within groups, in slices: (group, row, row). Where two blocks meet, pairs lie across them."""
    out, n = [], 0
    for g, (lo, hi) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
        mixed = len(np.unique(blocks[lo:hi])) > 1
        for i in range(lo, hi - 1):
            j = np.arange(i + 1, hi)
            j = j[blocks[j] != blocks[i]] if mixed else j
            out.append((np.full(len(j), g), np.full(len(j), i), j))
            n += len(j)
            if n >= _PAIRS:
                yield tuple(np.concatenate(x) for x in zip(*out, strict=True))
                out, n = [], 0
    if out:
        yield tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _near_pairs(t: pa.Table, starts: np.ndarray, sigs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of one group with different roots that are under the signature distance."""
    root, n, blocks = (t.column(c).to_numpy() for c in ("root", "n", "block"))
    for g, i, j in _pairs(starts, blocks):
        ok = (root[i] != root[j]) & (100 * np.minimum(n[i], n[j]) >= SIMILARITY * np.maximum(n[i], n[j]))
        g, i, j = g[ok], i[ok], j[ok]
        ok = (sigs[i] != sigs[j]).sum(axis=1) <= CHUNKS * (ERRORS + 1) - 1
        yield g[ok], i[ok], j[ok]


def _touching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each key its nodes that are near others, each with the least one that it is connected with by near pairs;
    a pair counts under its first common key. That is linear in the nodes, and keys of one family name the same few."""
    for t, starts in _groups(batches, "key"):
        sigs, node, key = _signatures(t), t.column("node").to_numpy(), t.column("key").to_numpy()
        own = (chunk_keys(sigs[starts[:-1]]).view(np.int64) == key[starts[:-1], None]).argmax(axis=1)
        trees: dict[int, _Union] = {}
        for g, i, j in _near_pairs(t, starts, sigs):
            if len(g):
                rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
                keys = chunk_keys(sigs[rows])
                first = (keys[at[: len(i)]] == keys[at[len(i) :]]).argmax(axis=1) == own[g]
                for k, x, y in zip(g[first].tolist(), node[i[first]].tolist(), node[j[first]].tolist(), strict=True):
                    trees.setdefault(k, _Union()).join(x, y)
        out = sorted({(u.find(x), x) for u in trees.values() for x in list(u)})
        a, b = zip(*out, strict=True) if out else ((), ())
        yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between different components within each family, confirmed on full sets: a forest over the components."""
    for t, starts in _groups(batches, "family"):
        for at, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            yield _linked(t.slice(at, end - at))


def _linked(t: pa.Table) -> pa.RecordBatch:
    """Of one family or two of its blocks."""
    sigs, node, root = _signatures(t), t.column("node").to_numpy(), t.column("root").to_pylist()
    sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
    known, numbers = np.unique(np.concatenate(sets), return_inverse=True)
    numbers = numbers.astype(np.int32)  # a block has far fewer shingles than 2**31
    sets = np.split(numbers, np.cumsum([len(x) for x in sets])[:-1])
    has, joined, out = np.zeros(len(known), bool), _Union(), []
    for _, i, j in _near_pairs(t, np.array([0, len(t)]), sigs):
        for x in np.unique(i).tolist():
            ys = [y for y in j[i == x].tolist() if joined.find(root[y]) != joined.find(root[x])]
            if not ys:
                continue
            has[sets[x]] = True
            size = np.array([len(sets[y]) for y in ys])
            both = np.add.reduceat(has[np.concatenate([sets[y] for y in ys])], np.cumsum(size) - size, dtype=np.int64)
            has[sets[x]] = False
            for y in np.array(ys)[100 * both >= SIMILARITY * (size + len(sets[x]) - both)].tolist():
                if joined.join(root[x], root[y]):
                    out.append((int(node[x]), int(node[y])))
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_groups(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Groups documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

    Equal sets, told by 128 bits, are one node. Every node files its signature under the keys of its chunks; only keys
    of several nodes go on. First each node is paired with the least node under most of its keys, one pair for a
    node whatever the groups' sizes; pairs over the signature distance go, the rest are confirmed on full sets,
    and links become components. What is left are near pairs under one key in different components. For each key a
    forest over these tells which nodes belong to a family, and in a family all of them are confirmed. Every step
    returns at most a row for each row it read; pairs are compared, in blocks of bounded size, but never listed. So no
    link under the threshold is lost. A pair of similarity 0.8 exceeds the distance of 39 of 96 with a probability
    of 1e-6, one of 0.85 with 3e-10.

    Returns doc_id, n_shingles, component_id (the least doc_id of the group), kept (doc_id = component_id).
    A null or wordless text has no shingles and is linked with nothing; one with fewer words than a shingle is one
    shingle; a text of any length is one row and its set whole. Repeated rows are one node and get the same values; null
    doc_ids count as the least; an empty table gives an empty table.
    """
    work = Scratch(docs.sparkSession, "neardup")
    source = docs.select(known_id("doc_id").alias("id"), blank("text").alias("text"))
    sigs = work.table(source.mapInArrow(_read(words, False), "id long, digest binary, n long, sig binary, sketch array<long>"), TEXTS)
    first = lambda c: F.first(c).alias(c)  # noqa: E731  the same in all rows of a digest
    nodes = sigs.filter("n > 0").groupBy("digest").agg(F.min("id").alias("id"), first("n"), first("sig"), first("sketch"))
    nodes = work.table(nodes.withColumn("node", F.monotonically_increasing_id()))  # a number for each digest, kept with it
    keys = nodes.select("node", "sig").mapInArrow(_file, "key long, node long")
    reps = keys.groupBy("key").agg(F.min("node").alias("rep"), F.max("node").alias("last")).filter("rep < last").select("key", "rep")
    reps = work.table(reps)  # a side of its own, so that a key of very many nodes is split in the join
    shared = work.table(keys.join(reps, "key"))
    work.drop(reps)

    def of(c: str) -> DataFrame:
        return nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))

    def sets_of(need: DataFrame) -> DataFrame:
        own = nodes.join(need, "node", "left_semi").select("node", "digest", "id")
        texts = source.join(own.select("id").distinct(), "id", "left_semi").select("text")
        sets = texts.mapInArrow(_read(words, True), "digest binary, set binary").join(own.select("node", "digest"), "digest")
        return work.table(sets.select("node", "set").dropDuplicates(["node"]), TEXTS)

    most = shared.filter("rep <> node").groupBy("node", "rep").count().groupBy("node").agg(F.max_by("rep", F.struct("count", "rep")).alias("rep"))
    most = most.select(F.col("rep").alias("a"), F.col("node").alias("b")).join(of("b"), "b").join(of("a"), "a").filter(_near("a", "b"))
    most = work.table(most.select("a", "b"))
    sets = sets_of(most.select(F.col("a").alias("node")).union(most.select("b")).distinct())
    has = lambda c: sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}"))
    pairs = most.join(has("b"), "b").join(has("a"), "a").select("a", "b", "set_a", "set_b")
    links = work.table(pairs.mapInArrow(_confirm, "a long, b long"), SETS)
    work.drop(sets, most)
    roots = components(links, work)
    placed = shared.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = work.table(placed.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r < s").select("key"))
    placed = placed.join(split, "key", "left_semi").join(nodes.select("node", "n", "sig"), "node")
    touching = work.table(_in_blocks(placed, "key", KEY_BLOCK).mapInArrow(_touching, "a long, b long"))
    work.drop(shared, split)
    if not touching.isEmpty():
        family = components(touching, work).withColumnRenamed("root", "family").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        family = work.table(family.join(nodes.select("node", "n", "sig"), "node"))
        sets = sets_of(family.select("node"))
        more = work.table(_in_blocks(family.join(sets, "node"), "family", FAMILY_BLOCK).mapInArrow(_link, "a long, b long"), SETS)
        work.drop(family, sets)
        if not more.isEmpty():
            roots = components(links.union(more), work)
        work.drop(more)
    work.drop(links, touching)
    of = nodes.select("node", "digest", "id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of = of.join(afresh(of.groupBy("root").agg(F.min("id").alias("component")), "root"), "root").select("digest", "component")
    out = sigs.select("id", "digest", "n").join(of, "digest", "left")
    out = out.withColumn("component", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")))
    return out.select(given_id("id").alias("doc_id"), F.col("n").alias("n_shingles"), given_id("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2)


OP4_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0b\x0c\r]+') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) = 1 then w
                      else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s from words),
one as (select doc_id, unnest(s) as g from sets),
common as (
  select x.doc_id as a, y.doc_id as b, count(*) as n from one x join one y on x.g = y.g and x.doc_id < y.doc_id group by all),
links as (
  select a, b from common join sets p on p.doc_id = a join sets q on q.doc_id = b where 100 * n >= 80 * (len(p.s) + len(q.s) - n)),
both_ways as (select a, b from links union all select b, a from links),
reach(doc_id, other) as (
  select doc_id, doc_id from sets union select reach.doc_id, both_ways.b from reach join both_ways on both_ways.a = reach.other)
select doc_id, any_value(len(s))::bigint as n_shingles, min(other) as component_id, doc_id = min(other) as kept
from sets join reach using (doc_id) group by doc_id
"""
