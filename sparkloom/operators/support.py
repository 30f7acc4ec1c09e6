
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse as P
from .relational import shown
from .telemetry import set_diff


def embed_header(file: Column, language: Column, scope: Column, symbol: Column, signature: Column, doc: Column) -> Column:
    """57: what is put before a chunk's text for embedding; parts that are null are left out."""
    parts = {"file": file, "language": language, "scope": scope, "symbol": symbol, "signature": signature, "doc": doc}
    return F.concat_ws("\n", *[F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c)) for name, c in parts.items()])


def embed_key(model: str, text: Column) -> Column:
    """59: the key of a text's vector in a cache; line ends are made alike first."""
    return F.sha2(F.concat(F.lit(f"{model}\n"), F.replace(text, F.lit("\r\n"), F.lit("\n"))).cast("binary"), 256)


def action(text: Column) -> list[Column]:
    """64, 65: the first JSON object in a model's answer, and whether it is a tool call, an answer or neither."""
    found = P.json_object(text)
    kind = F.get_json_object(found, "$.action")
    return [found.alias("object"), F.when(kind.isin("tool", "answer"), kind).otherwise("unparseable").alias("kind")]


def repo_summary(nodes: DataFrame) -> DataFrame:
    """104: files, lines, symbols and folders of each repository."""
    folders = F.array_join(F.array_sort(F.collect_set("folder")).cast("array<string>"), ",")
    return nodes.groupBy("repo").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"), F.sum("symbols").alias("symbols"), F.count_distinct("folder").alias("folders"), folders.alias("folder_list"))


def ground_chunks(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """123: chunks (file, start, end) with grounded: whether their file (file, lines) is known and has those lines."""
    inside = (F.col("start") >= 1) & (F.col("end") >= F.col("start")) & (F.col("end") <= F.col("lines"))
    return chunks.join(files.select("file", "lines"), "file", "left").withColumn("grounded", F.coalesce(inside, F.lit(False))).drop("lines")


def references(edges: DataFrame, most: int = 10) -> DataFrame:
    """149: references to each file, calls among them, and the first files they come from."""
    first = F.array_join(F.slice(F.array_sort(F.collect_set("src")).cast("array<string>"), 1, most), ",")
    return edges.groupBy("repo", F.col("dst").alias("file")).agg(F.count("*").alias("references"), F.sum((F.col("kind") == "call").cast("long")).alias("callers"), first.alias("shown"))


def what_changed(snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """152: files added and removed between the last snapshot (repo, snap, at) of a repository and the one before; files are
    (snap, file)."""
    last = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("at"), F.desc("snap")))
    two = snapshots.withColumn("__k", last).filter(F.col("__k") <= 2).select("repo", "snap", "__k").join(files, "snap")
    diff = set_diff(two.filter("__k = 2"), two.filter("__k = 1"), ["repo", "file"])
    n = lambda c: F.sum((F.col("change") == c).cast("long")).alias(c)
    return diff.groupBy("repo").agg(n("added"), n("removed"))


def blackboard(findings: DataFrame) -> DataFrame:
    """163: findings, those of high importance and specialists of each cluster."""
    return findings.groupBy("cluster").agg(F.count("*").alias("findings"), F.sum((F.col("importance") == 3).cast("long")).alias("high"), F.count_distinct("specialist").alias("specialists"))


def parity(scores: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """178: of engines (engine, f1) whether each is no worse than each that follows it by name."""
    other = scores.select(F.col("engine").alias("other"), F.col("f1").alias("__f1"))
    return scores.join(other, F.col("engine") < F.col("other")).select("engine", "other", (F.col("f1") >= F.col("__f1") - tolerance).alias("holds"))


def graph_facts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """188: files, edges, lines and the first file of each repository."""
    n = nodes.groupBy("repo").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"), F.min("file").alias("entry"))
    return n.join(edges.groupBy("repo").agg(F.count("*").alias("edges")), "repo", "left").fillna(0, ["edges"])


def dataset_totals(questions: DataFrame) -> DataFrame:
    """221: questions (id, n), those that expect nothing, and the mean of n."""
    return questions.agg(F.count("*").alias("questions"), F.sum((F.col("n") == 0).cast("long")).alias("negatives"), F.round(F.avg("n"), 6).alias("mean_length"))


def entities(files: DataFrame, symbols: DataFrame, by: str, most: int = 20) -> DataFrame:
    """228: the entities of an answer, cited files (by, entity, position) before symbols of its chunks, each once."""
    every = files.select(by, "entity", F.lit(1).alias("r"), "position").union(symbols.select(by, "entity", F.lit(2), "position"))
    first = every.groupBy(by, "entity").agg(F.min(F.struct("r", "position")).alias("__first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("__first", "entity"))).filter(F.col("place") <= most).drop("__first")


def describe_diff(added: Column, removed: Column, most: int = 2) -> Column:
    """229: what was added and removed, so many of each by name."""
    more = lambda c: F.when(F.size(c) > most, F.concat(F.lit(" and "), (F.size(c) - most).cast("string"), F.lit(" more"))).otherwise("")
    part = lambda c, word: F.when(F.size(c) > 0, F.concat(F.lit(f"{word} "), F.array_join(F.slice(c, 1, most), ", "), more(c)))
    return F.concat_ws("; ", part(added, "added"), part(removed, "removed"))


def render(rows: DataFrame, by: str, order: str, line: Column) -> DataFrame:
    """230: the lines of each group in order, as one text."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("rendered"))


def queue_depth(rows: DataFrame, by: str, unreadable: Column, waiting: Column) -> DataFrame:
    """231: how many rows wait; null, not 0, where that can't be read."""
    return rows.groupBy(by).agg(F.when(~F.bool_or(unreadable), F.sum(waiting.cast("long"))).alias("depth"))


def concurrency(asked: Column, most: int = 8) -> list[Column]:
    """232: how many at once, from 1 to most, and whether another number was asked for."""
    return [F.least(F.lit(most), F.greatest(F.lit(1), asked)).cast("int").alias("concurrency"), ((asked < 1) | (asked > most)).alias("warned")]


def path_choice(nodes: DataFrame, cluster: str) -> DataFrame:
    """233: fan-out where a repository has communities to fan out over, else a single shot."""
    return nodes.groupBy("repo").agg(F.when(F.count_distinct(cluster) > 1, "fan-out").otherwise("single-shot").alias("path"))


__all__ = [n for n in dir() if not n.startswith("_")]
