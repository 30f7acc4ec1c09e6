
from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


class _Latest:
    """Rows by namespace and id in files that are only ever added to; of an id the row of the last write counts.

    A write is one append of its own rows, stamped with its time and a key of its own, so that writers don't touch each other's
    and a write that is lost midway leaves nothing behind. compact() writes anew what counts."""

    ORDER = "written long, writer string, seq long"

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, f"{schema}, {self.ORDER}, namespace string"

    def _rows(self, namespace: str) -> DataFrame:
        return _read(self.spark, self.path, self.schema).filter(F.col("namespace") == namespace)

    def _last(self, namespace: str) -> DataFrame:
        last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("written"), F.desc("writer"), F.desc("seq")))
        return self._rows(namespace).withColumn("__k", last).filter("__k = 1").drop("__k", "written", "writer", "seq")

    def _write(self, namespace: str, rows: DataFrame) -> None:
        mark = {"written": F.lit(time.time_ns()), "writer": F.lit(uuid.uuid4().hex), "seq": F.monotonically_increasing_id(), "namespace": F.lit(namespace)}
        rows.withColumns(mark).write.mode("append").partitionBy("namespace").parquet(self.path)

    def compact(self, namespace: str) -> None:
        """Leaves one row for each id. What counts is added first and the files before it go after that, so that a reader
        always finds it; a run that is cut off leaves rows that don't count, no gap."""
        old = [r[0] for r in self._rows(namespace).select(F.input_file_name()).distinct().collect()]
        self._write(namespace, self._last(namespace).drop("namespace"))
        for name in old:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, False)

    def count(self, namespace: str) -> int:
        return self._rows(namespace).select("id").distinct().count()

    def drop(self, namespace: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/namespace={self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(namespace)}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class VectorStore(_Latest):
    """8, 10, 11, 63: vectors by namespace; the last record of an id wins."""

    def __init__(self, spark: SparkSession, path: str, dim: int):
        super().__init__(spark, path, "id string, vector array<double>, file string")
        self.dim = dim

    def read(self, namespace: str) -> DataFrame:
        return self._last(namespace)

    def upsert(self, namespace: str, records: DataFrame) -> None:
        """records (id, vector, file), of which of an id the last one counts. A vector of another dimension fails the write as a whole."""
        right = F.assert_true(F.size("vector") == self.dim, F.lit("a vector has another dimension than its store"))
        self._write(namespace, records.filter(right.isNull()).select("id", "vector", "file"))


class TextStore(_Latest):
    """9: texts by namespace and id; an id that is put again has the new text, one that isn't there is left out."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, "id string, text string")

    def put(self, texts: DataFrame, namespace: str = "default") -> None:
        self._write(namespace, texts.select("id", "text"))

    def get(self, ids: DataFrame, namespace: str = "default") -> DataFrame:
        return self._last(namespace).select("id", "text").join(ids.select("id").distinct(), "id")


class AnalysisCache:
    """14, 16: analyses written once for each (repo, sha, version), and the latest of them."""

    SCHEMA = "repo string, sha string, version int, indexed_at timestamp, result string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        return _read(self.spark, self.path, self.SCHEMA)

    def save(self, rows: DataFrame) -> int:
        """Appends what isn't there; returns how many rows that were."""
        new = rows.dropDuplicates(["repo", "sha", "version"]).join(self.read().select("repo", "sha", "version"), ["repo", "sha", "version"], "left_anti")
        n = new.count()
        if n:
            new.select("repo", "sha", "version", "indexed_at", "result").write.mode("append").parquet(self.path)
        return n

    def latest(self, limit: int = 50) -> DataFrame:
        return self.read().select("repo", "sha", "indexed_at").orderBy(F.desc("indexed_at"), "repo", "sha").limit(min(limit, 50))


def pricing(maps: DataFrame) -> DataFrame:
    """20: (model, input, output) of rows (json), each a map of models to prices; entries without two non-negative numbers are left out, and so
    are rows that aren't maps."""
    row = maps.select(F.explode(F.from_json("json", "map<string, string>")).alias("model", "p"))
    price = F.from_json("p", "input double, output double")
    return row.select("model", price["input"].alias("input"), price["output"].alias("output")).filter("input >= 0 and output >= 0")


def export_trace(spans: DataFrame, path: str) -> None:
    """19: spans as lines of JSON."""
    spans.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def export_traces(spans: DataFrame, sinks: dict[str, Callable[[DataFrame], None]]) -> dict[str, str]:
    """19: spans to several sinks by name. A sink that fails stops neither the others nor the run; returns what each came to."""
    out = {}
    for name, sink in sinks.items():
        try:
            sink(spans)
            out[name] = "ok"
        except Exception as e:  # whatever a sink may raise
            out[name] = f"failed: {type(e).__name__}"
    return out


def dataset_violations(questions: DataFrame) -> DataFrame:
    """18, 220: questions (id, question, expected_files) that break a dataset's rules, by rule."""
    twice = questions.groupBy("id").count().filter("count > 1").select("id", F.lit("duplicate-id").alias("rule"))
    blank = questions.filter(F.coalesce(F.trim("question"), F.lit("")) == "").select("id", F.lit("empty-question"))
    missing = questions.filter(F.col("expected_files").isNull()).select("id", F.lit("no-expectation"))
    return twice.union(blank).union(missing)


def open_stores(spark: SparkSession, path: str | None, fallback: str, dim: int) -> tuple[VectorStore, TextStore, list[str]]:
    """13: the stores under path, or under the fallback where none is given or it can't be written, with a notice."""
    notices = []
    if path:
        try:
            probe = spark._jvm.org.apache.hadoop.fs.Path(path)
            probe.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(probe)
        except Exception as e:  # any store's own kind of refusal
            notices.append(f"store-unavailable: {type(e).__name__}")
            path = None
    else:
        notices.append("store-not-configured")
    base = path or fallback
    return VectorStore(spark, f"{base}/vectors", dim), TextStore(spark, f"{base}/texts"), notices
