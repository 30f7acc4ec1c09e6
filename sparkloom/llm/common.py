"""Shared folder tables and small helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Stands for a null doc_id where an order or a join needs a value.
NO_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a single machine, where that is unset,
    one of our own."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    return _OWN[app]


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Meanwhile at most so many rows go to Python in one batch."""
    held = spark.conf.get(_BATCH)
    if rows:
        spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, held)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class Scratch:
    """Parquet tables of one operator call in the shared folder; they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self._n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def table(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """df as a table; rows: how many of them at most go to Python in one batch, where they may be large."""
        self._n += 1
        path = f"{self.base}/{self._n}"
        with batches_of(self.spark, rows):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that no later plan reads."""
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def kept_dir(spark: SparkSession, name: str, of: str) -> str:
    """Where a query keeps what it learnt of the data in the folder `of`."""
    return f"{shared_dir(spark)}/{name}/{hashlib.sha256(of.encode()).hexdigest()[:16]}"


class Kept:
    """Rows that outlive a call, in a folder of Parquet files that grows by whole appends."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def read(self) -> DataFrame | None:
        return self.spark.read.schema(self.schema).parquet(self.path) if exists(self.spark, self.path) else None

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").option("compression", "zstd").parquet(self.path)


def afresh(df: DataFrame, *keys: str) -> DataFrame:
    """df with whole-number keys of which Spark no longer knows that they are partitioned: a join on them shuffles
    an aggregated df once more, and only then splits the hot keys of the other side."""
    return df.withColumns({k: F.col(k).bitwiseXOR(F.lit(0).cast("long")) for k in keys})


_MARK = "own:"


def hidden(docs: DataFrame) -> DataFrame:
    """docs with its columns of names in __, which operators use for themselves, under others until `shown`."""
    return docs.withColumnsRenamed({c: _MARK + c for c in docs.columns if c.startswith("__")})


def shown(out: DataFrame) -> DataFrame:
    return out.withColumnsRenamed({c: c.removeprefix(_MARK) for c in out.columns if c.startswith(_MARK + "__")})


def blank(col: str | Column) -> Column:
    """A null text is empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def known_id(col: str) -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(NO_ID))


def given_id(col: str) -> Column:
    return F.when(F.col(col) != NO_ID, F.col(col))
