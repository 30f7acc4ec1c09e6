"""Cutting the lineage of iterative plans, and spreading inputs of few parts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
_OWN: dict[str, str] = {}
_KEPT: dict[tuple, object] = {}


def folder_for(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; on a single machine, where that is unset, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    return _OWN[context.applicationId]


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a Parquet table in that folder."""
    path = f"{folder_for(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes tables of `cut` that no later plan reads."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._cut_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def kept(spark: SparkSession, path: str, name: str, make: Callable[[], T]) -> T:
    """What make gives for the data at path, made once in an application as long as the files there stay the same.

    Files are told by name, size and time. What was made for other files of that path is let go; its tables stay in their folder, as
    plans may still read them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    key, state = (spark.sparkContext.applicationId, name, path), tuple(sorted(seen))
    if key not in _KEPT or _KEPT[key][0] != state:
        _KEPT[key] = (state, make())
    return _KEPT[key][1]


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its input has fewer parts than there are cores; as it is, without a shuffle, elsewhere."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
