"""From documents to packed sequences: language ID, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch, hidden, known_id, shown
from sparkloom.llm.decontamination import contaminated
from sparkloom.llm.language_id import LETTER, UNDECIDED, fit, identify
from sparkloom.llm.line_dedup import dedup_lines
from sparkloom.llm.near_dedup import near_groups
from sparkloom.llm.packing import pack
from sparkloom.plans.ship import shipped

#: A document goes if no language gets this share; clean text of one language gets 0.9 and more.
LEAST_SCORE = 0.35


def _aside(docs: DataFrame, *names: str) -> DataFrame:
    """docs with columns of these names under others, which an operator's own columns don't replace."""
    return docs.withColumnsRenamed({c: f"aside:{c}" for c in docs.columns if c in names})


def _back(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return out.select(*[F.col(f"aside:{c}").alias(c) if f"aside:{c}" in out.columns else F.col(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or in no clear language go; where no language is given to learn from, only the former."""
    own = _aside(docs, "lang_pred", "score")
    model = fit(own)
    if model is None:
        return docs.filter(F.col("text").rlike(LETTER))
    return _back(identify(own, model).filter((F.col("lang_pred") != UNDECIDED) & (F.col("score") >= LEAST_SCORE)), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold go; n_chars follows the text."""
    out = dedup_lines(_aside(docs, "n_lines", "n_dropped"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return _back(out, docs)


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs as a table in which __row tells each row from all others, equal ones and those without doc_id too."""
    return Scratch(docs.sparkSession, name).table(hidden(docs).withColumn("__row", F.monotonically_increasing_id()))


def _by_row(rows: DataFrame) -> DataFrame:
    """What an operator sees of numbered rows: each a document of its own."""
    return rows.select(F.col("__row").alias("doc_id"), "text")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that with the least doc_id; a null counts as the least."""
    rows = _numbered(docs, "near")
    groups = near_groups(_by_row(rows)).select(F.col("doc_id").alias("__row"), "component_id")
    first = groups.join(rows.select("__row", known_id("doc_id").alias("__id")), "__row").groupBy("component_id").agg(F.min(F.struct("__id", "__row")).alias("x"))
    return shown(rows.join(first.select("x.__row"), "__row", "left_semi").drop("__row")).select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold copies of test items go, and no others."""
    rows = _numbered(docs, "benchmark")
    found = contaminated(_by_row(rows), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return shown(rows.join(found.select(F.col("doc_id").alias("__row")).distinct(), "__row", "left_anti").drop("__row")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences, without their ids."""
    return pack(docs).drop("ids")


STAGES = [
    (name, shipped(f))
    for name, f in (("language ID", language), ("line dedup", lines), ("MinHash near-dedup", near_copies), ("benchmark decontamination", benchmark), ("packing", packing))
]

#: The network and the curve aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = work.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
