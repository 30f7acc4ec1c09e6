"""

Lines of one order that follow each other are an edge between their files. SQL holds the same views for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, src, dst, kind, line, confidence, evidence: imports, calls and inheritance between files."""
    after = Window.partitionBy("l_orderkey").orderBy(*ORDER)
    kind = F.when(F.col("l_returnflag") == "N", "import").when(F.col("l_returnflag") == "R", "call").otherwise("inheritance")
    rows = lines(spark, sf_dir).withColumn("dst", F.lead("l_suppkey").over(after)).filter("dst is not null")
    return rows.select(F.col("o_custkey").alias("repo"), F.col("l_suppkey").alias("src"), "dst", kind.alias("kind"), F.col("l_linenumber").cast("int").alias("line"), F.round(1 - 4 * F.col("l_discount"), 2).alias("confidence"), F.col("l_partkey").alias("evidence"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, file, loc, symbols, folder (the supplier's nation)."""
    own = lines(spark, sf_dir).groupBy(F.col("o_custkey").alias("repo"), F.col("l_suppkey").alias("file")).agg(F.sum("l_quantity").cast("long").alias("loc"), F.count("*").alias("symbols"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file"), F.col("s_nationkey").alias("folder"))
    return own.join(suppliers, "file").select("repo", "file", "loc", "symbols", "folder")


EDGES_SQL = f"""
edges as (
  select * from (
    select o_custkey as repo, l_suppkey as src, lead(l_suppkey) over (partition by l_orderkey order by {", ".join(ORDER)}) as dst,
           case l_returnflag when 'N' then 'import' when 'R' then 'call' else 'inheritance' end as kind, l_linenumber::int as line,
           round(1 - 4 * l_discount, 2) as confidence, l_partkey as evidence
    from lineitem join orders on l_orderkey = o_orderkey) where dst is not null)"""
NODES_SQL = """
nodes as (
  select o_custkey as repo, l_suppkey as file, sum(l_quantity)::bigint as loc, count(*) as symbols, any_value(s_nationkey) as folder
  from lineitem join orders on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey group by all)"""
