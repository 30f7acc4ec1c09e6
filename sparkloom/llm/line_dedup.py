"""Line dedup, by native operations only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blank, hidden, known_id, shown

MIN_CHARS, MIN_DOCS = 40, 5
SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased and nothing else."""
    bare = F.trim(line, F.lit(SPACE))
    folded = F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(folded)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Drops lines that many documents hold, but for those of the largest doc_id.

    Lines are exploded with their positions and hashed; only hashes of long keys move. Distinct documents
    are counted per 128-bit hash; the positions to drop come back to each document, whose other lines are
    joined again in their order.

    Returns the columns of docs, with text replaced, and n_lines, n_dropped (these replace columns of
    that name). A null or empty text has one empty line and stays as it is. Rows with the same doc_id
    count as one document; identical rows are treated alike and all returned. A null doc_id counts as one
    document smaller than all others. An empty table gives an empty table.
    """
    work, docs = Scratch(docs.sparkSession, "lines"), hidden(docs)
    row = {"__id": known_id("doc_id"), "__t": F.xxhash64("text")}
    lines = docs.select(*[c.alias(n) for n, c in row.items()], F.posexplode(F.split(blank("text"), "\n", -1)).alias("__pos", "__line"))
    keys = lines.withColumn("__line", F.trim("__line", F.lit(SPACE))).filter(F.char_length("__line") >= min_chars).select("__id", "__t", "__pos", line_key(F.col("__line")).alias("__key"))
    keys = work.table(keys.select("__id", "__t", "__pos", F.xxhash64("__key").alias("__h"), F.xxhash64("__key", F.lit(1)).alias("__g")))
    often = keys.groupBy("__h", "__g").agg(F.count_distinct("__id").alias("__n"), F.max("__id").alias("__last")).filter(F.col("__n") >= min_docs).drop("__n")
    often = work.table(often)  # a side of its own, so that a line in very many documents can be split in the join
    drops = keys.join(often, ["__h", "__g"]).filter("__id <> __last").groupBy("__id", "__t").agg(F.array_sort(F.collect_set("__pos")).alias("__drop"))
    own = docs.withColumns(row)
    out = own.join(drops, [own["__id"].eqNullSafe(drops["__id"]), own["__t"].eqNullSafe(drops["__t"])], "left").drop("__id", "__t")
    out = out.withColumns({"__lines": F.split(blank("text"), "\n", -1), "__drop": F.coalesce("__drop", F.expr("cast(array() as array<int>)"))})
    out = out.withColumns({"n_lines": F.size("__lines").cast("long"), "n_dropped": F.size("__drop").cast("long")})
    # the runs of lines between two dropped positions, each one slice: linear in lines and drops
    runs = "transform(sequence(0, size(__drop)), i -> slice(__lines, {a} + 1, greatest({b} - {a}, 0)))".format(
        a="if(i = 0, 0, __drop[i - 1] + 1)", b="if(i = size(__drop), size(__lines), __drop[i])"
    )
    kept = F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.array_join(F.flatten(F.expr(runs)), "\n"))
    return shown(out.withColumn("text", kept).drop("__lines", "__drop"))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    kept = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(blank("text").cast("binary"), 256).alias("kept_sha256"))


_TRIM = r"regexp_replace(line, '^[ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+$', '', 'g')"
OP9_SQL = rf"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
keyed as (
  select doc_id, pos, line, translate({_TRIM}, '{string.ascii_uppercase}', '{string.ascii_lowercase}') as k from lines),
often as (
  select k, max(doc_id) as last from keyed where length(k) >= {MIN_CHARS} group by k having count(distinct doc_id) >= {MIN_DOCS}),
marked as (
  select keyed.*, (often.k is not null and doc_id <> last) as dropped from keyed left join often using (k))
select doc_id, count(*)::bigint as n_lines, count(*) filter (where dropped)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from marked group by doc_id
"""
