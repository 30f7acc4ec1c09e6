"""Secret scans over an incremental blob ledger, by native operations only."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, Scratch, blank, kept_dir

#: Kind -> (pattern, its group whose length counts, least length).
#: A run of the hex or access alphabet is taken whole by the leftmost match, so the least length stands in
#: the pattern; a short assigned value still uses up its text, so its length is tested after the match.
RULES = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Changes with any rule.
RULE_VERSION = hashlib.sha256(repr(RULES).encode()).hexdigest()[:16]
LEDGER = "digest string, kind string, rule_version string"
FINDINGS = "digest string, kind string, rule_version string, start long, end long"


def scan_blobs(blobs: DataFrame, kinds: list[str], rule_version: str) -> DataFrame:
    """All matches in blobs (digest, text, todo: kinds to scan). Positions are code points, end exclusive.

    The text between matches and the matches alternate, so positions are running sums of their lengths,
    taken per blob and kind over the exploded matches. Of a blob's rows that match, one is kept before that; copies
    in one part are dropped before they move."""
    out = []
    for kind in kinds:
        pattern, group, least = RULES[kind]
        found = blobs.filter(F.array_contains("todo", kind)).filter(F.col("text").rlike(pattern)).select("digest", "text").dropDuplicates(["digest"])
        pieces = F.arrays_zip(
            F.transform(F.split("text", pattern, -1), F.char_length).alias("gap"),
            F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("hit"),
        )
        rows = found.select("digest", F.posexplode(pieces).alias("i", "x")).filter("x.hit is not null")
        rows = rows.select("digest", "i", F.col("x.gap").alias("gap"), F.col("x.hit").alias("hit")).withColumn("n", F.char_length("hit").cast("long"))
        rows = rows.withColumn("end", F.expr("sum(gap + n) over (partition by digest order by i rows unbounded preceding)"))
        rows = rows.filter(F.char_length(F.regexp_extract("hit", pattern, group)) >= least)
        out.append(rows.select("digest", F.lit(kind).alias("kind"), F.lit(rule_version).alias("rule_version"), (F.col("end") - F.col("n")).alias("start"), "end"))
    return reduce(DataFrame.unionByName, out)


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None, rule_version: str = RULE_VERSION, kinds: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scans the blobs of versions (doc_id, text: the path and content of each historical version) that the
    ledger doesn't know at this rule version, and joins findings back to all paths.

    ledger: (digest, kind, rule_version) already scanned; findings: what those scans found. Returns
    (per path, new ledger rows, new findings): per path has doc_id, digest and found, an array of
    (start, rank, end, kind) in order of start and then of the kinds as listed. Both new tables stand in the shared
    folder, to be appended to the caller's ledger.

    Texts are compared with the ledger by digest only, and move only where they hold a match or, with a ledger, where
    they are unseen. A null text is an empty blob, a text of any length is scanned whole; a null doc_id is a path of its
    own kind; equal rows each come back; ledger or findings may hold a row several times. The ledger grows by
    digests only, never by paths. An empty table gives empty tables.
    """
    kinds = list(RULES) if kinds is None else kinds
    work = Scratch(versions.sparkSession, "secrets")
    rows = versions.select("doc_id", blank("text").alias("text")).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    wanted = F.array(*map(F.lit, kinds))
    unseen = rows.select("digest").distinct()
    if ledger is None:
        unseen = work.table(unseen.withColumn("todo", wanted))
        blobs = rows.withColumn("todo", wanted)
    else:
        seen = ledger.filter((F.col("rule_version") == rule_version) & F.col("kind").isin(kinds)).groupBy("digest").agg(F.collect_set("kind").alias("seen"))
        unseen = unseen.join(seen, "digest", "left").withColumn("todo", F.array_except(wanted, F.coalesce("seen", F.expr("cast(array() as array<string>)"))))
        unseen = work.table(unseen.filter(F.size("todo") > 0).select("digest", "todo"))
        blobs = rows.join(unseen, "digest")
    new = work.table(scan_blobs(blobs, kinds, rule_version))
    known = new
    if findings is not None:
        old = findings.filter((F.col("rule_version") == rule_version) & F.col("kind").isin(kinds))
        known = new.unionByName(old.join(rows.select("digest").distinct(), "digest", "left_semi"))
    rank = F.array_position(wanted, F.col("kind")).cast("int")
    per_blob = known.groupBy("digest").agg(F.array_sort(F.collect_set(F.struct("start", rank.alias("rank"), "end", "kind"))).alias("found"))
    per_blob = work.table(per_blob)  # a side of its own, so that a blob with very many paths is split in the join
    none = F.expr("cast(array() as array<struct<start:bigint,rank:int,end:bigint,kind:string>>)")
    per_path = rows.select("doc_id", "digest").join(per_blob, "digest", "left").withColumn("found", F.coalesce("found", none))
    scanned = unseen.select("digest", F.explode("todo").alias("kind"), F.lit(rule_version).alias("rule_version"))
    return per_path, scanned, new


def scan_incremental(versions: DataFrame, folder: str, rule_version: str = RULE_VERSION, kinds: list[str] | None = None) -> DataFrame:
    """Per path, as scan_versions has it, by the ledger in folder, which then covers all blobs of versions.

    Findings are appended before the ledger rows that stand for them: where a run ends between the two, the next one
    scans those blobs again and the repeated findings count once."""
    spark = versions.sparkSession
    ledger, findings = Kept(spark, f"{folder}/ledger", LEDGER), Kept(spark, f"{folder}/findings", FINDINGS)
    per_path, scanned, new = scan_versions(versions, ledger.read(), findings.read(), rule_version, kinds)
    findings.append(new)
    ledger.append(scanned)
    return per_path


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_incremental(spark.read.parquet(f"{sf_dir}/documents.parquet"), kept_dir(spark, "secret-ledger", sf_dir))
    n = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(spans.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))


def _part(kind: str) -> str:
    pattern, group, least = RULES[kind]
    p = pattern.replace("'", "''")
    return f"""
  select doc_id, '{kind}' as kind, {list(RULES).index(kind)} as rank, m, sum(length(m) + g) over (partition by doc_id order by i) as e
  from (select doc_id, unnest(list_transform(string_split_regex(text, '{p}'), lambda x: length(x))[:-2]) as g,
               unnest(regexp_extract_all(text, '{p}')) as m, generate_subscripts(regexp_extract_all(text, '{p}'), 1) as i
        from docs where regexp_matches(text, '{p}')) qualify length(regexp_extract(m, '{p}', {group})) >= {least}"""


OP2_SQL = f"""
with docs as (select doc_id, coalesce(text, '') as text from documents),
found as ({" union all ".join(map(_part, RULES))}),
per as (select doc_id, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access,
               count(*) filter (where kind = 'hex') as n_hex,
               string_agg(kind || ':' || (e - length(m))::bigint || ':' || e::bigint, ',' order by e - length(m), rank) as spans
        from found group by doc_id)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
       sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join per using (doc_id)
"""
