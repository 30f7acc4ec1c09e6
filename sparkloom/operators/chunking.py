"""121, 122: files cut into chunks by their symbols, each line in exactly one chunk.

The plan is made of arrays inside rows: a file's symbols pass once through windows in the order of their lines, and only the
lengths of its lines, not their texts, meet the pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Lines of a window, tokens of a chunk.
LINES, TOKENS = 60, 32_000


def windows(start: Column, end: Column, size: int = LINES) -> Column:
    """121: the windows (start, end) of `size` lines that make up the lines from start to end; none where end comes before."""
    starts = F.when(end >= start, F.sequence(start, F.greatest(start, end), F.lit(size))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size - 1, end).alias("end")))


def closed(symbols: DataFrame, size: int = LINES) -> DataFrame:
    """symbols (file, name, start, end, lines) inside their file, with their place: by start, the largest first, then by name.
    An open one ends before the next starts (139), within a window."""
    by = Window.partitionBy("file").orderBy("start", F.desc(F.coalesce("end", "start")), "name")
    until = F.least(F.coalesce(F.lead("start").over(by), F.col("lines") + 1) - 1, F.greatest("start", F.lit(1)) + size - 1)
    first = F.greatest(F.lit(1), F.least("start", "lines"))
    ended = symbols.withColumns({"end": F.coalesce("end", until), "start": first, "place": F.row_number().over(by)})
    return ended.withColumn("end", F.greatest("start", F.least("end", "lines")).cast("int")).withColumn("start", F.col("start").cast("int"))


def chosen(spans: DataFrame) -> DataFrame:
    """The spans (file, name, start, end, place) that begin after all before them have ended (138)."""
    by = Window.partitionBy("file").orderBy("place")
    covered = F.coalesce(F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return spans.withColumn("covered", covered).filter(F.col("start") > F.col("covered")).drop("covered", "place")


def split(start: Column, end: Column, sizes: Column, most: int = TOKENS) -> Column:
    """122: the lines from start to end as segments (start, end, tokens) of at most `most` tokens, filled line by line; a longer line is
    one by itself. sizes: the UTF-16 units of each line of the file."""
    sum_of = lambda a, b: F.aggregate(F.slice(sizes, a, b - a + 1), F.lit(0).cast("long"), lambda s, x: s + x + 1) - 1
    tokens = lambda a, b: F.ceil(sum_of(a, b) / 4).cast("long")
    cut = F.aggregate(
        F.sequence(start, end),
        F.struct(start.alias("from"), F.lit(0).cast("long").alias("total"), F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("done")),
        lambda a, i: _filled(a, i, F.ceil((F.element_at(sizes, i) + 1) / 4).cast("long"), most),
        lambda a: F.concat(a["done"], F.array(F.struct(a["from"].alias("start"), end.alias("end")))),
    )
    pieces = F.when(tokens(start, end) <= most, F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(cut)
    return F.transform(pieces, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), tokens(p["start"], p["end"]).alias("tokens")))


def _filled(a: Column, line: Column, size: Column, most: int) -> Column:
    full = (line > a["from"]) & (a["total"] + size > most)
    done = F.when(full, F.concat(a["done"], F.array(F.struct(a["from"].alias("start"), (line - 1).cast("int").alias("end"))))).otherwise(a["done"])
    return F.struct(F.when(full, line).otherwise(a["from"]).alias("from"), (F.when(full, F.lit(0)).otherwise(a["total"]) + size).cast("long").alias("total"), done.alias("done"))


def plan_chunks(files: DataFrame, symbols: DataFrame, size: int = LINES, most: int = TOKENS) -> DataFrame:
    """121: chunks (file, name, start, end, tokens) of files (file, text) by symbols (file, name, start, end or null).

    Each span that begins after all before it have ended is a chunk with its symbol's name; the lines between, before and after
    them go in windows of `size`, and what holds more than `most` tokens is split. Each line of each file is in one chunk;
    symbols of unknown files, and those without a start, are left out. A file without symbols is all windows; a null text has no chunks."""
    sized = files.filter("text is not null").select("file", F.transform(F.split("text", "\n"), T.units).alias("sizes"))
    own = sized.select("file", F.size("sizes").alias("lines")).join(symbols.filter("start is not null").select("file", "name", "start", "end"), "file", "left")
    spans = chosen(closed(own.filter("start is not null"), size))
    bare = own.filter("start is null").select("file", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), "lines")
    by = Window.partitionBy("file").orderBy("start")
    rows = spans.select("file", "name", "start", "end", "lines").union(bare)
    rows = rows.withColumns({"before": F.coalesce(F.lag("end").over(by), F.lit(0)) + 1, "last": F.lead("file").over(by).isNull()})
    piece = lambda name, a, b: F.transform(windows(a, b, size), lambda w: F.struct(name.alias("name"), w["start"].alias("start"), w["end"].alias("end")))
    none = F.lit(None).cast("string")
    ahead = piece(none, F.col("before"), F.coalesce(F.col("start") - 1, F.lit(0)))
    span = F.when(F.col("start").isNotNull(), F.array(F.struct("name", "start", "end"))).otherwise(F.expr("cast(array() as array<struct<name: string, start: int, end: int>>)"))
    after = F.when(F.col("last"), piece(none, F.coalesce("end", F.lit(0)) + 1, F.col("lines"))).otherwise(F.expr("cast(array() as array<struct<name: string, start: int, end: int>>)"))
    pieces = rows.select("file", F.explode(F.concat(ahead, span, after)).alias("p")).select("file", "p.*")
    parts = pieces.join(sized, "file").select("file", "name", F.explode(split(F.col("start"), F.col("end"), F.col("sizes"), most)).alias("s"))
    return parts.select("file", "name", "s.start", "s.end", "s.tokens")
