
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions import text as T

#: Bounds of a run, of a session and of a blackboard.
MOST_TURNS, MOST_CALLS, RETRIES, EMPTIES = 6, 10, 2, 2
SESSION_TURNS, SESSION_ENTITIES, SESSION_CHUNKS, ANSWER_UNITS, SESSION_SECONDS = 8, 20, 200, 600, 86_400
VERSIONS = 50

_STRINGS = "array<string>"
_TRACE = "array<struct<turn: int, offered: int, action: string, tool: string, error: string>>"


def actions(turns: DataFrame) -> DataFrame:
    """65: turns (.., text) with kind (tool, answer or unparseable), tool, answered, chunks and files that are cited."""
    found = P.json_object(F.col("text"))
    rows = turns.withColumn("__o", found)
    at = lambda path: F.get_json_object("__o", path)
    name, tool = at("$.action"), at("$.tool")
    kind = F.when((name == "tool") & (F.coalesce(tool, F.lit("")) != ""), "tool").when(name == "answer", "answer").otherwise("unparseable")
    listed = lambda path: F.coalesce(F.from_json(at(path), _STRINGS), F.expr(f"cast(array() as {_STRINGS})"))
    return rows.withColumns({"kind": kind, "tool": tool, "answered": F.coalesce((at("$.answered") == "true") & (F.coalesce(at("$.answer"), F.lit("")) != ""), F.lit(False)), "cited_chunks": listed("$.citedChunkIds"), "cited_files": listed("$.citedFileIds")}).drop("__o")


def replay(turns: DataFrame, results: DataFrame, tools: list[str], most_turns: int = MOST_TURNS, most_calls: int = MOST_CALLS, retries: int = RETRIES) -> DataFrame:
    """155, 156, 65: what a run's recorded replies come to within its bounds, a fold over its turns.

    turns: (run, turn, text), turn from 1; results: (run, turn, empty, chunks, files), what the tool called in that turn gave. A reply is a tool
    call, an answer or can't be parsed; after more than `retries` of the last the run ends. On the last turn, and once `most_calls`
    calls are spent, an answer is forced: calls are refused. A tool that isn't there counts as a call. A tool with two empty answers is
    offered no more. An answer needs evidence: citations of chunks and files that results gave; others are dropped, and without any
    the answer is a refusal.

    Returns run, turns, calls, failures, stop (answered, refused, parse-failure, tool-call-limit or turn-limit), kept and dropped
    (distinct citations), trace (turn, offered, action, tool, error). Turns beyond the last that counts aren't read; null texts can't be parsed."""
    gave = results.groupBy("run", "turn").agg(F.bool_or("empty").alias("empty"), F.flatten(F.collect_list("chunks")).alias("chunks"), F.flatten(F.collect_list("files")).alias("files"))
    rows = actions(turns.filter(F.col("turn").between(1, most_turns))).join(gave, ["run", "turn"], "left")
    step = F.struct("turn", "kind", "tool", "answered", "cited_chunks", "cited_files", F.coalesce("empty", F.lit(False)).alias("empty"), *[F.coalesce(c, F.expr(f"cast(array() as {_STRINGS})")).alias(c) for c in ("chunks", "files")])
    runs = rows.groupBy("run").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    known, none = F.array(*[F.lit(t) for t in tools]), F.expr(f"cast(array() as {_STRINGS})")
    start = F.struct(
        F.lit(0).alias("turns"), F.lit(0).alias("calls"), F.lit(0).alias("failures"), F.lit("").alias("stop"), none.alias("spent"), none.alias("chunks"), none.alias("files"), none.alias("kept"), none.alias("dropped"),
        F.expr(f"cast(array() as {_TRACE})").alias("trace"),
    )

    def fold(a: Column, x: Column) -> Column:
        over = a["stop"] != ""
        forced = (x["turn"] >= most_turns) | (a["calls"] >= most_calls)
        call, answer, bad = x["kind"] == "tool", x["kind"] == "answer", x["kind"] == "unparseable"
        there = F.array_contains(known, x["tool"])
        runs_ = call & ~forced & there
        failures = a["failures"] + F.when(bad, 1).otherwise(0)
        kept = F.concat(F.array_intersect(x["cited_chunks"], a["chunks"]), F.array_intersect(x["cited_files"], a["files"]))
        dropped = F.array_distinct(F.concat(F.array_except(x["cited_chunks"], a["chunks"]), F.array_except(x["cited_files"], a["files"])))
        stop = F.when(bad & (failures > retries), "parse-failure").when(answer, F.when(x["answered"] & (F.size(kept) > 0), "answered").otherwise("refused")).otherwise("")
        exhausted = F.filter(known, lambda t: F.size(F.filter(a["spent"], lambda s: s == t)) >= EMPTIES)
        error = F.when(bad, "unparseable").when(call & forced, "exhausted").when(call & ~there, "no such tool")
        line = F.struct(x["turn"].cast("int").alias("turn"), F.when(forced, 0).otherwise(F.size(known) - F.size(exhausted)).alias("offered"), x["kind"].alias("action"), F.when(call, x["tool"]).alias("tool"), error.alias("error"))
        new = F.struct(
            (a["turns"] + 1).alias("turns"), (a["calls"] + F.when(call & ~forced, 1).otherwise(0)).alias("calls"), failures.alias("failures"), stop.alias("stop"),
            F.when(runs_ & x["empty"], F.concat(a["spent"], F.array(x["tool"]))).otherwise(a["spent"]).alias("spent"),
            F.when(runs_, F.array_union(a["chunks"], x["chunks"])).otherwise(a["chunks"]).alias("chunks"), F.when(runs_, F.array_union(a["files"], x["files"])).otherwise(a["files"]).alias("files"),
            F.when(answer, kept).otherwise(a["kept"]).alias("kept"), F.when(answer, dropped).otherwise(a["dropped"]).alias("dropped"), F.concat(a["trace"], F.array(line)).alias("trace"),
        )
        return F.when(over, a).otherwise(new)

    done = runs.select("run", F.aggregate("steps", start, fold).alias("a"))
    limit = F.when(F.col("a.calls") >= most_calls, "tool-call-limit").otherwise("turn-limit")
    return done.select("run", "a.turns", "a.calls", "a.failures", F.when(F.col("a.stop") == "", limit).otherwise(F.col("a.stop")).alias("stop"), "a.kept", "a.dropped", "a.trace")


# Session memory


def sessions(turns: DataFrame, now: Column, seconds: int = SESSION_SECONDS) -> DataFrame:
    """199, 222: each session as it is remembered at `now`.

    turns: (session, seq, ts, analysis, answer, chunks, entities: array<struct<kind, value>>) by ts and seq. A session is of one analysis: a turn
    on another, and one that comes `seconds` or more after the last, begins it anew. Kept are the last 8 turns, numbered from its
    beginning; answers cut to 600 units; the 20 entities spoken of last, the latest first, and in a turn in its order; the 200 chunk ids seen last.
    Sessions that have been idle for `seconds` aren't there any more. Turns without session, ts or analysis are broken rows, which read as if they weren't there.

    Returns session, analysis, turns (turn, answer), entities (kind, value, turn) and chunks."""
    by = Window.partitionBy("session").orderBy("ts", "seq")
    own = turns.filter("session is not null and ts is not null and analysis is not null")
    new = F.coalesce(F.lag("analysis").over(by) != F.col("analysis"), F.lit(True)) | (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(by)) >= seconds * 1_000_000)
    rows = own.withColumn("__new", new.cast("int")).withColumn("run", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    end = Window.partitionBy("session")
    rows = rows.withColumns({"__last": F.max("run").over(end), "__seen": F.max("ts").over(end)}).filter((F.col("run") == F.col("__last")) & (F.unix_micros(now) - F.unix_micros("__seen") < seconds * 1_000_000))
    rows = rows.withColumn("turn", F.row_number().over(by))
    of = Window.partitionBy("session")
    last = rows.withColumn("__n", F.max("turn").over(of)).filter(F.col("turn") > F.col("__n") - SESSION_TURNS)
    told = last.groupBy("session").agg(F.first("analysis").alias("analysis"), F.array_sort(F.collect_list(F.struct("turn", T.truncated(F.col("answer"), ANSWER_UNITS).alias("answer")))).alias("turns"))
    named = rows.select("session", "turn", F.posexplode("entities").alias("pos", "e")).groupBy("session", "e.kind", "e.value").agg(F.min(F.struct((-F.col("turn")).alias("t"), "pos")).alias("p"))
    place = F.row_number().over(Window.partitionBy("session").orderBy("p", "kind", "value"))
    named = named.withColumn("place", place).filter(F.col("place") <= SESSION_ENTITIES).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("place", "kind", "value", (-F.col("p.t")).alias("turn")))).alias("x"))
    seen = rows.select("session", "turn", F.posexplode("chunks").alias("pos", "chunk")).filter("chunk is not null").groupBy("session", "chunk").agg(F.max(F.struct("turn", "pos")).alias("p"))
    back = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("p")))
    seen = seen.withColumn("back", back).filter(F.col("back") <= SESSION_CHUNKS).groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "chunk"))), lambda x: x["chunk"]).alias("chunks"))
    out = told.join(named, "session", "left").join(seen, "session", "left")
    entities = F.transform(F.coalesce("x", F.expr("cast(array() as array<struct<place: int, kind: string, value: string, turn: int>>)")), lambda e: F.struct(e["kind"].alias("kind"), e["value"].alias("value"), e["turn"].alias("turn")))
    return out.select("session", "analysis", "turns", entities.alias("entities"), F.coalesce("chunks", F.expr(f"cast(array() as {turns.schema['chunks'].dataType.simpleString()})")).alias("chunks"))


# Versioned blackboards


def versions(writes: DataFrame, most: int = VERSIONS) -> DataFrame:
    """193, 163: writes (board, at, seq, writer, reason, state) as versions, numbered by at and seq from 1; the last `most` are kept.

    trimmed_before is the least version kept, total how many there ever were."""
    total = F.count("*").over(Window.partitionBy("board"))
    out = writes.withColumns({"version": F.row_number().over(Window.partitionBy("board").orderBy("at", "seq")), "total": total})
    return out.withColumn("trimmed_before", F.greatest(F.col("total") - most, F.lit(0)) + 1).filter(F.col("version") >= F.col("trimmed_before"))


def as_of(writes: DataFrame, reads: DataFrame, most: int = VERSIONS) -> DataFrame:
    """193: reads (board, at, seq, reader, note) with the version that was current then, 0 before the first write, and its state.

    A write at the time of a read comes before it. The state is null where its version has been trimmed since. Reads and writes
    pass through one window, without a join by range."""
    state = writes.schema["state"].dataType
    w = writes.select("board", "at", F.lit(0).alias("side"), "seq", F.lit(1).alias("n"), "state", F.lit(None).cast("string").alias("reader"), F.lit(None).cast("string").alias("note"))
    r = reads.select("board", "at", F.lit(1).alias("side"), "seq", F.lit(0).alias("n"), F.lit(None).cast(state).alias("state"), "reader", "note")
    by = Window.partitionBy("board").orderBy("at", "side", "seq", "reader").rowsBetween(Window.unboundedPreceding, 0)
    rows = w.union(r).withColumns({"version": F.sum("n").over(by), "__s": F.max_by(F.struct("state"), F.when(F.col("side") == 0, F.struct("at", "seq"))).over(by), "total": F.sum("n").over(Window.partitionBy("board"))})
    there = (F.col("version") > 0) & (F.col("version") > F.col("total") - most)
    return rows.filter("side = 1").select("board", "at", "seq", "reader", "note", F.col("version").cast("long").alias("version"), F.when(there, F.col("__s.state")).alias("state"))


def history(writes: DataFrame, reads: DataFrame, most: int = VERSIONS) -> DataFrame:
    """163, 230: each board's log as lines: a head with its counts, each kept version, and below it who read it."""
    kept = versions(writes, most)
    seen = as_of(writes, reads, most)
    text = F.concat(F.lit("  v"), F.col("version").cast("string"), F.lit(" by "), "writer", F.lit(": "), "reason")
    own = kept.select("board", "version", F.lit(0).alias("side"), F.lit(0).cast("long").alias("seq"), text.alias("line"))
    note = F.when(F.col("note").isNotNull(), F.concat(F.lit(" ("), "note", F.lit(")"))).otherwise("")
    by = seen.join(kept.select("board", "version"), ["board", "version"], "left_semi").withColumn("seq", F.row_number().over(Window.partitionBy("board").orderBy("at", "seq", "reader")))
    by = by.select("board", "version", F.lit(1).alias("side"), F.col("seq").cast("long").alias("seq"), F.concat(F.lit("      read by "), "reader", note).alias("line"))
    lines = own.union(by).groupBy("board").agg(F.transform(F.array_sort(F.collect_list(F.struct("version", "side", "seq", "line"))), lambda x: x["line"]).alias("lines"))
    head = writes.groupBy("board").agg(F.count("*").alias("w")).join(reads.groupBy("board").agg(F.count("*").alias("r")), "board", "left").fillna(0, ["r"])
    cut = F.when(F.col("w") > most, F.concat(F.lit(", versions before "), (F.col("w") - most + 1).cast("string"), F.lit(" trimmed"))).otherwise("")
    first = F.concat(F.col("w").cast("string"), F.lit(" writes, "), F.col("r").cast("string"), F.lit(" reads"), cut)
    return head.join(lines, "board").select("board", F.array_join(F.concat(F.array(first), "lines"), "\n").alias("history"))
