
from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.recorded import ANSWER_UNITS, SESSION_CHUNKS, SESSION_ENTITIES, SESSION_SECONDS, SESSION_TURNS


def _timer(idle: int | None) -> str:
    """Timers by the cluster's clock make a stream run batches for good, so that those that end by themselves (availableNow) have none."""
    return GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout


def progress(events: DataFrame, idle: int | None = None) -> DataFrame:
    """195: events (job, seq, stage, terminal) whose stage is beyond all that were sent, up to the first terminal one.

    Events of a batch are taken in order of seq; the state is the highest stage and whether the job is over. It goes when the
    job has been idle for so many milliseconds; give them to a stream that runs for good."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        high, over = state.get if state.exists else (-(2**31), False)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, stage, terminal in zip(rows["seq"].tolist(), rows["stage"].tolist(), rows["terminal"].tolist(), strict=True):
            if not over and stage > high:
                out.append((key[0], seq, stage))
                high = stage
            over = over or terminal
        state.update((int(high), bool(over)))
        if idle is not None:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=["job", "seq", "stage"])

    return events.groupBy("job").applyInPandasWithState(step, "job long, seq long, stage long", "high long, over boolean", "append", _timer(idle))


def remembered(text: str | None) -> dict:
    """A session's state from what is stored; what can't be read is an empty session."""
    try:
        out = json.loads(text or "null")
    except ValueError:
        out = None
    if isinstance(out, dict) and all(isinstance(out.get(k), kind) for k, kind in (("turns", list), ("entities", list), ("chunks", list), ("last", int), ("seen", int))):
        return out
    return {"turns": [], "entities": [], "chunks": [], "last": 0}


def append_turn(now: dict, ts: int, analysis: object, answer: str | None, chunks: list, entities: list, seconds: int = SESSION_SECONDS) -> dict:
    """199, 222: a session after one more turn (ts in microseconds), within its bounds.

    Another analysis, and a turn too long after the last, begin it anew. Entities spoken of come to the front; chunk ids seen again
    move to the end."""
    if now.get("analysis") != analysis or ts - now.get("seen", ts) >= seconds * 1_000_000:
        now = {"turns": [], "entities": [], "chunks": [], "last": 0}
    turn = now["last"] + 1
    own = list(dict.fromkeys((e["kind"], e["value"]) for e in entities))
    rest = [e for e in now["entities"] if (e[0], e[1]) not in own]
    seen = list(dict.fromkeys(reversed([*now["chunks"], *[c for c in chunks if c is not None]])))[::-1]
    return {
        "analysis": analysis, "seen": ts, "last": turn, "turns": [*now["turns"], [turn, cut(answer, ANSWER_UNITS)]][-SESSION_TURNS:],
        "entities": ([[k, v, turn] for k, v in own] + rest)[:SESSION_ENTITIES], "chunks": seen[-SESSION_CHUNKS:],
    }


def cut(text: str | None, most: int) -> str | None:
    if text is None or len(text.encode("utf-16-le")) // 2 <= most:
        return text
    return text.encode("utf-16-le")[: 2 * (most - 1)].decode("utf-16-le", "ignore") + "…"


def sessions(turns: DataFrame, late: str = "10 minutes", seconds: int = SESSION_SECONDS) -> DataFrame:
    """199, 222: each session of a batch as it is after it: (session, analysis, turns, answers, entities, chunks).

    turns: (session, seq, ts, analysis, answer, chunks, entities: array<struct<kind, value>>). A turn is appended as in operators.recorded;
    rows without session, ts or analysis are broken and are passed over. State is one row of JSON; what can't be read is an empty
    session. A timer of event time drops a session that has been idle for `seconds`; turns later than the watermark don't count."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = remembered(state.get[0] if state.exists else None)
        rows = pd.concat(list(batches)).sort_values(["t", "seq"])
        for t, analysis, answer, chunks, entities in zip(rows["t"].tolist(), rows["analysis"].tolist(), rows["answer"].tolist(), rows["chunks"], rows["entities"], strict=True):
            now = append_turn(now, t, analysis, answer, [] if chunks is None else list(chunks), [] if entities is None else list(entities), seconds)
        state.update((json.dumps(now),))
        state.setTimeoutTimestamp(max(now["seen"] // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], now["analysis"], [n for n, _ in now["turns"]], [a for _, a in now["turns"]], [v for _, v, _ in now["entities"]], now["chunks"])], columns=["session", "analysis", "turns", "answers", "entities", "chunks"])

    own = turns.withWatermark("ts", late).filter("session is not null and ts is not null and analysis is not null").withColumn("t", F.unix_micros("ts"))
    own = own.select("session", "seq", "ts", "t", F.col("analysis").cast("string").alias("analysis"), "answer", F.col("chunks").cast("array<string>").alias("chunks"), "entities")
    shape = f"session {dict(own.dtypes)['session']}, analysis string, turns array<long>, answers array<string>, entities array<string>, chunks array<string>"
    return own.groupBy("session").applyInPandasWithState(step, shape, "json string", "update", GroupStateTimeout.EventTimeTimeout)


def rate_limits(hits: DataFrame, seconds: int, most: int, idle: int | None = None) -> DataFrame:
    """196, from the first hit: how many hits (key, t in microseconds) each key was allowed so far; a key that has been idle for so
    many milliseconds, and no less than a window, is forgotten."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, n, hits_, allowed = state.get if state.exists else (None, 0, 0, 0)
        for t in sorted(pd.concat(list(batches))["t"].tolist()):
            if opened is None or t - opened >= seconds * 1_000_000:
                opened, n = t, 0
            n, hits_ = n + 1, hits_ + 1
            allowed += n <= most
        state.update((opened, n, hits_, int(allowed)))
        if idle is not None:
            state.setTimeoutDuration(max(idle, seconds * 1000))
        yield pd.DataFrame([(key[0], hits_, allowed)], columns=["key", "hits", "allowed"])

    return hits.groupBy("key").applyInPandasWithState(step, "key long, hits long, allowed long", "opened long, n long, hits long, allowed long", "update", _timer(idle))


def aligned_limits(hits: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """196, by the clock: hits of a key (key, ts) in windows of wall-clock time."""
    return hits.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds"), "key").agg(F.count("*").alias("hits")).select("key", F.col("window.start").cast("long").alias("window"), "hits")


def daily_budget(spend: DataFrame, late: str = "1 day", limit: float = float("inf")) -> DataFrame:
    """197: what each unit spent by UTC day (unit, ts, amount), and whether it may spend more: as long as that is at most the limit."""
    return spend.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "unit").agg(F.sum("amount").alias("spent")).select("unit", F.col("window.start").cast("date").alias("day"), "spent", (F.col("spent") <= limit).alias("open"))
