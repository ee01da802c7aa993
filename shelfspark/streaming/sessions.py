"""Scan sessions as streams: voting, upsert by call, and a bounded buffer of newest rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "10 minutes"
BUFFER_FULL, BUFFER_KEPT = 350, 300


def votes(frames: DataFrame, stable: int = 2) -> DataFrame:
    """(session, call, frames, stable) of a stream (ts, session, frame, call): distinct frames that saw a call; null calls don't vote.

    The state of a session and call is the set of its frames, so a frame that comes again, however late, votes once.
    """
    counted = frames.where("call is not null").groupBy("session", "call").agg(F.size(F.collect_set("frame")).cast("long").alias("frames"))
    return counted.withColumn("stable", F.col("frames") >= stable)


def session_books(results: DataFrame, keep: str | None = None) -> DataFrame:
    """The newest result for each (session, call) of a stream (ts, session, call, mis, resolved); resolved once, resolved for good.

    With ``keep``, say ``1 day``, sessions are taken by windows of that length and their state goes when the watermark has passed one.
    """
    newest = F.max_by(F.struct("mis", "ts"), F.struct("ts", "mis")).alias("r")
    rows, keys = results.where("call is not null"), ["session", "call"]
    if keep:
        rows, keys = rows.withWatermark("ts", LATE), [*keys, F.window("ts", keep)]
    return rows.groupBy(*keys).agg(newest, F.max("resolved").alias("resolved")).select("session", "call", "r.mis", "resolved", F.col("r.ts").alias("ts"))


def reused_boxes(frames: DataFrame, most: int = 3) -> DataFrame:
    """(session, frame, reused) of a stream (session, frame, still): a still frame reuses the boxes before it, ``most`` in a row at most; motion resumes at once.

    State is one number for each session: how often the present boxes were used again, or -1 before the first.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else -1
        rows = pd.concat(list(batches)).sort_values("frame", kind="stable")
        out = []
        for frame, still in zip(rows["frame"], rows["still"], strict=True):
            again = bool(still) and 0 <= used < most
            used = used + 1 if again else 0
            out.append((key[0], frame, again))
        state.update((used,))
        yield pd.DataFrame(out, columns=["session", "frame", "reused"])

    return frames.select("session", "frame", "still").groupBy("session").applyInPandasWithState(step, "session string, frame long, reused boolean", "used int", "append", GroupStateTimeout.NoTimeout)


def waiting(queue: DataFrame, sent: DataFrame) -> DataFrame:
    """Uploads (id, ...) that no try has sent yet, the oldest first: what the next scan tries again."""
    return queue.join(sent.select("id").distinct(), "id", "left_anti").orderBy("id")


def reads_in_ticks(results: DataFrame, seconds: int = 12) -> DataFrame:
    """Rows of each session in windows of the reading cadence; a window ends when the watermark has passed it."""
    return results.withWatermark("ts", LATE).groupBy("session", F.window("ts", f"{seconds} seconds")).agg(F.count("*").alias("rows")).select("session", F.col("window.start").alias("start"), "rows")


def newest_rows(results: DataFrame, full: int = BUFFER_FULL, kept: int = BUFFER_KEPT) -> DataFrame:
    """(session, held, oldest): a buffer for each session that is cut to the newest ``kept`` rows when it holds more than ``full``."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times: list[int] = list(state.get[0]) if state.exists else []
        for batch in batches:
            times = sorted(times + batch["ms"].tolist())
            if len(times) > full:
                times = times[-kept:]
        state.update((times,))
        yield pd.DataFrame({"session": [key[0]], "held": [len(times)], "oldest": [times[0]]})

    slim = results.select("session", F.unix_millis("ts").alias("ms")).where("ms is not null")
    return slim.groupBy("session").applyInPandasWithState(step, "session string, held long, oldest long", "times array<long>", "update", GroupStateTimeout.NoTimeout)
