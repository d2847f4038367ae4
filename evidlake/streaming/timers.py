"""Streams with timers: messages that become visible again after a while, and uploads that are watched until a deadline.

Both keep a few numbers a key and are driven by event time, so that a replayed stream gives the same result:
a timer fires when the watermark has passed it, that is, when later rows have come. Rows behind the
watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

VISIBILITY_SECONDS = 30
MOST_TRIES = 3
DEADLINE_SECONDS = 120


def _millis(at: pd.Series) -> pd.Series:
    return at.astype("datetime64[ms]").astype("int64")


def redelivered(attempts: DataFrame, *, visibility: int = VISIBILITY_SECONDS, most: int = MOST_TRIES, late: str = "0 seconds") -> DataFrame:
    """(message, event, tries, at) of a stream of attempts (message, ok, ts).

    Events: "done" at a successful attempt, "visible" when a failed message can be tried again, so many seconds
    after its failure, and "poisoned" at the failure that is its last. What is done or poisoned stays so:
    later attempts change nothing until the state goes, a day after. Attempts of one batch count in order
    of time; a failure within the time in which a message is invisible is the same try.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tries, hidden, over = state.get if state.exists else (0, 0, False)
        out = []
        if state.hasTimedOut:
            if over:
                state.remove()
                return
            out.append(("visible", tries, hidden))
            hidden = 0
        else:
            rows = pd.concat([f[["ok", "ts"]] for f in frames])
            rows = sorted(zip(_millis(rows["ts"]), rows["ok"], strict=True))
            for at, ok in rows:
                if over or (hidden and at < hidden and not ok):
                    continue
                if hidden and at >= hidden:  # the timer's time has passed, though the watermark has not
                    out.append(("visible", tries, hidden))
                hidden, tries = 0, tries + 1
                if ok or tries >= most:
                    over = True
                    out.append(("done" if ok else "poisoned", tries, at))
                    hidden = at
                else:
                    hidden = at + visibility * 1000
        state.update((tries, hidden, over))
        timer = hidden + 86_400_000 if over else hidden
        if timer > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(timer)
        elif hidden or over:
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 1)
        yield pd.DataFrame({"message": [key[0]] * len(out), "event": [e for e, _, _ in out], "tries": pd.array([n for _, n, _ in out], dtype="int64"), "at": pd.to_datetime([t for _, _, t in out], unit="ms")})

    timed = attempts.select("message", F.col("ok").cast("boolean").alias("ok"), "ts").withWatermark("ts", late)
    return timed.groupBy("message").applyInPandasWithState(run, "message string, event string, tries long, at timestamp", "tries long, hidden long, over boolean", "append", GroupStateTimeout.EventTimeTimeout)


def watched(events: DataFrame, *, seconds: int = DEADLINE_SECONDS, late: str = "0 seconds") -> DataFrame:
    """(key, verdict, at) once for every upload of a stream of (key, kind, ts), kind being upload, seen, missing or unread.

    "in time" as soon as the upload is seen within so many seconds; when the deadline has passed without that,
    "late" if it was looked for with an answer (missing, or seen after the deadline), and "unjudged" if no look
    succeeded: a read that fails is not the upload's failure. The first upload of a key counts. Looks that
    come before their upload wait for it.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, seen, answers, told = state.get if state.exists else (0, 0, 0, False)
        limit = seconds * 1000
        said = None
        if state.hasTimedOut:
            if told or not start:
                state.remove()
                return
            said = ("late" if answers else "unjudged", start + limit)
        else:
            for at, kind in sorted((t, k) for f in frames for t, k in zip(_millis(f["ts"]), f["kind"], strict=True)):
                if kind == "upload" and not start:
                    start = at
                elif kind == "seen" and (not seen or (start and seen < start)):
                    seen = at
                answers += kind in ("seen", "missing") and not (start and at > start + limit and kind == "missing")
            if start and not told and start <= seen <= start + limit:
                said = ("in time", seen)
        told = told or said is not None
        state.update((start, seen, answers, told))
        timer = (start + limit if start else state.getCurrentWatermarkMs() + limit) + 1
        state.setTimeoutTimestamp(max(timer, state.getCurrentWatermarkMs() + 1))
        if said:
            yield pd.DataFrame({"key": [key[0]], "verdict": [said[0]], "at": pd.to_datetime([said[1]], unit="ms")})

    timed = events.select("key", "kind", "ts").withWatermark("ts", late)
    return timed.groupBy("key").applyInPandasWithState(run, "key string, verdict string, at timestamp", "start long, seen long, answers long, told boolean", "append", GroupStateTimeout.EventTimeTimeout)
