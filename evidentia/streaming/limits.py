"""Stateful limits per key: one rule each, applied to a batch in order of time or to a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evidentia.config import Params

DECISIONS = "bucket_key string, attempt_id long, ts double, allowed boolean"
STATE = "count long, window_start double, locked_until double"
Attempt = tuple[int, float, float]


def decide(state: Attempt | None, now: float, p: Params) -> tuple[Attempt, bool]:
    """The state after an attempt, and whether it is allowed. Times in seconds; 0 is no lock.

    A lock carries over untouched; a window that has run out starts anew with this attempt; one attempt over the limit locks.
    """
    count, start, locked = state or (0, 0.0, 0.0)
    if state and locked > now:
        return state, False
    fresh = not state or start <= now - p.attempt_window_seconds
    count, start = (0, now) if fresh else (count, start)
    if count >= p.attempts_per_window:
        return (count, start, now + p.lockout_seconds), False
    return (count + 1, start, 0.0), True


def in_sequence(rows: DataFrame, key: str, order: tuple[str, ...], start: Callable[[], Any], step: Callable[[Any, Any], tuple[Any, Any]], out: str, kind: str) -> DataFrame:
    """Adds column ``out``: each key's rows in order go through ``step(state, row)``, which gives the next state and the value.

    The rows are streamed, a key's state is all that is held, so a key of any length needs constant memory.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + f", {out} {kind}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, state = object(), None
        for batch in batches:
            got = []
            for row in batch.itertuples(index=False):
                if getattr(row, key) != own:
                    own, state = getattr(row, key), start()
                state, value = step(state, row)
                got.append(value)
            yield batch.assign(**{out: got})

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def rate_limited(attempts: DataFrame, p: Params) -> DataFrame:
    """attempts: bucket_key, attempt_id, ts (seconds). Decisions in order of time and id; state is carried per key, so a key is one sequence."""
    rows = attempts.select("bucket_key", "attempt_id", F.col("ts").cast("double").alias("ts"))
    return in_sequence(rows, "bucket_key", ("ts", "attempt_id"), lambda: None, lambda state, r: decide(state, r.ts, p), "allowed", "boolean")


def rate_limited_stream(attempts: DataFrame, p: Params) -> DataFrame:
    """The same on a stream: the state of a key lives between micro-batches, an idle key's state is dropped after its lock could matter."""

    def run(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now_state = tuple(state.get) if state.exists else None
        rows = pd.concat(list(groups)).sort_values(["ts", "attempt_id"])
        allowed = []
        for now in rows["ts"]:
            now_state, ok = decide(now_state, now, p)
            allowed.append(ok)
        state.update(now_state)
        state.setTimeoutDuration(1000 * (p.lockout_seconds + p.attempt_window_seconds))
        yield rows[["bucket_key", "attempt_id", "ts"]].assign(allowed=allowed)

    return attempts.select("bucket_key", "attempt_id", F.col("ts").cast("double").alias("ts")).groupBy("bucket_key").applyInPandasWithState(run, DECISIONS, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


Chat = tuple[int, float | None]


def chat_step(state: Chat, live: bool, now: float, p: Params) -> tuple[Chat, str]:
    """The state (messages, time of the last) after a message, and its outcome: NOT_AVAILABLE, FULL, TOO_FAST or OK; an OK adds two messages and sets the pace."""
    count, last = state
    if not live:
        return state, "NOT_AVAILABLE"
    if count >= p.messages_per_session:
        return state, "FULL"
    if last is not None and last + p.chat_interval_seconds > now:
        return state, "TOO_FAST"
    return (count + 2, now), "OK"


def chat_gated(messages: DataFrame, p: Params) -> DataFrame:
    """messages: session_id, message_id, ts (seconds), live. The outcome of each."""
    rows = messages.select("session_id", "message_id", F.col("ts").cast("double").alias("ts"), "live")
    step = lambda state, r: chat_step(state, r.live, r.ts, p)
    return in_sequence(rows, "session_id", ("ts", "message_id"), lambda: (0, None), step, "outcome", "string").select("session_id", "message_id", "outcome")


def outstanding_step(open_: int, kind: str, cap: int) -> tuple[int, bool]:
    """Outstanding codes after an ISSUE or REDEEM, and whether it is allowed."""
    if kind == "REDEEM":
        return max(0, open_ - 1), True
    return open_ + (open_ < cap), open_ < cap


def outstanding_capped(events: DataFrame, cap: int) -> DataFrame:
    """events: owner, event_id, ts, kind (ISSUE or REDEEM). Whether an issue is allowed while fewer than ``cap`` codes are outstanding."""
    rows = events.select("owner", "event_id", F.col("ts").cast("double").alias("ts"), "kind")
    step = lambda open_, r: outstanding_step(open_, r.kind, cap)
    return in_sequence(rows, "owner", ("ts", "event_id"), lambda: 0, step, "allowed", "boolean").select("owner", "event_id", "allowed")


def daily_capped(rows: DataFrame, cap: int, day: str = "day", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The first ``cap`` rows of each day."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(day).orderBy(*order)).cast("long")).where(F.col("place") <= cap)


def once_per_day(rows: DataFrame, key: str, day: str = "day", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key, day).orderBy(*order))).where("place = 1").drop("place")


def once_per_day_stream(rows: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """The first row of a key and day of a stream, with a day's lateness."""
    return rows.withColumn("day", F.to_date(ts)).withWatermark(ts, "1 day").dropDuplicatesWithinWatermark([key, "day"])


def session_chip(created: str, redeemed: str, as_of: Column, p: Params) -> Column:
    """NEW before use, then ACTIVE until the session's time to live has run out, then EXPIRED."""
    end = F.col(redeemed) + F.make_interval(mins=F.lit(p.session_ttl_minutes))
    return F.when(F.col(redeemed).isNull(), "NEW").when(end > as_of, "ACTIVE").otherwise("EXPIRED")


def token_chip(status: str, session_end: str, email_status: str, as_of: Column) -> Column:
    """What a code's row shows: REVOKED; ACTIVE or USED once redeemed; EMAIL_FAILED or UNREDEEMED before."""
    s = F.col(status)
    redeemed = F.when(F.coalesce(F.col(session_end) > as_of, F.lit(False)), "ACTIVE").otherwise("USED")
    return F.when(s == "REVOKED", "REVOKED").when(s == "REDEEMED", redeemed).when(F.col(email_status).eqNullSafe("FAILED"), "EMAIL_FAILED").otherwise("UNREDEEMED")


def counters(events: DataFrame, key: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums by key: an aggregate over the log in batch, an update-mode aggregate on a stream."""
    return events.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def windowed_counters(events: DataFrame, ts: str = "ts", key: str = "event_type", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window; on a stream with a watermark."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, size).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def overlapping(occupancies: DataFrame) -> DataFrame:
    """Pairs of occupancies of one place that overlap: each start is compared with the latest end before it, so the rows stay linear.

    occupancies: place, occupant, start, end.
    """
    w = Window.partitionBy("place").orderBy("start", "occupant").rowsBetween(Window.unboundedPreceding, -1)
    rows = occupancies.withColumn("before", F.max(F.struct("end", "occupant")).over(w))
    return rows.where(F.col("before.end") > F.col("start")).select("place", "occupant", "start", F.col("before.occupant").alias("holds"), F.col("before.end").alias("until"))
