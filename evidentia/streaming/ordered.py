"""Sequential rules on streams: rows of a key wait until the watermark has passed them, then go through the rule in order of event time.

Arrival order does not matter as long as no row is later than the watermark allows, so a stream decides what the batch rule decides. A key holds its
waiting rows and the state of its rule; both are dropped by timers of event time, so idle keys cost nothing. A key has one timer a micro-batch for its
waiting rows, not one a row: every timer that fires is a call to Python that reads them all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from evidentia.config import Params
from evidentia.streaming import limits

#: transformWithState keeps its state and timers in this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Rule:
    """``step(state, row)`` gives the next state and the values to return; state is a tuple of ``kind`` or None.

    ``due(state)`` is the second of event time at which ``close(state)`` is to be called, which gives the last values of the state and ends it.
    """

    kind: str
    out: str
    step: Callable[[Any, Any], tuple[Any, list[tuple]]]
    due: Callable[[Any], float | None]
    close: Callable[[Any], list[tuple]]


class EventOrder(StatefulProcessor):
    """Buffers rows (ts in seconds, id, ...) of a key until the watermark and applies a rule to them in order of ts and id."""

    def __init__(self, rule: Rule, rows: T.StructType, order: tuple[str, ...]) -> None:
        self.rule, self.rows, self.order = rule, rows, order
        self.kind, self.names = T.StructType.fromDDL(rule.kind), T.StructType.fromDDL(rule.out).names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # an entry holds the columns of all rows that a micro-batch brought: every entry is a message to the JVM and back
        self.waiting = handle.getListState("waiting", T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in self.rows]))
        self.state = handle.getValueState("state", self.kind)

    def _entry(self, rows: list[tuple]) -> Row:
        return Row(*([*column] for column in zip(*rows, strict=True)))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        at = self.rows.names.index("ts")
        new = [tuple(getattr(r, f.name) for f in self.rows) for r in rows if key[0] is not None]
        if not (new := [r for r in new if r[at] is not None]):  # rows without a key or a time only move the watermark
            return iter(())
        self.waiting.appendValue(self._entry(new))
        self.handle.registerTimer(int(min(r[at] for r in new) * 1000) + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        """The first timer that fires takes all rows that the watermark has passed; later ones find none left. One timer waits for the first of the rows that are kept."""
        now = timerValues.getCurrentWatermarkInMs()
        make = Row(*self.rows.names)
        kept, ready = [], []
        for entry in self.waiting.get() if self.waiting.exists() else ():
            for values in zip(*entry, strict=True):
                row = make(*values)
                (ready if int(row["ts"] * 1000) < now else kept).append(row)
        if ready:
            self.waiting.put([self._entry(kept)]) if kept else self.waiting.clear()
            if kept:
                self.handle.registerTimer(int(min(r["ts"] for r in kept) * 1000) + 1)
        before = state = tuple(self.state.get()) if self.state.exists() else None
        out: list[tuple] = []
        for row in sorted(ready, key=lambda r: tuple(r[c] for c in self.order)):
            due = self.rule.due(state) if state is not None else None
            if due is not None and due <= row["ts"]:
                out += self.rule.close(state)
                state = None
            state, values = self.rule.step(state, row)
            out += values
        due = self.rule.due(state) if state is not None else None
        if due is not None and due * 1000 < now:
            out += self.rule.close(state)
            state = None
        elif due is not None and state != before:
            self.handle.registerTimer(int(due * 1000) + 1)
        if state is None:
            self.state.clear()
        elif state != before:
            self.state.update(Row(*state))
        yield from (Row(**dict(zip(self.names, (key[0], *values), strict=True))) for values in out)

    def close(self) -> None:
        pass


def in_event_order(rows: DataFrame, key: str, order: tuple[str, ...], late: str, rule: Rule) -> DataFrame:
    """``rule`` over a stream of rows that may come up to ``late`` out of order. ``at`` is the column of event time, ``ts`` the same in seconds.

    The session has to keep its state in the store named by ``STORE``.
    """
    kept = T.StructType([f for f in rows.schema if f.name not in (key, "at")])
    grouped = rows.withWatermark("at", late).groupBy(key)
    return grouped.transformWithState(EventOrder(rule, kept, order), T.StructType.fromDDL(rule.out), "Append", "eventTime")


def never(state: Any) -> float | None:
    return None


def chat_rule(p: Params) -> Rule:
    """The outcome of each message of a session, as ``limits.chat_gated``. A session's pace and count are never forgotten, as its transcript isn't."""

    def step(state: Any, row: Any) -> tuple[Any, list[tuple]]:
        state, outcome = limits.chat_step(state or (0, None), row["live"], row["ts"], p)
        return state, [(row["message_id"], outcome)]

    return Rule("count long, last double", "session_id string, message_id long, outcome string", step, never, lambda state: [])


def outstanding_rule(cap: int) -> Rule:
    """Whether each issue is allowed, as ``limits.outstanding_capped``; an owner without outstanding codes holds no state."""

    def step(state: Any, row: Any) -> tuple[Any, list[tuple]]:
        open_, allowed = limits.outstanding_step((state or (0,))[0], row["kind"], cap)
        return (open_,) if open_ else None, [(row["event_id"], allowed)]

    return Rule("open long", "owner string, event_id long, allowed boolean", step, never, lambda state: [])


def attempt_rule(p: Params) -> Rule:
    """Decisions of the rate limit, as ``limits.rate_limited``; a state that can't matter any more is dropped by its timer."""

    def step(state: Any, row: Any) -> tuple[Any, list[tuple]]:
        state, allowed = limits.decide(state, row["ts"], p)
        return state, [(row["attempt_id"], row["ts"], allowed)]

    def due(state: Any) -> float | None:
        return max(state[1] + p.attempt_window_seconds, state[2])

    return Rule(limits.STATE, limits.DECISIONS, step, due, lambda state: [])


def session_rule(p: Params) -> Rule:
    """Sessions of a fixed time to live: the first use starts one, uses before its end belong to it; it is returned once event time has passed its end."""
    ttl = 60.0 * p.session_ttl_minutes

    def step(state: Any, row: Any) -> tuple[Any, list[tuple]]:
        return ((row["ts"], 1) if state is None else (state[0], state[1] + 1)), []

    return Rule("started double, uses long", "owner string, started double, ended double, uses long", step, lambda state: state[0] + ttl, lambda state: [(state[0], state[0] + ttl, state[1])])


def fixed_sessions(rows: DataFrame, p: Params) -> DataFrame:
    """The batch rule of ``session_rule``: (owner, started, ended, uses) of rows (owner, event_id, ts in seconds)."""
    ttl = 60.0 * p.session_ttl_minutes

    def step(started: float | None, row: Any) -> tuple[float, float]:
        started = row.ts if started is None or started + ttl <= row.ts else started
        return started, started

    numbered = limits.in_sequence(rows.select("owner", "event_id", "ts"), "owner", ("ts", "event_id"), lambda: None, step, "started", "double")
    return numbered.groupBy("owner", "started").agg(F.count("*").alias("uses")).select("owner", "started", (F.col("started") + ttl).alias("ended"), "uses")
