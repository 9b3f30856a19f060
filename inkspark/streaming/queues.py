"""Queues as stateful streams: what happens to jobs in the order of event time, with timers.

Rows of a key may arrive in any order within the watermark's delay. They wait in state until the watermark has passed them, and are then
taken in order of (ts, seq), so results do not depend on batches or on arrival. A key has one event-time timer, for the next thing
that is due: a row that waits, or a deadline. State is what waits, and a few numbers for each key; a key without either has
none. The state store is RocksDB, in the query's checkpoint: a query that is started again goes on where it was.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row, StructType

#: Seconds after which a running job is overdue.
DEADLINES = {"first": 30, "speak": 90, "load": 180}
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Takes the rows (ts_us, seq, kind) of a key in order. A subclass has ``MEMO``, the schema of what it remembers of a key and
    its first value, and step(); due() and overdue() if things happen without a row."""

    MEMO: tuple[str, tuple] = ("none long", (0,))
    columns: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts_us long, seq long, kind string")
        self.memo = handle.getValueState("memo", self.MEMO[0])

    def step(self, memo: tuple, ts_us: int, seq: int, kind: str) -> tuple[tuple, list[tuple]]:
        """What is remembered after a row, and the rows to put out, without the key."""
        raise NotImplementedError

    def due(self, memo: tuple) -> int | None:
        """The next microsecond at which something happens without a row."""
        return None

    def overdue(self, memo: tuple, until_us: int) -> tuple[tuple, list[tuple]]:
        """What happens without a row up to a time."""
        return memo, []

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        return self._advance(key, timerValues, [(r.ts_us, r.seq, r.kind) for r in rows])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        return self._advance(key, timerValues, [])

    def _advance(self, key: Any, timer_values: Any, new: list[tuple]) -> Iterator[Row]:
        """The state of a key is read and written once for all its rows of a batch."""
        upto = max(timer_values.getCurrentWatermarkInMs(), 0) * 1000  # all rows before this are there
        rows = sorted([*(tuple(x) for x in self.waiting.get()), *new])
        had = self.memo.get()
        memo = self.MEMO[1] if had is None else tuple(had)
        out: list[tuple] = []
        done = 0
        for ts_us, seq, kind in rows:
            if ts_us >= upto:
                break
            memo, late = self.overdue(memo, ts_us)
            memo, made = self.step(memo, ts_us, seq, kind)
            out += late + made
            done += 1
        memo, late = self.overdue(memo, upto)
        out += late
        rest = rows[done:]
        if done and len(rows) > len(new):
            self.waiting.put(rest) if rest else self.waiting.clear()
        elif new and rest:
            self.waiting.appendList(rest if done else new)
        if memo != self.MEMO[1]:
            self.memo.update(memo)
        elif had is not None:
            self.memo.clear()
        if had is not None or len(rows) > len(new):  # else the key is new, and has no timer
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
        nexts = [t for t in (rest[0][0] if rest else None, self.due(memo)) if t is not None]
        if nexts:
            self.handle.registerTimer(min(nexts) // 1000 + 1)
        return iter([Row(**dict(zip(self.columns, (*key, *x), strict=True))) for x in out])

    def close(self) -> None:
        pass


class Retired(InOrder):
    """Jobs that were not finished in time: (job, retired_us). A row of a kind of DEADLINES starts a job, ``finish`` ends all of the key's."""

    MEMO = ("jobs array<struct<due_us:bigint,job:bigint>>", ([],))

    def __init__(self, unit_us: int = 1_000_000) -> None:
        self.unit_us = unit_us

    def step(self, memo: tuple, ts_us: int, seq: int, kind: str) -> tuple[tuple, list[tuple]]:
        if kind == "finish":
            return ([],), []
        return (sorted([*map(tuple, memo[0]), (ts_us + DEADLINES[kind] * self.unit_us, seq)]),), []

    def due(self, memo: tuple) -> int | None:
        return min((x[0] for x in memo[0]), default=None)

    def overdue(self, memo: tuple, until_us: int) -> tuple[tuple, list[tuple]]:
        """A job finished at its deadline is in time."""
        late = [(job, due) for due, job in map(tuple, memo[0]) if due < until_us]
        return ([x for x in map(tuple, memo[0]) if x[0] >= until_us],), late


class Shared(InOrder):
    """Requests with the request whose job they share: (seq, job). ``fail`` evicts the job, and so does a silence of ``forget_us``."""

    MEMO = ("job long, last_us long", (-1, -1))

    def __init__(self, forget_us: int) -> None:
        self.forget_us = forget_us

    def step(self, memo: tuple, ts_us: int, seq: int, kind: str) -> tuple[tuple, list[tuple]]:
        if kind == "fail":
            return self.MEMO[1], []
        job = memo[0] if memo[0] >= 0 else seq
        return (job, ts_us), [(seq, job)]

    def due(self, memo: tuple) -> int | None:
        return memo[1] + self.forget_us if memo[0] >= 0 else None

    def overdue(self, memo: tuple, until_us: int) -> tuple[tuple, list[tuple]]:
        due = self.due(memo)
        return (self.MEMO[1] if due is not None and due < until_us else memo), []


class InTurn(InOrder):
    """Results (seq from 0) held until all before them are there: (seq, delivered_us). What still waits for a missing one after
    ``patience_us`` without news goes, with what is remembered of the key."""

    MEMO = ("next long, last_us long, held array<bigint>", (0, -1, []))

    def __init__(self, patience_us: int) -> None:
        self.patience_us = patience_us

    def step(self, memo: tuple, ts_us: int, seq: int, kind: str) -> tuple[tuple, list[tuple]]:
        turn, _, held = memo
        there, out = {*held, seq}, []
        while turn in there:
            there.discard(turn)
            out.append((turn, ts_us))
            turn += 1
        return (turn, ts_us, sorted(x for x in there if x > turn)), out

    def due(self, memo: tuple) -> int | None:
        return memo[1] + self.patience_us if memo[1] >= 0 else None

    def overdue(self, memo: tuple, until_us: int) -> tuple[tuple, list[tuple]]:
        due = self.due(memo)
        return (self.MEMO[1] if due is not None and due < until_us else memo), []


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The session's state store is RocksDB meanwhile, which timers need."""
    was = spark.conf.get(_STORE[0], None)
    spark.conf.set(*_STORE)
    try:
        yield
    finally:
        spark.conf.set(_STORE[0], was) if was else spark.conf.unset(_STORE[0])


def in_order(stream: DataFrame, key: str, processor: InOrder, delay: str, out: str) -> DataFrame:
    """``processor`` on a stream (key, ts, seq, kind) with a watermark; gives the key and the columns ``out``. A null key (that of
    a row which only moves the watermark) is left alone as -1. Event times are after 1970, where watermarks begin."""
    rows = stream.withWatermark("ts", delay).select(F.coalesce(key, F.lit(-1)).cast("long").alias(key), "ts", F.unix_micros("ts").alias("ts_us"), "seq", "kind")
    schema = StructType.fromDDL(f"{key} long, {out}")
    processor.columns = tuple(schema.names)
    return rows.groupBy(key).transformWithState(processor, schema, "append", "eventTime")
