"""Turns of many sessions in order, however they arrive: each is held until the one before it has come.

The state of a session is the number of the turn that comes next, the texts of its last turns, and the turns that are held, one
entry a turn, in RocksDB: a turn that arrives costs its own entry and not the whole session's.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """See in_order()."""

    def __init__(self, session: str, turn: str, text: str, held: StructType, first: int, history: int, patience_ms: int | None, idle_ms: int | None):
        self.session, self.turn, self.text, self.columns = session, turn, text, held
        self.made = Row(session, turn, "n", "after_gap", "history", *held.names)
        self.first, self.history, self.patience, self.idle = first, history, patience_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        place = StructType([StructField("next", LongType()), StructField("released", LongType()), StructField("last", ArrayType(StringType()))])
        self.handle = handle
        self.place = handle.getValueState("place", place, self.idle)
        self.held = handle.getMapState("held", StructType([StructField("turn", LongType())]), self.columns, self.idle)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        at, released, last = self.place.get() if self.place.exists() else (self.first, 0, [])
        for row in rows:
            if row[self.turn] is not None and row[self.turn] >= at and not self.held.containsKey((row[self.turn],)):
                self.held.updateValue((row[self.turn],), tuple(row[f.name] for f in self.columns))
        yield from self.release(key, at, released, list(last or []), False)
        self.wait(timerValues)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        at, released, last = self.place.get() if self.place.exists() else (self.first, 0, [])
        there = [k[0] for k in self.held.keys()]
        if there:
            yield from self.release(key, min(there), released, list(last or []), True)
            self.wait(timerValues)

    def wait(self, timerValues: Any) -> None:
        """One timer while turns are held, from the last time that something came."""
        if self.patience is None:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if any(True for _ in self.held.keys()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)

    def release(self, key: Any, at: int, released: int, last: list, skipped: bool) -> Iterator[Row]:
        """The held turns from ``at`` on, as far as they follow one another."""
        while self.held.containsKey((at,)):
            row = tuple(self.held.getValue((at,)))
            self.held.removeKey((at,))
            released += 1
            yield self.made(*key, at, released, skipped, list(last), *row)
            last = [*last, row[self.columns.names.index(self.text)]][-self.history :] if self.history else []
            at, skipped = at + 1, False
        self.place.update((at, released, last))


def in_order(turns: DataFrame, session: str, turn: str, text: str, first: int = 0, history: int = 3, patience_ms: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """A stream's rows in the order of ``turn`` within ``session``: n (1, 2, ...), after_gap, the texts of the ``history`` turns before, and all columns.

    A turn waits for those before it, from ``first`` on; a turn that has been there already, held or released, is left out,
    and so is one without a number. With ``patience_ms``, a session that has waited so long (processing time) for a missing
    turn goes on with the least turn held, marked as after_gap; turns it went on without are left out should they come.
    With ``idle_ms``, what is known of a session is forgotten once nothing has changed for so long.

    Sets the session's state store to RocksDB, which this kind of state needs.
    """
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kinds = {f.name: f.dataType for f in turns.schema}
    rest = StructType([StructField(c, k) for c, k in kinds.items() if c not in (session, turn)])
    added = StructType.fromDDL("n bigint, after_gap boolean, history array<string>")
    schema = StructType([StructField(session, kinds[session]), StructField(turn, LongType()), *added, *rest])
    rows = turns.withColumn(turn, turns[turn].cast("long"))
    timed = patience_ms is not None or idle_ms is not None
    return rows.groupBy(session).transformWithState(InOrder(session, turn, text, rest, first, history, patience_ms, idle_ms), schema, "Append", "ProcessingTime" if timed else "None")
