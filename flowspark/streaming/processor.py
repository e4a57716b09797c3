"""Key logic in a streaming query."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..stream import ARRIVAL, KEY
from .logic import StatefulBatchLogic


class LogicProcessor(StatefulProcessor):
    """Runs a StatefulBatchLogic for each key. State is its pickled snapshot; a key has one timer at a time, for what notify_at says."""

    def __init__(self, builder: Callable[[object], StatefulBatchLogic], read: Callable[[dict], object], write: Callable[[str, object], list[dict]], names: list[str], by: str | None):
        self.builder, self.read, self.write, self.names, self.by = builder, read, write, names, by

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "blob binary")
        self.timer = handle.getValueState("timer", "at bigint")

    def _logic(self) -> StatefulBatchLogic:
        return self.builder(pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else None)

    def _settle(self, key: str, logic: StatefulBatchLogic, made, discard: bool) -> Iterator[Row]:
        for x in made:
            for row in self.write(key, x):
                yield Row(**{n: row.get(n) for n in self.names})
        due = None if discard else logic.notify_at()
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        if due is not None and due.year < 9000:
            at = int(due.timestamp() * 1000) + 1
            self.handle.registerTimer(at)
            self.timer.update((at,))
        if discard:
            self.state.clear()
        else:
            self.state.update((pickle.dumps(logic.snapshot()),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        items = [r.asDict(recursive=True) for r in rows]
        if self.by:
            items.sort(key=lambda r: r[self.by])
        logic = self._logic()
        made, discard = logic.on_batch([self.read(r) for r in items])
        yield from self._settle(key[0], logic, made, discard)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.timer.clear()
        logic = self._logic()
        made, discard = logic.on_notify()
        yield from self._settle(key[0], logic, made, discard)

    def close(self) -> None:
        pass


def stateful_stream(df: DataFrame, builder, read, write, out: StructType, timers: bool = True) -> DataFrame:
    """df, which is streaming and keyed, through a logic; needs the RocksDB state store."""
    by = ARRIVAL if ARRIVAL in df.columns else None
    processor = LogicProcessor(builder, read, write, out.names, by)
    return df.groupBy(KEY).transformWithState(processor, out, "Append", "ProcessingTime" if timers else "None")


def utc_now() -> datetime:
    return datetime.now(timezone.utc)
