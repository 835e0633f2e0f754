"""Debounced batches of change events.

A batch is flushed when no event has come for ``wait`` ms, or ``max_wait`` ms after its first event.
:class:`Accumulator` is the rule by itself, with the clock passed in; :func:`debounced` runs it as a
stateful operator with processing-time timers, one state per route key, so batches of different keys
flush independently.  The state store must be RocksDB (the operator keeps several column families).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

WAIT_MS, MAX_WAIT_MS = 300, 3000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Accumulator:
    def __init__(self, wait: int = WAIT_MS, max_wait: int = MAX_WAIT_MS):
        self.wait, self.max_wait = wait, max_wait
        self.events: list = []
        self.first = self.last = -1

    def push(self, event, now: int) -> None:
        if not self.events:
            self.first = now
        self.events.append(event)
        self.last = now

    def due(self, now: int) -> bool:
        return bool(self.events) and (now - self.last >= self.wait or now - self.first >= self.max_wait)

    def next_due(self) -> int:
        return min(self.last + self.wait, self.first + self.max_wait)

    def flush(self) -> list:
        out, self.events, self.first, self.last = self.events, [], -1, -1
        return out


OUTPUT = "route string, batch bigint, path string, type string, mtime bigint, size bigint, seq bigint"
_EVENT = "path string, type string, mtime bigint, size bigint, seq bigint"
_NAMES = [c.split()[0] for c in _EVENT.split(", ")]


class Debounce(StatefulProcessor):
    def __init__(self, wait: int, max_wait: int):
        self.wait, self.max_wait = wait, max_wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", _EVENT)
        self.times = handle.getValueState("times", "first bigint, last bigint, timer bigint, batch bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        first, _, timer, batch = self.times.get() if self.times.exists() else (-1, -1, -1, 0)
        new = [r for pdf in rows for r in pdf[_NAMES].itertuples(index=False, name=None)]
        new.sort(key=lambda r: r[4])
        if new:
            self.events.appendList([tuple(None if pd.isna(x) else x for x in r) for r in new])
            first = now if first < 0 else first
            due = min(now + self.wait, first + self.max_wait)
            if timer >= 0 and timer != due:
                self.handle.deleteTimer(timer)
            if timer != due:
                self.handle.registerTimer(due)
            self.times.update((first, now, due, batch))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.events.exists():
            return
        rows = list(self.events.get())
        batch = self.times.get()[3] if self.times.exists() else 0
        self.events.clear()
        self.times.update((-1, -1, -1, batch + 1))
        yield pd.DataFrame([(key[0], batch, *r) for r in rows], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def debounced(events: DataFrame, wait: int = WAIT_MS, max_wait: int = MAX_WAIT_MS, route: str | None = None) -> DataFrame:
    """Flushed batches of a stream of change events; ``route`` names a column by which batches are kept apart.

    Without it events are kept apart by a hash of their path, into as many states as there are shuffle partitions: a
    path's events stay together, no single task holds all of them, and a burst in some paths flushes by itself."""
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.col(route) if route else F.pmod(F.xxhash64("path"), F.lit(n))
    cols = [F.col(n) for n in _NAMES]
    return (
        events.select(key.cast("string").alias("route"), *cols)
        .groupBy("route")
        .transformWithStateInPandas(Debounce(wait, max_wait), OUTPUT, "Append", "ProcessingTime")
    )
