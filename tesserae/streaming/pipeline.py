"""The change pipeline: stream of events -> debounce -> fold -> route -> merge into the tables -> actions."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..operators import actions as A
from ..operators import events as E
from ..operators import meta, scan
from ..plans.catalog import Catalog
from ..sources import notes as N
from ..sources.layout import Layout
from .debounce import debounced

#: An event this long after our own write of its path (by the file's time) is still its echo, and how far clocks differ.
OWN_MS, CLOCK_MS = 2000, 100


@dataclass
class Runner:
    """Serial batches over one collection.  ``catalog`` is replaced by each batch; ``write`` puts edited notes
    back into their files and remembers them, so that their own events are dropped."""

    spark: SparkSession
    layout: Layout
    catalog: Catalog
    pipeline: A.Pipeline
    write: bool = False
    hook: Callable[[DataFrame], None] | None = None
    reports: list[dict] = field(default_factory=list)
    _written: dict[str, int] = field(default_factory=dict)
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def batch(self, events: DataFrame, batch_id: int = 0) -> DataFrame | None:
        """One batch of ``(path, type, mtime, size, seq)``: fold, route, index before the query, act."""
        with self._lock:  # a batch starts when the one before has ended
            p = self.pipeline
            events = self._without_own(events)
            folded = E.match(E.fold(events), list(p.on) if p.on else None, list(p.paths)).cache()
            if folded.isEmpty():
                folded.unpersist()
                return None
            current = self._contents(folded.filter("type <> 'unlink'"))
            if p.where or any(a.name == "index" for a in p.actions):
                self.catalog = scan.upsert(self.catalog, current, folded.filter("type = 'unlink'").select("path"))
            routed = folded
            if p.where:
                live = E.paths_of_query(Engine(self.catalog).query(p.where).all_rows)
                routed = E.route(folded, where=live)
            results = A.run_actions(routed, current, p).cache()
            if self.write and not p.dry_run:
                self._write(results)
            A.stop_on_error(results, p)
            self.reports.append(E.run_report(results, p.dry_run).first().asDict())
            if self.hook:
                self.hook(results)
            return results

    def _contents(self, events: DataFrame) -> DataFrame:
        """The files of the events, looked up and read where the tasks run; one that is gone again has no row."""
        layout = self.layout

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import os

            for b in batches:
                rows = []
                for path in b["path"]:
                    try:
                        a = layout.absolute(path)
                        s = os.stat(a)
                        with open(a, "rb") as f:
                            rows.append((path, s.st_size, s.st_mtime_ns // 1_000_000, int(s.st_ctime * 1000), f.read().decode("utf-8", "replace")))
                    except OSError:
                        continue
                yield pd.DataFrame(rows, columns=["path", "size", "mtime", "ctime", "content"])

        return events.select("path").mapInPandas(run, "path string, size bigint, mtime bigint, ctime bigint, content string")

    def _write(self, results: DataFrame) -> None:
        for r in meta.write_notes(results, self.layout).toLocalIterator():
            self._written[r.path] = r.written_ms

    def _without_own(self, events: DataFrame) -> DataFrame:
        """Without the events of our own writes, told by the file's time of change: each write excuses the first event of
        its path whose time is less than two seconds after it.  Other paths' writes stay remembered; one is forgotten
        when it has excused an event or a later change of its path was seen."""
        if not self._written:
            return events
        writes = self.spark.createDataFrame([(p, ms) for p, ms in self._written.items()], "path string, ms bigint")
        # the file system's clock may lag a little behind ours
        writes = writes.select("path", F.timestamp_millis(F.col("ms") - CLOCK_MS).alias("written_at"))
        timed = events.withColumn("ts", F.timestamp_millis("mtime"))
        for r in timed.filter("mtime IS NOT NULL").join(writes, "path").filter("ts >= written_at").select("path").distinct().toLocalIterator():
            self._written.pop(r.path, None)
        return E.without_own_writes(timed, writes, OWN_MS).drop("ts")

    def start(self, stable_ms: int = 100, checkpoint: str | None = None) -> StreamingQuery:
        """Follow the files.  Stop with ``query.stop()``, which waits for the running batch."""
        p = self.pipeline
        batches = debounced(N.watch(self.spark, list(self.layout.roots), stable_ms, f"{checkpoint}-listings" if checkpoint else None), p.wait, p.max_wait)
        w = batches.writeStream.outputMode("append").foreachBatch(lambda df, i: self.batch(df.drop("route", "batch"), i) and None)
        if checkpoint:
            w = w.option("checkpointLocation", checkpoint)
        return w.trigger(processingTime=f"{min(p.wait, 100)} milliseconds").start()


def run_scan(runner: Runner, rehash: bool = False) -> DataFrame | None:
    """The pipeline over what a scan finds."""
    listing = N.notes(runner.spark, list(runner.layout.roots))
    changes = scan.as_events(scan.diff(listing, runner.catalog.files, rehash=rehash))
    ev = changes.select("path", "type", F.lit(None).cast("bigint").alias("mtime"), F.lit(None).cast("bigint").alias("size"), F.monotonically_increasing_id().alias("seq"))
    return runner.batch(ev)
