"""Change events: folding per path, routing, suppression of own writes, and the report of a run."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K

STATES = ("none", "add", "change", "unlink")
#: Events of a path that one row folds; longer histories are folded in pieces that are then composed.
PIECE = 10_000


def step(state: Column, event: Column) -> Column:
    """The automaton: what two events in a row amount to."""
    gone = event == "unlink"
    return (
        F.when(state == "none", event)
        .when(state == "add", F.when(gone, "none").otherwise("add"))
        .when(state == "change", F.when(gone, "unlink").otherwise("change"))
        .otherwise(F.when(gone, "unlink").otherwise("change"))
    )


def _compose(acc: Column, p: Column) -> Column:
    """A state, after a piece that was folded from each state."""
    at = F.array_position(F.array(*(F.lit(s) for s in STATES)), acc.state).cast("int")
    m = F.element_at(p.maps, at)
    first = F.when(m.state == "none", F.lit(None)).otherwise(F.coalesce(m["first"], acc["first"]))
    return F.struct(m.state.alias("state"), first.cast("bigint").alias("first"))


def fold(events: DataFrame) -> DataFrame:
    """At most one event per path: ``(path, type, mtime, size, first_seq)`` of ``(path, type, mtime, size, seq)``.

    Type by the automaton, mtime and size of the last event, order by the first one since the last time the
    path's events cancelled out.  A piece of a path's history is folded from each of the four states, so pieces
    compose and a path with any number of events is spread over tasks.  Pieces are ranges of ``seq``; they are composed
    in as many levels as it takes until a path has at most ``PIECE`` of them, whatever the range of ``seq``.
    """
    item = F.struct("seq", "type", "mtime", "size")
    pieces = events.groupBy("path", F.floor(F.col("seq") / PIECE).alias("piece")).agg(F.sort_array(F.collect_list(item)).alias("es"))
    start = F.array(*(F.struct(F.lit(s).alias("state"), F.lit(None).cast("bigint").alias("first")) for s in STATES))

    def advance(acc: Column, e: Column) -> Column:
        def one(x: Column) -> Column:
            nxt = step(x.state, e.type)
            first = F.when(nxt == "none", F.lit(None)).when(x.state == "none", e.seq).otherwise(x["first"])
            return F.struct(nxt.alias("state"), first.cast("bigint").alias("first"))

        return F.transform(acc, one)

    folded = pieces.select("path", "piece", F.aggregate("es", start, advance).alias("maps"), F.element_at("es", -1).alias("last"))
    low, high = events.agg(F.min("seq"), F.max("seq")).first()
    width = PIECE
    while high is not None and (high - low) // width > PIECE:
        width *= PIECE
        ps = folded.groupBy("path", F.floor(F.col("piece") / PIECE).alias("piece")).agg(F.sort_array(F.collect_list(F.struct("piece", "maps", "last"))).alias("ps"))
        maps = F.array(*(F.aggregate("ps", F.struct(F.lit(s).alias("state"), F.lit(None).cast("bigint").alias("first")), _compose) for s in STATES))
        folded = ps.select("path", "piece", maps.alias("maps"), F.element_at("ps", -1)["last"].alias("last"))
    whole = folded.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("piece", "maps", "last"))).alias("ps"))
    begin = F.struct(F.lit("none").alias("state"), F.lit(None).cast("bigint").alias("first"))

    return (
        whole.select("path", F.aggregate("ps", begin, _compose).alias("r"), F.element_at("ps", -1)["last"].alias("last"))
        .filter("r.state <> 'none'")
        .select("path", F.col("r.state").alias("type"), "last.mtime", "last.size", F.col("r.first").alias("first_seq"))
    )


def match(events: DataFrame, on: list[str] | None = None, paths: list[str] | None = None) -> DataFrame:
    """Events of the given types whose path matches one of the globs; no list is no condition."""
    out = events
    if on is not None:
        out = out.filter(F.col("type").isin(*on))
    if paths:
        out = out.filter(K.any_glob(F.col("path"), paths, "[^/]"))
    return out


def paths_of_query(df: DataFrame) -> DataFrame:
    """``(path)`` of a query's result: column ``file.path`` and members of ``rows``."""
    parts = []
    if "file.path" in df.columns:
        parts.append(df.select(F.col("`file.path`").alias("path")))
    if "rows" in df.columns:
        parts.append(df.select(F.explode("rows").alias("path")))
    if not parts:
        return df.sparkSession.createDataFrame([], "path string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def route(events: DataFrame, on: list[str] | None = None, paths: list[str] | None = None, where: DataFrame | None = None) -> DataFrame:
    """Cheap conditions first, then the semi join with the paths of a query."""
    out = match(events, on, paths)
    return out if where is None else out.join(where, "path", "left_semi")


def without_own_writes(events: DataFrame, writes: DataFrame, within_ms: int = 2000) -> DataFrame:
    """Drop an event of a path that was written less than ``within_ms`` before; each write excuses one event, the
    first that follows it.  ``events`` has path, seq, ts; ``writes`` path, written_at."""
    w = writes.select("path", "written_at")
    late = F.unix_millis("ts") - F.unix_millis("written_at")
    near = events.join(w, "path").filter((late >= 0) & (late < within_ms))
    excused = near.groupBy("path", "written_at").agg(F.min("seq").alias("seq")).select("path", "seq").distinct()
    return events.join(excused, ["path", "seq"], "left_anti")


def sessions(events: DataFrame, key: str, ts: str, wait: str) -> DataFrame:
    """Events of a key with gaps under ``wait`` (a duration such as "10 minutes")."""
    out = events.groupBy(key, F.session_window(ts, wait).alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    return out.select(key, "n_events", "first_ts", "last_ts")


def batches(events: DataFrame, key: str, ts: str, wait_ms: int, max_wait_ms: int) -> DataFrame:
    """``(key, first_ts, last_ts, n_events, flushed_at)``: the batches a debounce flushes, ``wait_ms`` after the last event
    of a key or ``max_wait_ms`` after the first of the batch.  Where a batch ends depends on where it began, so the
    events of a key are read in order, as a stream of sorted rows: a task keeps one batch in mind, not a key's events."""
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(F.col(key).alias("k"), F.unix_millis(ts).alias("t")).filter("t IS NOT NULL").repartition("k").sortWithinPartitions("k", "t")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # key, first, last, number
        for b in parts:
            out = []
            for k, t in zip(b["k"], b["t"]):
                due = held and min(held[2] + wait_ms, held[1] + max_wait_ms)
                if held and held[0] == k and t < due:
                    held = (k, held[1], t, held[3] + 1)
                else:
                    if held:
                        out.append((*held, due))
                    held = (k, t, t, 1)
            yield pd.DataFrame(out, columns=["k", "a", "z", "n", "f"])
        if held:
            yield pd.DataFrame([(*held, min(held[2] + wait_ms, held[1] + max_wait_ms))], columns=["k", "a", "z", "n", "f"])

    got = rows.mapInPandas(run, f"k {kind}, a bigint, z bigint, n bigint, f bigint")
    at = [F.timestamp_millis(c).alias(n) for c, n in (("a", "first_ts"), ("z", "last_ts"))]
    return got.select(F.col("k").alias(key), *at, F.col("n").alias("n_events"), F.timestamp_millis("f").alias("flushed_at"))


def run_report(results: DataFrame, dry_run: bool = False) -> DataFrame:
    """Counts of ``(path, changed, skipped, error)``."""
    one = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0).cast("bigint"))
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        one(F.col("changed")).alias("changed"),
        one(F.col("skipped")).alias("skipped"),
        one(F.col("error").isNotNull()).alias("failed"),
        F.lit(dry_run).alias("dry_run"),
    )
