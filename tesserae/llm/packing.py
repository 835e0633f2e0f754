"""Filling containers of fixed capacity by hierarchical residual packing.

Round 1 runs in the partitions of the input, without a shuffle: each packs its items best-fit
decreasing and emits bins that are nearly full.  The underfull bins become items of the next round:
they are merged tree-wise into fewer partitions, packed best-fit again, and so on up to the root.  When
a round merges nothing, bins over half full are final (no two of them fit together) and the others, about
one a task, go straight to the root.

An item over the capacity is the only kind that is split: into full containers and one remainder.

Defined results
* items of size 0, below 0 or null (empty and null texts) are left out;
* every other item is in exactly one container, a split item in exactly one per part;
* no container exceeds the capacity; the id of a container is that of its first item, so it is unique;
* ties in size go by key, so a given partitioning always gives the same containers;
* repeated keys are packed as separate items only if the caller numbers them; keys are taken as unique;
* an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

CAPACITY = 2048
FAN_IN = 8
NEARLY_FULL = 0.995
#: Items that a task packs at a time; underfull bins are carried on to the next window.
WINDOW = 400_000
#: Residual bins that one task of a later round takes.
ROWS_PER_TASK = 200_000

BIN = "bin_id string, fill int, items array<struct<key:bigint,part_no:int,token_start:int,n_tokens:int>>, done boolean"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing over ``sizes`` (already in decreasing order): lists of positions per bin.

    Bins with the same free space are interchangeable; a bit per free space finds the tightest in O(1).
    """
    bins: list[list[int]] = []
    open_by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i, s in enumerate(sizes):
        fits = mask >> s
        if fits:
            free = s + (fits & -fits).bit_length() - 1
            b = open_by_free[free].pop()
            if not open_by_free[free]:
                mask ^= 1 << free
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        free -= s
        if free:
            if not open_by_free[free]:
                mask |= 1 << free
            open_by_free[free].append(b)
    return bins


def parts_of(sized: DataFrame, key: str, capacity: int) -> DataFrame:
    """Items of at most the capacity: ``(key, part_no, token_start, n_tokens)`` of ``(key, n_tokens)``."""
    s = sized.select(F.col(key).cast("bigint").alias("key"), F.col("n_tokens").cast("int").alias("n")).filter("n > 0")
    return s.select(
        "key",
        F.posexplode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(capacity))).alias("part_no", "token_start"),
        F.col("n"),
    ).select("key", "part_no", "token_start", F.least(F.lit(capacity), F.col("n") - F.col("token_start")).alias("n_tokens"))


def _pack(capacity: int, enough: int, last: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, str, list]] = []  # fill, id, items

        def packed(final: bool) -> pd.DataFrame:
            nonlocal held
            held.sort(key=lambda x: (-x[0], x[1]))
            out, keep = [], []
            for b in best_fit([x[0] for x in held], capacity):
                fill = sum(held[i][0] for i in b)
                row = (held[b[0]][1], fill, [it for i in b for it in held[i][2]])
                if fill >= enough or final:
                    out.append((*row, fill >= enough or last))
                else:
                    keep.append((row[1], row[0], row[2]))
            held = keep
            return pd.DataFrame(out, columns=["bin_id", "fill", "items", "done"])

        for b in batches:
            if "items" in b.columns:
                held += [(int(f), i, [dict(x) for x in it]) for i, f, it in zip(b["bin_id"], b["fill"], b["items"])]
            else:
                held += [
                    (int(n), f"{k}-{p}", [{"key": int(k), "part_no": int(p), "token_start": int(a), "n_tokens": int(n)}])
                    for k, p, a, n in zip(b["key"], b["part_no"], b["token_start"], b["n_tokens"])
                ]
            if len(held) >= WINDOW:
                yield packed(False)
                if len(held) >= WINDOW // 2:  # nothing of it fits together: hand it to the next round
                    yield packed(True)
        yield packed(True)

    return run


def pack(sized: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """``(container_id, key, part_no, token_start, n_tokens, fill)`` for ``sized`` = ``(key, n_tokens)``."""
    parts = parts_of(sized, key, capacity)
    enough = int(capacity * NEARLY_FULL)
    level = cut(parts.mapInPandas(_pack(capacity, enough, False), BIN), "pack-0")
    done = [level.filter("done")]
    residual = level.filter("NOT done")
    rows, tasks, no = residual.count(), max(1, level.rdd.getNumPartitions()), 0
    while rows:
        no += 1
        tasks = max(-(-tasks // FAN_IN), -(-rows // ROWS_PER_TASK))
        last = tasks == 1
        nxt = cut(residual.repartition(tasks, "bin_id").mapInPandas(_pack(capacity, enough, last), BIN), f"pack-{no}")
        done.append(nxt.filter("done"))
        residual = nxt.filter("NOT done")
        left = residual.count()
        if left and left + nxt.filter("done").count() == rows:
            # nothing merged: bins over half full never fit together, but each task may hold one that is not
            done.append(residual.filter(F.col("fill") * 2 > capacity))
            residual = residual.filter(F.col("fill") * 2 <= capacity)
            left, tasks = residual.count(), 1
        rows = left
    bins = done[0]
    for d in done[1:]:
        bins = bins.unionByName(d)
    return bins.select(F.col("bin_id").alias("container_id"), "fill", F.explode("items").alias("i")).select(
        "container_id", F.col("i.key").alias(key), "i.part_no", "i.token_start", "i.n_tokens", "fill"
    )


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers used, the least that any packing needs, and the share of space left unused."""
    bins = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("parts"))
    return bins.agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.sum("parts").alias("n_parts"),
        F.sum("used").alias("n_tokens"),
        F.max("used").alias("fullest"),
        F.ceil(F.sum("used") / F.lit(capacity)).alias("least_containers"),
    ).withColumn("unused_share", F.round(1 - F.col("n_tokens") / (F.col("n_containers") * F.lit(capacity)), 6))
