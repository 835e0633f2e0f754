"""Differences between a listing of files and the indexed tables, and merging them in batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.catalog import Catalog
from ..runtime import cut, discard, shared_dir
from .parse import build_tables

BATCH = 100
#: The column of each table that names a row's note.
OWNERS = {"files": "path", "links": "source", "tags": "file_path", "tasks": "file_path", "blocks": "file_path", "inline_fields": "file_path"}


def dirname(path: Column) -> Column:
    """Folder of a path; ``.`` for the root."""
    d = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(d == "", ".").otherwise(d)


def diff(listing: DataFrame, indexed: DataFrame, missing_roots: list[str] | None = None, rehash: bool = False) -> DataFrame:
    """``(path, kind)``, kind added, modified, deleted or unchanged.

    ``listing`` and ``indexed`` have path, mtime and size; with ``rehash`` their contents are compared instead,
    by hash, so texts are not shuffled.  Rows under a root that is missing now are not deleted.
    """
    mark = [F.xxhash64("content").alias("h"), F.length("content").alias("n")] if rehash else [F.floor("mtime").alias("h"), F.col("size").alias("n")]
    new = listing.select("path", F.struct(*mark).alias("a"))
    old = indexed.select("path", F.struct(*mark).alias("b"))
    kind = (
        F.when(F.col("b").isNull(), "added")
        .when(F.col("a").isNull(), "deleted")
        .when(~F.col("a").eqNullSafe(F.col("b")), "modified")
        .otherwise("unchanged")
    )
    out = new.join(old, "path", "full_outer").select("path", kind.alias("kind"))
    for root in missing_roots or []:
        out = out.filter(~((F.col("kind") == "deleted") & F.col("path").startswith(root.rstrip("/") + "/")))
    return out


def by_dir(changes: DataFrame) -> DataFrame:
    """Counts of added, modified and deleted files per folder."""
    c = changes.filter("kind <> 'unchanged'")
    one = lambda k: F.sum((F.col("kind") == k).cast("bigint")).alias(k)
    return c.groupBy(dirname(F.col("path")).alias("dir")).agg(one("added"), one("modified"), one("deleted"))


def as_events(changes: DataFrame) -> DataFrame:
    """Change events of a diff, in the order add, change, unlink."""
    kinds = F.create_map(*(F.lit(x) for x in ("added", "add", "modified", "change", "deleted", "unlink")))
    return changes.filter("kind <> 'unchanged'").select("path", kinds[F.col("kind")].alias("type")).orderBy("type", "path")


def events_of_paths(paths: DataFrame) -> DataFrame:
    return paths.select("path", F.lit("change").alias("type"))


def upsert(catalog: Catalog, notes: DataFrame, removed: DataFrame | None = None) -> Catalog:
    """Replace the rows of ``notes`` (path, size, mtime, ctime, content) and drop those of ``removed`` (path)."""
    gone = notes.select("path")
    if removed is not None:
        gone = gone.unionByName(removed.select("path"))
    gone = gone.distinct()
    built = build_tables(notes)
    out = {}
    for name, owner in OWNERS.items():
        old = getattr(catalog, name)
        kept = old.join(gone.withColumnRenamed("path", owner), owner, "left_anti").select(*old.columns)
        out[name] = kept.unionByName(built[name], allowMissingColumns=True)
    return Catalog(**out)


def remove(catalog: Catalog, removed: DataFrame) -> tuple[Catalog, DataFrame]:
    """The catalog without ``removed`` paths, and ``(path, existed)``."""
    existed = removed.select("path").distinct().join(catalog.files.select("path", F.lit(True).alias("e")).distinct(), "path", "left").select("path", F.coalesce("e", F.lit(False)).alias("existed"))
    out = {}
    for name, owner in OWNERS.items():
        old = getattr(catalog, name)
        out[name] = old.join(removed.select(F.col("path").alias(owner)).distinct(), owner, "left_anti").select(*old.columns)
    return Catalog(**out), existed


@dataclass
class Progress:
    batch: int
    done: int
    remaining: int
    catalog: Catalog


def scan_batches(catalog: Catalog, listing: DataFrame, missing_roots: list[str] | None = None, rehash: bool = False, dry_run: bool = False, batch_size: int = BATCH) -> Iterator[Progress]:
    """Merge a listing (path, size, mtime, ctime, content): deletions first, then added and then modified notes, in
    batches of ``batch_size`` by path.  It can be stopped after any batch; the next scan finds what remains.

    The difference is computed once, written and numbered.  Each batch parses its notes into tables of its own; the
    catalog after it is the old one without all paths treated so far, and the tables of the batches, so its plan
    does not grow.
    """
    spark = catalog.files.sparkSession
    changes = diff(listing, catalog.files, missing_roots, rehash).filter("kind <> 'unchanged'")
    # a sorted table keeps its rows' places: number within the partition, plus the rows of the partitions before
    placed = cut(
        changes.withColumn("late", F.col("kind") != "deleted").orderBy("late", "kind", "path").select("path", "kind", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")),
        "scan-diff",
    )
    sizes = {r.part: (r["n"], r["gone"]) for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("kind") == "deleted", 1)).alias("gone")).collect()}  # a row per partition
    n_deleted = sum(g for _, g in sizes.values())
    total = sum(n for n, _ in sizes.values()) - n_deleted
    if dry_run:
        yield Progress(0, 0, total + n_deleted, catalog)
        discard(placed)
        return
    before, rows = 0, []
    for part in sorted(sizes):
        rows.append((part, before - n_deleted))
        before += sizes[part][0]
    offsets = F.broadcast(spark.createDataFrame(rows, "part int, before bigint"))
    number = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = placed.join(offsets, "part").select("path", F.when(F.col("kind") == "deleted", F.lit(-1)).otherwise(F.floor(number / batch_size)).cast("bigint").alias("batch"))
    store = f"{shared_dir(spark)}/scan-{uuid.uuid4().hex}"
    schemas: dict[str, StructType] = {}

    def after(k: int) -> Catalog:
        gone = numbered.filter(F.col("batch") <= k).select("path")
        out = {}
        for name, owner in OWNERS.items():
            old = getattr(catalog, name)
            kept = old.join(gone.withColumnRenamed("path", owner), owner, "left_anti").select(*old.columns)
            if k >= 0:
                kept = kept.unionByName(spark.read.schema(schemas[name]).parquet(*(f"{store}/{name}/batch-{i}" for i in range(k + 1))), allowMissingColumns=True)
            out[name] = kept
        return Catalog(**out)

    done = n_deleted
    yield Progress(0, done, total, after(-1))
    for k in range(-(-total // batch_size)):
        part = F.broadcast(numbered.filter(F.col("batch") == k).select("path"))  # at most batch_size paths
        for name, df in build_tables(listing.join(part, "path", "left_semi")).items():
            df.write.mode("overwrite").parquet(f"{store}/{name}/batch-{k}")
            schemas[name] = df.schema
        count = min(batch_size, total - k * batch_size)
        done += count
        yield Progress(k + 1, done, total - (k * batch_size + count), after(k))
