"""Items that appear together: an incremental pair table.

A table is a folder that outlives the session.  It holds the baskets, bucketed by basket; the marginal count of
every item, bucketed by item; and the pairs with their counts and those of their two items (all a score needs but
the number of baskets), bucketed on a grid: row by a hash of one item, column by a hash of the other.  A manifest
names the version of every bucket, so a reader finds either all of an update or none of it.

An update takes the new contents of changed baskets.  It reads the buckets of those baskets, and each basket emits
signed deltas: +1 for a pair it now holds, -1 for one it held; a pair that stays emits nothing.  Deltas are summed,
then merged into the buckets of the items and pairs they touch.  The counts kept beside a pair are renewed where
one of its items changed; on a grid of R x R those are at most 2R - 1 buckets an item.  All other buckets keep
their files.  The number of baskets is carried on by its own delta.

Baskets of more than ``WIDE`` items never become one row: their pairs come from a join, which is split by rows
where it is skewed.

Defined results
* null and blank items are ignored; an item repeated in a basket counts once; null basket keys are ignored;
* a basket that becomes empty is removed; an update that changes nothing changes no count and rewrites nothing;
* pairs are ordered in byte order; every pair that occurs is counted, however rare; the empty table has no pairs;
* other columns are ignored.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import cut, discard, exists, hadoop_path, parallelism, remove, shared_dir

WIDE = 500
#: Changed items are sent to the pairs up to this many (some 20 MB); beyond, both are shuffled.
BROADCAST_ITEMS = 200_000
SCHEMAS = {
    "baskets": "basket string, item string, b int",
    "items": "item string, n bigint, b int",
    "pairs": "item_a string, item_b string, n bigint, n_a bigint, n_b bigint, b int",
}


def norm_tag(c: Column) -> Column:
    """Lower case, without outer blanks and leading ``#``."""
    return F.lower(F.regexp_replace(c, r"^[\s#]+|\s+$", ""))


def baskets_of(df: DataFrame, basket: str = "file_path", item: str = "tag", norm=norm_tag) -> DataFrame:
    """Distinct ``(basket, item)``."""
    return (
        df.select(F.col(basket).alias("basket"), norm(F.col(item)).alias("item"))
        .filter(F.col("basket").isNotNull() & (F.col("item") != ""))
        .distinct()
    )


@dataclass(frozen=True)
class PairTable:
    """A version of the table in ``directory``; ``buckets`` has the version of each bucket of each table."""

    spark: SparkSession
    directory: str
    side: int
    version: int
    n_baskets: int
    buckets: dict[str, dict[int, int]]

    def read(self, table: str, only: set[int] | None = None) -> DataFrame:
        """A table, or some of its buckets."""
        held = {b: v for b, v in self.buckets[table].items() if only is None or b in only}
        if not held:
            return self.spark.createDataFrame([], SCHEMAS[table])
        found = self.spark.read.schema(SCHEMAS[table]).option("basePath", f"{self.directory}/{table}").parquet(
            *(f"{self.directory}/{table}/v={v}/b={b}" for b, v in sorted(held.items()))
        )
        return found.drop("v")

    @property
    def baskets(self) -> DataFrame:
        return self.read("baskets").select("basket", "item")

    @property
    def marginals(self) -> DataFrame:
        return self.read("items").select("item", "n")

    @property
    def pairs(self) -> DataFrame:
        return self.read("pairs").select("item_a", "item_b", "n", "n_a", "n_b")


def create(spark: SparkSession, directory: str | None = None, side: int | None = None) -> PairTable:
    """An empty table in a new folder (below the shared one if none is given), with ``side`` x ``side`` buckets of pairs
    and as many of items and baskets."""
    directory = directory or f"{shared_dir(spark)}/pair-table-{uuid.uuid4().hex}"
    if exists(spark, directory):
        raise ValueError(f"{directory} exists already")
    t = PairTable(spark, directory.rstrip("/"), side or math.ceil(math.sqrt(parallelism(spark))), 0, 0, {n: {} for n in SCHEMAS})
    _commit(t)
    return t


def load_table(spark: SparkSession, directory: str) -> PairTable:
    """The newest version of a table that this or another session wrote."""
    root, fs = hadoop_path(spark, directory)
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    version = max(int(n.split("-")[1]) for n in names if n.startswith("manifest-") and not n.endswith(".writing"))
    path, fs = hadoop_path(spark, f"{directory.rstrip('/')}/manifest-{version}")
    stream = fs.open(path)
    try:
        m = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return PairTable(spark, directory.rstrip("/"), m["side"], version, m["n_baskets"], {n: {int(b): v for b, v in of.items()} for n, of in m["buckets"].items()})


def _commit(t: PairTable) -> None:
    """Write the manifest under another name, then rename it."""
    final, fs = hadoop_path(t.spark, f"{t.directory}/manifest-{t.version}")
    draft, _ = hadoop_path(t.spark, f"{t.directory}/manifest-{t.version}.writing")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps({"side": t.side, "n_baskets": t.n_baskets, "buckets": t.buckets}).encode()))
    out.close()
    if not fs.rename(draft, final):
        raise RuntimeError(f"version {t.version} of {t.directory} was written by another update")


def _bucket(t: PairTable, c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(t.side * t.side)).cast("int")


def _line(t: PairTable, c: str) -> Column:
    """Row or column of an item in the grid of pairs."""
    return F.pmod(F.xxhash64(c, F.lit(1)), F.lit(t.side)).cast("int")


def _store(t: PairTable, table: str, df: DataFrame, touched: set[int]) -> dict[int, int]:
    """Write the new contents of the ``touched`` buckets; the versions of all buckets after it.  Rows come grouped by
    bucket, so a task writes whole buckets."""
    version = t.version + 1
    path = f"{t.directory}/{table}/v={version}"
    df.write.mode("overwrite").partitionBy("b").parquet(path)
    root, fs = hadoop_path(t.spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    kept = {b: v for b, v in t.buckets[table].items() if b not in touched}
    return kept | {int(n[2:]): version for n in names if n.startswith("b=")}


def _numbers(df: DataFrame, c: str) -> set[int]:
    """Distinct bucket numbers: no more than there are buckets."""
    return {r[0] for r in df.select(c).distinct().collect()}


def _changes(t: PairTable, new: DataFrame, removed: DataFrame, touched: set[int]) -> DataFrame:
    """The baskets of the ``touched`` buckets, old and new: ``(b, basket, size, changed, moved, xs)``, xs the basket's items
    with whether each was and is there.  ``changed`` baskets were given anew, ``moved`` ones differ.  A basket of more
    than ``WIDE`` items has a row for each.  All of it costs one shuffle, by bucket."""
    row = lambda df, now, was, given: df.select("b", "basket", "item", *(F.lit(x).alias(n) for n, x in (("now", now), ("was", was), ("given", given))))
    nothing = removed.select("b", "basket", F.lit(None).cast("string").alias("item"))
    every = row(new, True, False, True).unionByName(row(nothing, False, False, True)).unionByName(row(t.read("baskets", touched), False, True, False))
    one = every.repartition("b").groupBy("b", "basket", "item").agg(*(F.max(c).alias(c) for c in ("now", "was", "given")))
    whole = Window.partitionBy("b", "basket")
    flagged = one.select(
        "b", "basket", F.struct("item", "now", "was").alias("x"),
        F.count("item").over(whole).alias("size"), F.max("given").over(whole).alias("changed"), F.max((F.col("now") != F.col("was")) & F.col("given").isNotNull()).over(whole).alias("differs"),
    ).filter("x.item IS NOT NULL")
    flagged = flagged.select("b", "basket", "x", "size", "changed", (F.col("changed") & F.col("differs")).alias("moved"))
    narrow = flagged.filter(F.col("size") <= WIDE).groupBy("b", "basket").agg(*(F.first(c).alias(c) for c in ("size", "changed", "moved")), F.sort_array(F.collect_list("x")).alias("xs"))
    wide = flagged.filter(F.col("size") > WIDE).select("b", "basket", "size", "changed", "moved", F.array("x").alias("xs"))
    return narrow.unionByName(wide)


def _pair_deltas(rows: DataFrame) -> DataFrame:
    """``(item_a, item_b, d)``, d not 0, of moved baskets (see :func:`_changes`)."""
    firsts = rows.filter(F.col("size").between(2, WIDE)).select("xs", F.posexplode("xs").alias("i", "x"))
    narrow = firsts.select("x", F.explode(F.slice(F.col("xs"), F.col("i") + 2, F.size("xs"))).alias("y"))
    wide = rows.filter(F.col("size") > WIDE).select("basket", F.col("xs")[0].alias("x"))
    from_wide = wide.join(wide.withColumnRenamed("x", "y"), "basket").filter(F.col("x.item") < F.col("y.item")).select("x", "y")
    d = (F.col("x.now") & F.col("y.now")).cast("bigint") - (F.col("x.was") & F.col("y.was")).cast("bigint")
    return (
        narrow.unionByName(from_wide)
        .select(F.col("x.item").alias("item_a"), F.col("y.item").alias("item_b"), d.alias("d"))
        .filter("d <> 0")
        .groupBy("item_a", "item_b")
        .agg(F.sum("d").alias("d"))
        .filter("d <> 0")
    )


def update(t: PairTable, changed: DataFrame, removed: DataFrame | None = None) -> PairTable:
    """Merge baskets: ``changed`` has the whole new contents ``(basket, item)`` of every changed basket, ``removed`` the
    keys of deleted ones.  Gives the next version; the one before stays readable until the update after it."""
    new = cut(changed.select("basket", "item", _bucket(t, "basket").alias("b")), "pairs-new")
    gone = t.spark.createDataFrame([], "basket string") if removed is None else removed.select("basket")
    gone = gone.filter("basket IS NOT NULL").withColumn("b", _bucket(t, "basket"))
    near = _numbers(new, "b") | (_numbers(gone, "b") if removed is not None else set())
    if not near:
        return t
    net = cut(_changes(t, new, gone, near), "pairs-net")
    moved = net.filter("moved")
    of_baskets = _numbers(moved, "b")
    if not of_baskets:
        discard(new, net)
        return t
    held = dict(t.buckets)

    # baskets: those that were not given keep what they had
    now = net.filter(F.col("b").isin(*of_baskets)).select("b", "basket", "changed", F.explode("xs").alias("x")).filter("x.now OR (x.was AND NOT changed)")
    held["baskets"] = _store(t, "baskets", now.select("basket", F.col("x.item").alias("item"), "b"), of_baskets)
    some = lambda f: F.max(F.exists("xs", f).cast("int"))
    each = moved.groupBy("b", "basket").agg((some(lambda x: x["now"]) - some(lambda x: x["was"])).alias("d"))
    n_baskets = t.n_baskets + (each.agg(F.sum("d")).first()[0] or 0)

    # items
    sign = F.when(F.col("x.now"), 1).otherwise(-1).cast("bigint")
    delta = moved.select(F.explode("xs").alias("x")).filter("x.now <> x.was").groupBy("x.item").agg(F.sum(sign).alias("d")).filter("d <> 0")
    delta = cut(delta.select("item", "d", _bucket(t, "item").alias("b")), "pairs-items")
    of_items = _numbers(delta, "b")
    merged = t.read("items", of_items).unionByName(delta.select("item", F.col("d").alias("n"), "b"))
    counts = merged.repartition("b").groupBy("b", "item").agg(F.sum("n").alias("n")).filter("n > 0")
    held["items"] = _store(t, "items", counts.select("item", "n", "b"), of_items)

    # pairs: buckets with a changed pair, and those in the row or column of a changed item
    grid = (_line(t, "item_a") * t.side + _line(t, "item_b")).alias("b")
    deltas = cut(_pair_deltas(moved).select("item_a", "item_b", "d", grid), "pairs-deltas")
    lines = _numbers(delta.select(_line(t, "item").alias("l")), "l")
    of_pairs = _numbers(deltas, "b") | {b for b in t.buckets["pairs"] if b // t.side in lines or b % t.side in lines}
    null = F.lit(None).cast("bigint")
    before = t.read("pairs", of_pairs).unionByName(deltas.select("item_a", "item_b", F.col("d").alias("n"), null.alias("n_a"), null.alias("n_b"), "b"))
    pairs = before.repartition("b").groupBy("b", "item_a", "item_b").agg(F.sum("n").alias("n"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b")).filter("n > 0")
    # a new pair needs the counts of both its items, another one those that changed
    wanted = deltas.select(F.explode(F.array("item_a", "item_b")).alias("item")).unionByName(delta.select("item")).distinct()
    wanted = wanted.withColumn("b", _bucket(t, "item"))
    every = PairTable(t.spark, t.directory, t.side, t.version + 1, n_baskets, held)
    fresh = cut(every.read("items", _numbers(wanted, "b")).join(wanted, ["item", "b"], "left_semi").select("item", "n"), "pairs-fresh")
    few = fresh.count() <= BROADCAST_ITEMS
    for c in ("a", "b"):
        of_c = fresh.select(F.col("item").alias(f"item_{c}"), F.col("n").alias("fresh"))
        pairs = pairs.join(F.broadcast(of_c) if few else of_c, f"item_{c}", "left").withColumn(f"n_{c}", F.coalesce("fresh", f"n_{c}")).drop("fresh")
    pairs = pairs if few else pairs.repartition("b")
    held["pairs"] = _store(t, "pairs", pairs.select("item_a", "item_b", "n", "n_a", "n_b", "b"), of_pairs)

    after = PairTable(t.spark, t.directory, t.side, t.version + 1, n_baskets, held)
    _commit(after)
    discard(new, net, delta, deltas, fresh)
    _forget(t, after)
    return after


def _forget(before: PairTable, now: PairTable) -> None:
    """Delete bucket files that neither of the two versions names."""
    for table in SCHEMAS:
        root, fs = hadoop_path(now.spark, f"{now.directory}/{table}")
        used = {(v, b) for t in (before, now) for b, v in t.buckets[table].items()}
        for s in fs.listStatus(root) if fs.exists(root) else ():
            v = int(s.getPath().getName()[2:])
            for f in fs.listStatus(s.getPath()):
                name = f.getPath().getName()
                if name.startswith("b=") and (v, int(name[2:])) not in used:
                    remove(now.spark, f"{now.directory}/{table}/v={v}/{name}")


def associations(t: PairTable, min_together: int = 5, min_support: int = 1) -> DataFrame:
    """``(tag_a, tag_b, n_ab, n_a, n_b, n, lift)`` of every pair with at least ``min_together`` baskets, of items with at
    least ``min_support``.  Scores come from the counts kept with each pair; only the number of baskets is added."""
    return (
        t.read("pairs")
        .filter((F.col("n") >= min_together) & (F.least("n_a", "n_b") >= min_support))
        .select(
            F.col("item_a").alias("tag_a"),
            F.col("item_b").alias("tag_b"),
            F.col("n").alias("n_ab"),
            "n_a",
            "n_b",
            F.lit(t.n_baskets).cast("bigint").alias("n"),
            (F.col("n") * F.lit(float(t.n_baskets)) / (F.col("n_a") * F.col("n_b"))).alias("lift"),
        )
    )


def associated(scores: DataFrame, min_lift: int = 4) -> DataFrame:
    """Pairs at least ``min_lift`` times as frequent as independent items, in integers, so exactly."""
    return scores.filter(F.col("n_ab") * F.col("n") >= F.lit(min_lift) * F.col("n_a") * F.col("n_b"))
