"""Orphan references: rows that point at keys no suitable record holds.

Skew-aware split of pre-aggregated references.  References are counted per key, vault and period, with their first
and last moment (map-side combine, so a key that holds a third of all rows costs one row per task and group).  What
is split and checked are these groups.  Groups above ``heavy_share`` of all references are at most ``1/heavy_share`` in
number, a proven bound, so they and their targets are broadcast; the other groups are shuffled by key.  A group
whose target is missing, or was created after its last reference, is orphan as a whole; one whose target was there
before its first reference is not.  Only in a group during which the target was created does the moment of each
reference count.  The two results are unioned; counts come from the groups, rows by joining references back to
orphan groups, broadcast for the heavy ones.

Defined results
* a reference whose key columns are both null is an orphan unless excluded by the caller's filter;
* a repeated reference row (same id) counts once;
* a target without a creation time never precedes a reference and so is unsuitable;
* an empty references table gives an empty result; an empty targets table makes every reference an orphan;
* extra columns of either input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, utc_month, vault_of

BLANKS = r"^[\s 　]+|[\s 　]+$"


def norm_key(c: Column) -> Column:
    """Key comparison ignores case and outer blanks."""
    return F.lower(F.regexp_replace(c, BLANKS, ""))


def live_targets(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Notes whose last change, by ``happened_at`` (then ``change_id``), is not an unlink."""
    last = changes.groupBy("path").agg(
        F.max_by("type", F.struct("happened_at", "change_id")).alias("last_type")
    )
    gone = last.filter(F.col("last_type") == "unlink").select(F.col("path").alias("gone_path"))
    f = files.select("path", "name_key", "path_key", "ctime")
    return f.join(gone, f.path == gone.gone_path, "left_anti")


def target_keys(targets: DataFrame) -> DataFrame:
    """(kind, key) -> earliest creation; kind P is a path key, N a name key."""
    return (
        targets.select(
            "ctime",
            F.explode(
                F.array(
                    F.struct(F.lit("P").alias("kind"), norm_key(F.col("path_key")).alias("key")),
                    F.struct(F.lit("N").alias("kind"), norm_key(F.col("name_key")).alias("key")),
                )
            ).alias("k"),
        )
        .filter(F.col("k.key").isNotNull() & F.col("ctime").isNotNull())
        .groupBy(F.col("k.kind").alias("kind"), F.col("k.key").alias("key"))
        .agg(F.min("ctime").alias("first_ctime"))
    )


def note_references(links: DataFrame, files: DataFrame, asset_types: DataFrame) -> DataFrame:
    """Distinct link ids that point at notes, with the key to look up and the source's mtime."""
    ext = F.lower(F.regexp_extract(F.regexp_replace(F.col("target"), BLANKS, ""), r"\.([^./\\]+)$", 1))
    # asset_types is a fixed list of a dozen rows (a lookup of the data model), hence the hint
    assets = F.broadcast(asset_types.select(F.lower("extension").alias("asset_ext")).distinct())
    refs = (
        links.filter(F.regexp_replace(F.coalesce("target", F.lit("")), BLANKS, "") != "")
        .select(
            "id",
            "source",
            F.when(F.col("target_path_key").isNotNull(), "P").otherwise("N").alias("kind"),
            norm_key(F.coalesce("target_path_key", "target_key")).alias("key"),
            ext.alias("ext"),
        )
        .join(assets, F.col("ext") == F.col("asset_ext"), "left_anti")
        .drop("ext")
        .dropDuplicates(["id"])
    )
    src = files.groupBy("path").agg(F.max("mtime").alias("at"))
    return refs.join(src, refs.source == src.path).select("id", "source", "kind", "key", "at")


#: A group with a greater share of all references is heavy.
HEAVY_SHARE = 0.001
GROUP = ("kind", "key", "vault", "period")


def _same(a: DataFrame, b: DataFrame) -> Column:
    out = F.lit(True)
    for c in GROUP:
        out = out & a[c].eqNullSafe(b[c])
    return out


def orphan_groups(refs: DataFrame, keys: DataFrame, heavy_share: float | None = None) -> DataFrame:
    """``(kind, key, vault, period, n, first_ctime, mixed, heavy, orphan)``: groups of references (``GROUP``, at) that are orphan
    as a whole or, if ``mixed``, where the reference came before ``first_ctime``; and all heavy groups, orphan or not."""
    counted = refs.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    counted = cut(counted, "orphan-counted")
    heavy_share = HEAVY_SHARE if heavy_share is None else heavy_share
    total = counted.agg(F.sum("n")).first()[0] or 0
    split = counted.withColumn("heavy", F.col("n") > F.lit(total * heavy_share))
    t = keys.select(F.col("kind").alias("t_kind"), F.col("key").alias("t_key"), "first_ctime")
    at_key = (F.col("kind") == F.col("t_kind")) & (F.col("key") == F.col("t_key"))
    heavy = F.broadcast(split.filter("heavy"))  # at most 1/heavy_share rows
    heavy_targets = F.broadcast(t.join(heavy, at_key, "left_semi"))
    checked = split.filter("heavy").join(heavy_targets, at_key, "left").unionByName(split.filter("NOT heavy").join(t, at_key, "left"))
    some = F.col("first_ctime").isNull() | (F.col("first_at") < F.col("first_ctime"))
    mixed = F.coalesce(F.col("last_at") >= F.col("first_ctime"), F.lit(False))
    told = checked.select(*GROUP, "n", "first_ctime", mixed.alias("mixed"), "heavy", some.alias("orphan"))
    return cut(told.filter("orphan OR heavy"), "orphan-groups")


def orphan_rows(refs: DataFrame, groups: DataFrame) -> DataFrame:
    """The references that :func:`orphan_groups` tells are orphans."""
    every_heavy = F.broadcast(groups.filter("heavy"))
    few, many = F.broadcast(groups.filter("heavy AND orphan")), groups.filter("NOT heavy")
    at_heavy = refs.join(few, _same(refs, few)).filter("NOT mixed OR at < first_ctime").select(*(refs[c] for c in refs.columns))
    rest = refs.join(every_heavy, _same(refs, every_heavy), "left_anti")  # no heavy group is shuffled
    return at_heavy.unionByName(rest.join(many, _same(rest, many)).filter("NOT mixed OR at < first_ctime").select(*(rest[c] for c in refs.columns)))


def _references(links: DataFrame, files: DataFrame, asset_types: DataFrame) -> DataFrame:
    refs = note_references(links, files, asset_types)
    return cut(refs.select("id", "source", "kind", "key", vault_of(F.col("source")).alias("vault"), utc_month(F.col("at")).alias("period"), "at"), "orphan-refs")


def orphan_links(links: DataFrame, files: DataFrame, changes: DataFrame, asset_types: DataFrame) -> DataFrame:
    """(id, source, kind, key, vault, period) of every note link without a suitable note."""
    refs = _references(links, files, asset_types)
    groups = orphan_groups(refs, target_keys(live_targets(files, changes)))
    return orphan_rows(refs, groups).select("id", "source", "kind", "key", "vault", "period")


def orphan_counts(links: DataFrame, files: DataFrame, changes: DataFrame, asset_types: DataFrame) -> DataFrame:
    """Orphans per source vault and month: sums of whole groups, and the references of mixed ones one by one."""
    refs = _references(links, files, asset_types)
    groups = orphan_groups(refs, target_keys(live_targets(files, changes)))
    whole = groups.filter("orphan AND NOT mixed").select("vault", "period", "n")
    single = orphan_rows(refs, groups.filter("mixed OR heavy").withColumn("orphan", F.col("orphan") & F.col("mixed"))).select("vault", "period", F.lit(1).cast("bigint").alias("n"))
    return whole.unionByName(single).groupBy("vault", "period").agg(F.sum("n").alias("n_orphans"))
