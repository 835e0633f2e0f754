"""Checks of links and metadata: diagnostics as rows.

Targets are grouped key tables; links meet them in left equi-joins.  Ignore rules are globs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import keys as K
from ..functions.typed import once
from ..runtime import cut
from . import parse as P
from .profiles import BUILTIN

COLUMNS = [c.split()[0] for c in model.DIAGNOSTIC.split(", ")]
LINK_RULE, REQUIRED_RULE, ENUM_RULE = "links", "metadata/required-missing", "metadata/enum-invalid"
EXTERNAL = r"(?i)^(?:[a-z][a-z0-9+.-]*:|//)"
MESSAGES = {
    "not_found": "target does not exist: ",
    "ambiguous_target": "several files have this name: ",
    "backslash_path": "backslashes in a path break on other systems: ",
    "outside_vault": "target lies outside the vault: ",
}


@dataclass
class Ignore:
    """Globs of files and targets, and per rule globs of either, whose diagnostics are dropped."""

    paths: list[str] = field(default_factory=list)
    targets: list[str] = field(default_factory=list)
    rules: dict[str, list[str]] = field(default_factory=dict)

    def keep(self) -> Column:
        hit = K.any_glob(F.col("file"), self.paths) | K.any_glob(F.col("target"), self.targets)
        for rule, globs in self.rules.items():
            hit = hit | ((F.col("rule") == rule) & (K.any_glob(F.col("file"), globs) | K.any_glob(F.col("target"), globs)))
        return ~hit


@dataclass
class TargetIndex:
    """Key tables of all files: ``paths`` (lower path), ``stems`` and ``names`` (key, n, first, found), ``path_keys``."""

    paths: DataFrame
    stems: DataFrame
    path_keys: DataFrame
    names: DataFrame


def target_index(all_paths: DataFrame, lists: bool = True) -> TargetIndex:
    """From ``(path)`` of every file, notes and assets.  With ``lists``, ``found`` holds all paths of a name, which is for
    suggesting them in a diagnostic; without, it is null and a hot name costs one count (see :func:`suggestion_rows`)."""
    p = all_paths.select("path").distinct()
    notes = p.filter(F.lower("path").endswith(".md"))

    def grouped(df: DataFrame, key: Column) -> DataFrame:
        df = df.select(key.alias("key"), "path")
        if not lists:
            return df.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("found", F.lit(None).cast("array<string>"))
        return (
            df.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(64)))
            .groupBy("key", "salt")
            .agg(F.count(F.lit(1)).alias("n"), F.collect_set("path").alias("some"))
            .groupBy("key")
            .agg(F.sum("n").alias("n"), F.sort_array(F.flatten(F.collect_list("some"))).alias("found"))
        )

    return TargetIndex(
        p.select(F.lower("path").alias("key")).distinct(),
        grouped(notes, K.link_key(F.col("path"))),
        notes.select(K.path_key(F.col("path")).alias("key")).distinct(),
        grouped(p, F.lower(K.basename(F.col("path")))),
    )


def _relative(found: Column, file: Column) -> Column:
    """Suggested paths relative to the folder of the file."""
    folder = F.split(F.regexp_extract(file, r"^(.*)/[^/]*$", 1), "/")

    def one(p: Column) -> Column:
        parts = F.split(p, "/")
        width = F.least(F.size(folder), F.size(parts) - 1)
        same = F.aggregate(
            F.sequence(F.lit(1), F.greatest(width, F.lit(1))),
            F.lit(0),
            lambda acc, i: F.when((acc == i - 1) & (i <= width) & (F.get(folder, i - 1) == F.get(parts, i - 1)), i).otherwise(acc),
        )
        depth = F.when(F.get(folder, F.lit(0)) == "", 0).otherwise(F.size(folder))
        up = F.repeat(F.lit("../"), depth - same)
        return F.concat(up, F.array_join(F.slice(parts, same + 1, F.size(parts)), "/"))

    return F.sort_array(F.transform(found, one))


def _diagnostics(df: DataFrame, rule: str) -> DataFrame:
    text = F.lit("")
    for reason, message in MESSAGES.items():
        text = F.when(F.col("reason") == reason, F.lit(message)).otherwise(text)
    return df.filter("reason IS NOT NULL").select(
        "file", "line", "column", F.lit(rule).alias("rule"), F.lit("error").alias("severity"),
        F.concat(text, F.col("target")).alias("message"), "target", "reason",
        F.when(F.size("suggestions") > 0, F.col("suggestions")).alias("suggestions"), F.lit(False).alias("fixable"),
    )


def resolve_wikilinks(links: DataFrame, index: TargetIndex) -> DataFrame:
    """``links`` (file, line, column, raw, target) with ``reason`` and ``suggestions``; null when they resolve.

    Assets are found by path or by name with extension, notes by path key or by stem; a name that several
    files have is ambiguous.  A link to a heading of its own note has an empty target, which is not found.
    """
    target, none = F.col("target"), F.array().cast("array<string>")
    qualified, asset = target.contains("/"), K.is_asset(target)
    df = links.withColumn(
        "key",
        F.when(asset & qualified, F.lower(K.to_posix(target)))
        .when(asset, F.lower(K.basename(target)))
        .when(qualified, K.path_key(target))
        .otherwise(K.link_key(target)),
    ).withColumn("kind", F.when(asset & qualified, "path").when(asset, "name").when(qualified, "path_key").otherwise("stem"))
    one = lambda t, kind: t.select(F.lit(kind).alias("kind"), "key", F.lit(1).cast("bigint").alias("n"), none.alias("found"))
    known = (
        one(index.paths, "path")
        .unionByName(one(index.path_keys, "path_key"))
        .unionByName(index.names.select(F.lit("name").alias("kind"), "key", "n", "found"))
        .unionByName(index.stems.select(F.lit("stem").alias("kind"), "key", "n", "found"))
    )
    out = df.join(known, ["kind", "key"], "left")
    reason = F.when(F.col("n").isNull(), "not_found").when(F.col("n") > 1, "ambiguous_target")
    suggestions = F.when(F.col("n") > 1, _relative(F.col("found"), F.col("file"))).otherwise(none)
    return out.withColumn("reason", reason).withColumn("suggestions", suggestions)


def resolved_path(file: Column, target: Column) -> tuple[Column, Column]:
    """(path within the vault, reason); both null for external targets and anchors.  Relative to the file's folder;
    escapes are decoded where they all can be."""
    slashes = F.replace(target, F.lit("\\"), F.lit("/"))
    part = F.substring_index(slashes, "#", 1)
    local = (target != "") & ~target.rlike(EXTERNAL) & ~target.startswith("#") & (part != "")
    decoded = F.try_url_decode(F.replace(part, F.lit("+"), F.lit("%2B")))
    sound = decoded.isNotNull() & (~decoded.contains("\ufffd") | part.contains("\ufffd"))
    steps = F.split(F.concat(F.regexp_extract(file, "^(.*/)?[^/]*$", 1), F.when(sound, decoded).otherwise(part)), "/")

    def walk(acc: Column, x: Column) -> Column:
        up = (F.size(acc) > 0) & ~F.element_at(acc, -1).eqNullSafe("..")
        return F.when((x == "") | (x == "."), acc).when((x == "..") & up, F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.array_append(acc, x))

    walked = F.aggregate(steps, F.array().cast("array<string>"), walk)
    outside = F.get(walked, F.lit(0)).eqNullSafe("..")
    path = F.when(local & ~outside, F.when(F.size(walked) == 0, ".").otherwise(F.array_join(walked, "/")))
    return path, F.when(local & outside, "outside_vault").when(local & target.contains("\\"), "backslash_path")


def resolve_markdown_links(links: DataFrame, index: TargetIndex) -> DataFrame:
    """``links`` (file, line, column, raw, target) with ``reason`` and ``suggestions``; relative to the file's folder."""
    path, early = resolved_path(F.col("file"), F.coalesce("target", F.lit("")))
    df = links.withColumn("resolved", once(F.struct(path.alias("path"), early.alias("early")))).select(*links.columns, "resolved.path", "resolved.early")
    low = F.lower("path")
    df = df.withColumn("low", low).withColumn("low_md", F.when(K.extension(K.basename(low)) == "", F.concat(low, F.lit(".md"))))
    df = df.withColumn("base", F.lower(K.basename(F.col("path"))))
    hit = index.paths.withColumn("hit", F.lit(True))
    df = df.join(hit.select(F.col("key").alias("low"), F.col("hit").alias("h1")), "low", "left")
    df = df.join(hit.select(F.col("key").alias("low_md"), F.col("hit").alias("h2")), "low_md", "left")
    df = df.join(index.names.select(F.col("key").alias("base"), "found"), "base", "left")
    missing = F.col("path").isNotNull() & F.col("h1").isNull() & F.col("h2").isNull()
    reason = F.coalesce(F.col("early"), F.when(missing, "not_found"))
    none = F.array().cast("array<string>")
    return df.withColumn("reason", reason).withColumn(
        "suggestions", F.when((F.col("reason") == "not_found") & F.col("found").isNotNull(), _relative(F.col("found"), F.col("file"))).otherwise(none)
    )


def check_links(notes: DataFrame, all_paths: DataFrame, ignore: Ignore | None = None, suggest: bool = True) -> DataFrame:
    """Broken links of ``notes`` (path, content), sorted by file, line and column (in byte order).

    Notes are parsed once and their links written.  ``suggest`` lists every file of an ambiguous or misplaced name in the
    diagnostic itself, which for a name that many files have is many per link; without it, :func:`suggestion_rows`
    gives them as rows."""
    index = target_index(all_paths, suggest)
    n = P.parse_notes(notes).select(F.col("path").alias("file"), F.explode("nodes").alias("n")).filter(F.col("n.type").isin("wikilink", "markdownLink"))
    n = cut(n.select("file", "n.type", "n.line", "n.column", "n.raw", "n.target"), "lint-links")
    part = lambda kind: n.filter(F.col("type") == kind).drop("type")
    wiki = resolve_wikilinks(part("wikilink"), index).drop("target").withColumnRenamed("raw", "target")
    plain = resolve_markdown_links(part("markdownLink"), index)
    out = _diagnostics(wiki, LINK_RULE).unionByName(_diagnostics(plain, LINK_RULE))
    return out.filter((ignore or Ignore()).keep()).orderBy("file", "line", "column")


def suggestion_rows(resolved: DataFrame, all_paths: DataFrame) -> DataFrame:
    """The files that bear the name of an unresolved link: ``resolved`` (what :func:`resolve_wikilinks` gave, with ``reason``
    and ``key``) with a ``path`` each.  A row per link and file, so no name's files are ever in one row."""
    notes = all_paths.select("path").distinct().filter(F.lower("path").endswith(".md"))
    named = notes.select(K.link_key(F.col("path")).alias("key"), "path")
    return resolved.filter("reason = 'ambiguous_target' AND kind = 'stem'").join(named, "key")


def suggest_links(notes: DataFrame, all_paths: DataFrame, file: str) -> DataFrame:
    """Broken links of one note."""
    return check_links(notes.filter(F.col("path") == file), all_paths)


@dataclass(frozen=True)
class LintProfile:
    name: str
    required: tuple[str, ...] = ()
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    include: str | None = None


def resolve_profile(name: str, own: dict[str, dict] | None = None, seen: tuple[str, ...] = ()) -> LintProfile:
    """A profile with what it extends: requirements and allowed values add up, the nearest ``include`` counts.
    Own profiles come before the built-in ones, of which only the required fields are taken."""
    own = own or {}
    if name in seen:
        raise ValueError("profiles extend each other: " + " -> ".join((*seen, name)))
    if name not in own:
        if name not in BUILTIN:
            known = sorted(own) + sorted(BUILTIN)
            raise ValueError(f"unknown profile {name!r}; known: {', '.join(known)}")
        return LintProfile(name, tuple(f.key for f in BUILTIN[name].fields if f.role == "required"))
    cfg = own[name]
    base = resolve_profile(cfg["extends"], own, (*seen, name)) if cfg.get("extends") else LintProfile(name)
    enums = dict(base.enums)
    for k, values in (cfg.get("enums") or {}).items():
        enums[k] = tuple(dict.fromkeys((*enums.get(k, ()), *values)))
    required = tuple(dict.fromkeys((*base.required, *(cfg.get("required") or ()))))
    return LintProfile(name, required, enums, cfg.get("include") or base.include)


def check_metadata(files: DataFrame, profile: LintProfile, ignore: Ignore | None = None) -> DataFrame:
    """Missing required fields and values outside the allowed ones, of ``files`` (path, frontmatter JSON).

    An explicit null is present and has no value to check; arrays are checked element by element.
    """
    f = files.select(F.col("path").alias("file"), "frontmatter")
    if profile.include:
        f = f.filter(F.col("file").rlike("(?s)" + K.glob_regex(profile.include)))
    have = F.coalesce(F.json_object_keys("frontmatter"), F.array().cast("array<string>"))
    required = F.array(*(F.lit(k) for k in profile.required)).cast("array<string>")
    missing = f.select("file", F.explode(F.array_except(required, have)).alias("target")).select(
        "file", "target", F.lit(REQUIRED_RULE).alias("rule"), F.lit("required_missing").alias("reason"),
        F.concat(F.lit("required field is missing: "), F.col("target")).alias("message"),
    )
    v = f.withColumn("v", F.when(F.ltrim("frontmatter").startswith("{"), F.try_parse_json("frontmatter")))
    bad = []
    for name, allowed in profile.enums.items():
        x = F.try_variant_get("v", '$["' + name.replace('"', '\\"') + '"]', "variant")
        is_array = F.schema_of_variant(x).startswith("ARRAY")
        values = F.when(is_array, F.try_variant_get(x, "$", "array<string>")).otherwise(F.array(F.try_variant_get(x, "$", "string")))
        bad.append(
            v.select("file", F.explode(values).alias("value"))
            .filter(F.col("value").isNotNull() & ~F.col("value").isin(*allowed))
            .select(
                "file", F.lit(name).alias("target"), F.lit(ENUM_RULE).alias("rule"), F.lit("enum_invalid").alias("reason"),
                F.concat(F.lit(f"value of {name} is not allowed: "), F.col("value")).alias("message"),
            )
        )
    out = missing
    for b in bad:
        out = out.unionByName(b)
    out = out.select(
        "file", F.lit(1).alias("line"), F.lit(1).alias("column"), "rule", F.lit("error").alias("severity"), "message", "target", "reason",
        F.lit(None).cast("array<string>").alias("suggestions"), F.lit(False).alias("fixable"),
    )
    return out.filter((ignore or Ignore()).keep()).orderBy("file", "line", "column", "rule", "target", "message")


def lint(notes: DataFrame, all_paths: DataFrame, rules: list[str] | None = None, profile: LintProfile | None = None, ignore: Ignore | None = None) -> DataFrame:
    """Diagnostics of the rules ``links`` and ``metadata``; by default metadata where a profile is given, else links."""
    rules = rules or (["metadata"] if profile else ["links"])
    out = None
    for r in rules:
        if r == "links":
            d = check_links(notes, all_paths, ignore)
        elif r == "metadata":
            if profile is None:
                raise ValueError("the metadata rule needs a profile")
            d = check_metadata(P.parse_notes(notes), profile, ignore)
        else:
            raise ValueError(f"unknown rule {r!r}; known: links, metadata")
        out = d if out is None else out.unionByName(d)
    return out.orderBy("file", "line", "column")


def exit_code(diagnostics: DataFrame) -> int:
    """1 if there is an error."""
    return int(not diagnostics.filter("severity = 'error'").isEmpty())
