"""Keys, globs and text rules shared by writers and readers of the tables, as Column expressions."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import ASSET_EXTENSIONS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Limits of regular-expression predicates.
MAX_PATTERN, MAX_VALUE = 200, 10_000


def ascii_lower(c: Column) -> Column:
    """Case folding of ASCII letters only, as in the reference store's LIKE and LOWER."""
    return F.translate(c, UPPER, LOWER)


def ascii_upper(c: Column) -> Column:
    return F.translate(c, LOWER, UPPER)


def to_posix(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def basename(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]*)/*$", 1)


def strip_extension(base: Column) -> Column:
    """Without the last extension; a leading dot starts no extension."""
    return F.regexp_replace(base, r"(?<=.)\.[^./]*$", "")


def link_key(target: Column) -> Column:
    """Lower-cased base name without extension."""
    return F.lower(strip_extension(basename(target)))


def path_key(target: Column) -> Column:
    """Lower-cased path without extension."""
    return F.lower(strip_extension(to_posix(target)))


def extension(base: Column) -> Column:
    return F.regexp_extract(base, r"(?<=.)(\.[^./]*)$", 1)


def is_asset(target: Column) -> Column:
    return F.lower(F.regexp_extract(basename(target), r"(?<=.)\.([^./]*)$", 1)).isin(*ASSET_EXTENSIONS)


# the same rules for driver-side literals


def link_key_of(target: str) -> str:
    return posixpath.splitext(posixpath.basename(target))[0].lower()


def path_key_of(target: str) -> str:
    return posixpath.splitext(target.replace("\\", "/"))[0].lower()


def strip_link(target: str) -> str:
    """Inner part of a link without brackets, anchor and alias."""
    t = target.strip()
    if t.startswith("[[") and t.endswith("]]"):
        t = t[2:-2]
    return t.split("#", 1)[0].split("|", 1)[0].strip()


def glob_regex(pattern: str, one_char: str = ".") -> str:
    """Anchored regular expression of a glob: ``**`` any text, ``*`` within a segment, ``?`` one character
    (``.`` in lint rules, ``[^/]`` in event routing)."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        c = pattern[i]
        out.append("[^/]*" if c == "*" else one_char if c == "?" else re.escape(c) if not c.isalnum() and c not in "_/" else c)
        i += 1
    return "^" + "".join(out) + "$"


def any_glob(c: Column, patterns: list[str], one_char: str = ".") -> Column:
    """Whether a value matches one of the globs; false without globs and for null."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.coalesce(c.rlike("(?s)" + glob_regex(p, one_char)), F.lit(False))
    return hit


def java_pattern(pattern: str) -> str | None:
    """The pattern if it is short enough and compiles, else None (such a predicate is false)."""
    if len(pattern) > MAX_PATTERN:
        return None
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    try:
        if spark is not None:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
        else:
            re.compile(pattern)
        return pattern
    except Exception:
        return None


def regex_match(value: Column, pattern: str) -> Column:
    """Unanchored match; null, over-long values and unusable patterns are false, never null."""
    p = java_pattern(pattern)
    if p is None:
        return F.lit(False)
    return F.coalesce((F.length(value) <= MAX_VALUE) & value.rlike(p), F.lit(False))
