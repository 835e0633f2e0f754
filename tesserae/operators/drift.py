"""Schemas that drift between files: versioned fingerprints and explicit migration steps.

The template of a vault in a month is the set of fields that more than half of the notes created in it
carry, each with the JSON type of most of its values.  Consecutive templates are versions; a version is
named by a fingerprint of its fields and types.  What differs between two versions becomes steps: a
field enters, leaves, changes type, or is renamed, i.e. one leaves and another of its type, filled with
the same kind of values, enters.  Values are compared by mergeable profiles of fixed size (minhash slots
of the values, a histogram of their shapes), so a vault with a third of all notes costs no more per
task than any other.  Versions, parents and steps form a :func:`registry`.

All counting is done by partial aggregation in the JVM.  Only version metadata reaches Python, grouped
by vault: a template has at most twice as many fields as an average note.

:func:`unify` routes every note, by its vault and month, through the chained rename, cast and default rules of
its version into one table: one column and type per meaning, with a record of the rules applied.

Defined results
* frontmatter that is null, empty, cut off or not an object carries no field, but its note counts;
* a field with an explicit null is not carried; names are compared exactly;
* rows that repeat a path count once; a note without ctime belongs to no month and is left out;
* types that are equally frequent: the one that comes first in the alphabet;
* the first month of a vault has nothing to be compared with; months without notes do not exist;
* an empty table gives an empty report; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import difflib
import math
import re
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.typed import json_parts, once
from ..runtime import cut, discard, utc_month, vault_of

SLOTS, SHAPES = 64, 64
#: Least likeness of values for a rename.
ALIKE = 0.5
#: Names of templates that have a column, and fields outside all templates that do.  A table has a bounded number of
#: columns; values under further names stand in the column ``other``.
MAX_COLUMNS = 5_000
FREE_COLUMNS = 500


def json_type(v: Column) -> Column:
    """string, number, boolean, array or object; null for a JSON null."""
    s = F.schema_of_variant(v)
    return (
        F.when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .when(s == "VOID", F.lit(None))
        .when(s.startswith("ARRAY"), "array")
        .when(s.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def dated_notes(files: DataFrame) -> DataFrame:
    """``(path, vault, month, v)`` of the distinct notes; ``v`` is null where there is no JSON object."""
    n = (
        files.select("path", "ctime", "frontmatter")
        .filter(F.col("path").isNotNull() & F.col("ctime").isNotNull())
        .dropDuplicates(["path"])
    )
    v = F.when(F.ltrim("frontmatter").startswith("{"), F.try_parse_json("frontmatter"))
    return n.select("path", vault_of(F.col("path")).alias("vault"), utc_month(F.col("ctime")).alias("month"), v.alias("v"))


def exploded(files: DataFrame) -> DataFrame:
    """``(vault, month, first, field, type, value)``, written once: a row for every top-level field with a value, as JSON
    text, and at least one row (without a field) for every note; ``first`` marks one row of each note."""
    notes = dated_notes(files)
    tvf = notes.sparkSession.tvf
    object_ = F.coalesce("v", F.parse_json(F.lit("{}")))
    rows = notes.select("vault", "month", object_.alias("v")).lateralJoin(tvf.variant_explode_outer(F.col("v").outer()))
    out = rows.select(
        "vault", "month", (F.coalesce("pos", F.lit(0)) == 0).alias("first"), F.col("key").alias("field"), json_type(F.col("value")).alias("type"), F.to_json("value").alias("value")
    )
    return cut(out, "drift-fields")


def fields_of(every: DataFrame) -> DataFrame:
    """The rows of :func:`exploded` that hold a field with a value."""
    return every.filter("type IS NOT NULL AND field IS NOT NULL")


def templates(every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``vault, month, prev, next, notes`` of the months; ``vault, month, field, type`` of their templates)."""
    months = every.groupBy("vault", "month").agg(F.count(F.when(F.col("first"), 1)).alias("notes"))
    typed = fields_of(every).groupBy("vault", "month", "field", "type").agg(F.count(F.lit(1)).alias("n"))
    most = (
        typed.groupBy("vault", "month", "field")
        .agg(F.sum("n").alias("carriers"), F.min(F.struct((-F.col("n")).alias("neg"), "type")).alias("m"))
        .select("vault", "month", "field", "carriers", F.col("m.type").alias("type"))
    )
    w = Window.partitionBy("vault").orderBy("month")  # a row per month
    months = months.withColumn("prev", F.lag("month").over(w)).withColumn("next", F.lead("month").over(w))
    of = months.select("vault", "month", "notes")
    fields = most.join(of, ["vault", "month"]).filter(F.col("carriers") * 2 > F.col("notes")).select("vault", "month", "field", "type")
    return months, fields


_SCALAR = r'"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|true|false'


def profiles(every: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(vault, month, field, vocab, shapes)`` of the ``wanted`` fields: minima of value hashes per slot and
    counts per hashed shape, at most ``SLOTS`` and ``SHAPES`` of them."""
    f = fields_of(every).join(wanted, ["vault", "month", "field"], "left_semi")
    token = F.explode(F.regexp_extract_all("value", F.lit(_SCALAR), F.lit(0))).alias("t")
    t = f.select("vault", "month", "field", token)
    # texts: runs of letters by length class, runs of digits as one; numbers keep their digits
    s = F.col("t")
    for pattern, mark in ((r"\p{L}{10,}", "\u0001"), (r"\p{L}{7,9}", "\u0002"), (r"\p{L}{4,6}", "\u0003"), (r"\p{L}{1,3}", "\u0004")):
        s = F.regexp_replace(s, pattern, mark)
    s = F.when(F.col("t").rlike(r"\s"), F.regexp_replace("t", r"\p{L}+", "a")).otherwise(s)  # phrases: words without lengths
    text_shape = F.regexp_replace(s, "[0-9]+", "9")
    shape = F.when(F.col("t").startswith('"'), text_shape).otherwise(F.regexp_replace("t", "[0-9]", "9"))
    marks = F.explode(
        F.array(
            F.struct(F.lit(0).alias("kind"), F.xxhash64("t").alias("h")),
            F.struct(F.lit(1).alias("kind"), F.xxhash64(shape).alias("h")),
        )
    ).alias("m")
    slots = (
        t.select("vault", "month", "field", marks)
        .select("vault", "month", "field", "m.kind", F.pmod("m.h", F.lit(SLOTS)).cast("int").alias("slot"), "m.h")
        .groupBy("vault", "month", "field", "kind", "slot")
        .agg(F.min("h").alias("low"), F.count(F.lit(1)).alias("n"))
    )
    entry = F.struct(F.col("slot"), F.when(F.col("kind") == 0, F.col("low")).otherwise(F.col("n")).alias("x"), F.col("n"))
    return slots.groupBy("vault", "month", "field").agg(
        F.collect_list(F.when(F.col("kind") == 0, entry)).alias("vocab"),
        F.collect_list(F.when(F.col("kind") == 1, entry)).alias("shapes"),
    )


def _name_parts(name: str) -> str:
    return " ".join(re.findall(r"[A-Z]?[a-z0-9]+|[A-Z]+|[^\W_]+", name)).lower()


def likeness(a: dict, b: dict) -> float:
    """How far two fields are filled with the same kind of values, 0 to 1."""
    va, vb = a["vocab"], b["vocab"]
    sa, sb = a["shapes"], b["shapes"]
    if not va or not vb:
        return 0.0
    x, y = np.zeros(SHAPES), np.zeros(SHAPES)
    for k, n in sa.items():
        x[k] = n
    for k, n in sb.items():
        y[k] = n
    shape = float(np.minimum(x / x.sum(), y / y.sum()).sum())
    same = sum(1 for k, h in va.items() if vb.get(k) == h)
    least = min(len(va), len(vb))
    vocab = same / least
    # few different values, often repeated: a closed vocabulary, which a rename would keep
    closed = a["type"] == "string" and min(_repeats(a), _repeats(b)) < 0.6 and min(a["n"], b["n"]) >= 5
    if closed and not same:
        return 0.4 * shape
    return 0.6 * shape + 0.4 * (vocab if closed else max(vocab, 0.5))


def _repeats(a: dict) -> float:
    """Share of different values, estimated from the occupied slots."""
    k = len(a["vocab"])
    return 1.0 if k >= SLOTS else min(1.0, -SLOTS * math.log(1 - k / SLOTS) / max(1, a["n"]))


def match(left: dict[str, dict], entered: dict[str, dict]) -> list[tuple[str, str]]:
    """Renames among the fields that left and entered between two versions: the most alike first."""
    scored = []
    for x, a in left.items():
        for y, b in entered.items():
            if a["type"] == b["type"]:
                s = likeness(a, b)
                if s >= ALIKE:
                    name = difflib.SequenceMatcher(None, _name_parts(x), _name_parts(y)).ratio()
                    scored.append((s + 0.25 * name, x, y))
    out, used = [], set()
    for _, x, y in sorted(scored, key=lambda t: (-t[0], t[1], t[2])):
        if ("l", x) not in used and ("e", y) not in used:
            used |= {("l", x), ("e", y)}
            out.append((x, y))
    return out


STEPS = "vault string, period string, step string, field_before string, field_after string, type_before string, type_after string"


def _steps_of_vault(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for period, g in pdf.groupby("period", sort=True):
        left: dict[str, dict] = {}
        entered: dict[str, dict] = {}
        for r in g.itertuples(index=False):
            if r.type_before and r.type_after:
                rows.append((r.vault, period, "cast", r.field, r.field, r.type_before, r.type_after))
                continue
            vocab = {e["slot"]: e["x"] for e in (r.vocab if r.vocab is not None else ())}
            shapes = {e["slot"]: e["x"] for e in (r.shapes if r.shapes is not None else ())}
            n = sum(e["n"] for e in (r.vocab if r.vocab is not None else ()))
            (left if r.type_before else entered)[r.field] = {"type": r.type_before or r.type_after, "vocab": vocab, "shapes": shapes, "n": n}
        for x, y in match(left, entered):
            t = left.pop(x)["type"]
            entered.pop(y)
            rows.append((r.vault, period, "rename", x, y, t, t))
        rows += [(r.vault, period, "leave", x, "", a["type"], "") for x, a in left.items()]
        rows += [(r.vault, period, "enter", "", y, "", b["type"]) for y, b in entered.items()]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in STEPS.split(", ")])


def versions(fields: DataFrame) -> DataFrame:
    """``(vault, month, fingerprint, fields)`` of every template."""
    return fields.groupBy("vault", "month").agg(
        F.array_sort(F.collect_list(F.concat_ws(":", "field", "type"))).alias("fields")
    ).withColumn("fingerprint", F.sha2(F.array_join("fields", "\n"), 256))


def registry(files: DataFrame) -> DataFrame:
    """The versions of all vaults; see :func:`survey`."""
    return _surveyed(files, False)[0]


def survey(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The registry of versions ``(vault, month, fingerprint, fields, parent, parent_month, steps)``, and how many notes
    carry each field (:func:`carried`).

    A version is a vault's template in a month, named by its fingerprint; ``parent`` is the fingerprint of the vault's
    version before it (null for the first), ``steps`` are the migrations from there, as structs of ``step, field_before,
    field_after, type_before, type_after``.  A month whose notes share no field has the fingerprint of no fields."""
    return _surveyed(files, True)


def _surveyed(files: DataFrame, counting: bool) -> tuple[DataFrame, DataFrame | None]:
    every = exploded(files)
    months, fields = templates(every)
    months, fields = cut(months, "drift-months"), cut(fields, "drift-templates")
    steps = drift_steps(every, months, fields)
    one = F.struct("step", "field_before", "field_after", "type_before", "type_after")
    taken = steps.groupBy("vault", F.col("period").alias("month")).agg(F.array_sort(F.collect_list(one)).alias("steps"))  # at most two templates' fields
    none = F.array().cast("array<string>")
    named = months.join(versions(fields), ["vault", "month"], "left").select(
        "vault", "month", "prev", F.coalesce("fields", none).alias("fields"), F.coalesce("fingerprint", F.sha2(F.lit(""), 256)).alias("fingerprint")
    )
    before = named.select("vault", F.col("month").alias("prev"), F.col("fingerprint").alias("parent"))
    out = named.join(before, ["vault", "prev"], "left").join(taken, ["vault", "month"], "left")
    empty = F.array().cast("array<struct<step:string,field_before:string,field_after:string,type_before:string,type_after:string>>")
    out = cut(out.select("vault", "month", "fingerprint", "fields", "parent", F.col("prev").alias("parent_month"), F.coalesce("steps", empty).alias("steps")), "drift-registry")
    counts = cut(carried(every), "drift-carried") if counting else None
    discard(every, months, fields)
    return out, counts


def steps_of(versions_: DataFrame) -> DataFrame:
    """The migration steps of a registry, one a row (columns ``STEPS``)."""
    return versions_.select("vault", F.col("month").alias("period"), F.explode("steps").alias("s")).select("vault", "period", "s.*")


def templates_of(versions_: DataFrame) -> DataFrame:
    """``(vault, month, field, type)`` of a registry."""
    one = versions_.select("vault", "month", F.explode("fields").alias("f"))
    return one.select("vault", "month", F.regexp_extract("f", "(?s)^(.*):[a-z]+$", 1).alias("field"), F.regexp_extract("f", ":([a-z]+)$", 1).alias("type"))


def drift_steps(every: DataFrame, months: DataFrame, fields: DataFrame) -> DataFrame:
    """The migration steps between consecutive templates of every vault (columns ``STEPS``)."""
    now = fields.join(months.filter("prev IS NOT NULL").select("vault", "month", "prev"), ["vault", "month"]).select(
        "vault", F.col("month").alias("period"), "field", F.col("type").alias("type_after")
    )
    was = fields.join(months.filter("next IS NOT NULL").select("vault", "month", "next"), ["vault", "month"]).select(
        "vault", F.col("next").alias("period"), "field", F.col("type").alias("type_before")
    )
    before = months.select("vault", F.col("month").alias("period"), "prev")
    diff = (
        was.join(now, ["vault", "period", "field"], "full_outer")
        .filter(~F.col("type_before").eqNullSafe(F.col("type_after")))
        .join(before, ["vault", "period"])
        .withColumn("month", F.when(F.col("type_after").isNull(), F.col("prev")).otherwise(F.col("period")))
        .select("vault", "period", "month", "field", "type_before", "type_after")
    )
    diff = cut(diff, "drift-diff")
    # only fields of a type that both left and entered can have been renamed
    one_sided = diff.filter("type_before IS NULL OR type_after IS NULL")
    both = one_sided.groupBy("vault", "period", F.coalesce("type_before", "type_after").alias("type")).agg(
        F.count("type_before").alias("l"), F.count("type_after").alias("e")
    ).filter("l > 0 AND e > 0")
    wanted = (
        one_sided.withColumn("type", F.coalesce("type_before", "type_after"))
        .join(both, ["vault", "period", "type"], "left_semi")
        .select("vault", "month", "field")
        .distinct()
    )
    prof = profiles(every, wanted)
    rows = diff.join(prof, ["vault", "month", "field"], "left").drop("month")
    return rows.groupBy("vault").applyInPandas(_steps_of_vault, STEPS)


def carried(every: DataFrame) -> DataFrame:
    """``(field, n, type)`` of every field that any note carries, with the type of most of its values."""
    typed = fields_of(every).groupBy("field", "type").agg(F.count(F.lit(1)).alias("n"))
    most = typed.groupBy("field").agg(F.sum("n").alias("n"), F.min(F.struct((-F.col("n")).alias("neg"), "type")).alias("m"))
    return most.select("field", "n", F.col("m.type").alias("type"))


def meanings(steps: DataFrame, fields: DataFrame, carried: DataFrame | None = None) -> tuple[dict[str, list[str]], dict[str, str]]:
    """(column -> its names, most used first; column -> its type).  Names that the vaults renamed into one another, at
    least three times or under similar names, are one meaning in all vaults; any other rename holds in its own vault
    (:func:`chains`).  The columns of a table cannot grow without bound: the ``MAX_COLUMNS`` names that most templates
    hold have one, then the ``FREE_COLUMNS`` other names that most notes carry (``carried``).  Values under any further
    name are kept in the table's column ``other``."""
    typed = fields.groupBy("field", "type").agg(F.count(F.lit(1)).alias("n"))
    most = typed.groupBy("field").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "field").limit(MAX_COLUMNS)
    use = typed.join(F.broadcast(most), "field").select("field", "type", "n").collect()  # five types a name
    count: dict[str, int] = {}
    for r in use:
        count[r.field] = count.get(r.field, 0) + r.n
    root = {f: f for f in count}

    def find(x: str) -> str:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a, b = F.least("field_before", "field_after").alias("a"), F.greatest("field_before", "field_after").alias("b")
    pairs = steps.filter("step = 'rename' AND field_before <> field_after").select(a, b).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    for side in ("a", "b"):  # only names that have a column
        pairs = pairs.join(F.broadcast(most.select(F.col("field").alias(side))), side, "left_semi")
    for r in pairs.orderBy(F.desc("n"), "a", "b").toLocalIterator():  # one after the other, however many
        near = r.n >= 3 or difflib.SequenceMatcher(None, _name_parts(r.a), _name_parts(r.b)).ratio() > 0.6
        if near:
            root[find(r.a)] = find(r.b)
    names: dict[str, list[str]] = {}
    for f in count:
        names.setdefault(find(f), []).append(f)
    of_type: dict[str, dict[str, int]] = {}
    columns, kinds = {}, {}
    for r in use:
        t = of_type.setdefault(find(r.field), {})
        t[r.type] = t.get(r.type, 0) + r.n
    for top, group in names.items():
        group.sort(key=lambda f: (-count[f], f))
        columns[group[0]] = group
        kinds[group[0]] = min(of_type[top], key=lambda t: (-of_type[top][t], t))
    if carried is not None:
        free = carried.join(F.broadcast(most.select("field")), "field", "left_anti").orderBy(F.desc("n"), "field").limit(FREE_COLUMNS)
        for r in free.collect():
            columns[r.field], kinds[r.field] = [r.field], r.type
    return columns, kinds


MOVES = "vault string, month string, moves map<string,string>, casts map<string,array<string>>, entered array<string>"


def chains(months: DataFrame, fields: DataFrame, steps: DataFrame, known: dict[str, str]) -> DataFrame:
    """``MOVES`` of every version (vault and month): the steps that the vault went through after that month, in order.

    ``moves``: name -> column, where the chain of renames leads to another column than ``known`` has for the name; a
    chain ends where its field leaves.  ``casts``: name -> the types it was cast to on the way.  ``entered``: columns of
    fields that entered later and stayed, whose default a note of this version gets.

    Names of one column keep apart (each has the column of its own name) in a vault that shows them to differ:
    a template has both, or one left as the other, of the same type, entered and their values were unlike."""
    marks = months.select("vault", F.col("month").alias("period"), F.lit("month").alias("step"), F.lit("").alias("field_before"), F.lit("").alias("field_after"), F.lit("").alias("type"))
    held = fields.select("vault", F.col("month").alias("period"), F.lit("field").alias("step"), F.col("field").alias("field_before"), F.lit("").alias("field_after"), "type")
    kind = F.when(F.col("step").isin("enter", "cast"), F.col("type_after")).otherwise(F.col("type_before")).alias("type")
    of = marks.unionByName(held).unionByName(steps.select("vault", "period", "step", "field_before", "field_after", kind))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        renamed: dict[str, dict[str, str]] = {}
        left: dict[str, set[str]] = {}
        cast: dict[str, dict[str, str]] = {}
        entered: dict[str, set[str]] = {}
        together: dict[tuple, set[str]] = {}  # names of one column in one template, or that left and entered unmatched
        for r in pdf.itertuples(index=False):
            name = r.field_after if r.step == "enter" else r.field_before
            if r.step in ("field", "leave", "enter") and name in known:
                same = (r.period, "") if r.step == "field" else (r.period, r.type)
                together.setdefault((*same, known[name]), set()).add(name)
            if r.step == "cast":
                cast.setdefault(r.period, {})[name] = r.type
            elif r.step == "enter":
                entered.setdefault(r.period, set()).add(name)
            elif r.step == "rename":
                renamed.setdefault(r.period, {})[r.field_before] = r.field_after
            elif r.step == "leave":
                left.setdefault(r.period, set()).add(r.field_before)
        periods = sorted(renamed.keys() | left.keys() | cast.keys() | entered.keys())
        apart = {n for names in together.values() if len(names) > 1 for n in names}
        to = {n: n if n in apart else c for n, c in known.items()}
        sources = sorted({x for of_period in renamed.values() for x in of_period} | apart)
        rows = []
        every = sorted(set(sources) | {x for of_period in cast.values() for x in of_period})
        for month in sorted(set(pdf.loc[pdf["step"] == "month", "period"])):
            moves, casts, new = {}, {}, set()
            for x in every:
                name, types = x, []
                for p in periods:
                    if p > month:
                        if name in cast.get(p, ()):
                            types.append(cast[p][name])
                        if name in renamed.get(p, ()):
                            name = renamed[p][name]
                        elif name in left.get(p, ()):
                            break
                if name in to and to[name] != known.get(x) and x in sources:
                    moves[x] = to[name]
                if types:
                    casts[x] = types
            for p in periods:  # what entered, under the name it has now, unless it left again
                if p > month:
                    names = renamed.get(p, {})
                    new = {names.get(n, n) for n in new if n not in left.get(p, ())} | entered.get(p, set())
            rows.append((pdf["vault"].iloc[0], month, moves, casts, sorted({to[n] for n in new if n in to})))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in MOVES.split(", ")])

    return of.groupBy("vault").applyInPandas(run, MOVES)


def cast_value(parts: Column, to: str) -> Column:
    """A JSON value (see :func:`json_parts`) as the type of its column; null where it cannot be read so."""
    j = parts["json"]
    kind = F.substr(j, F.lit(1), F.lit(1))
    text = F.when(kind == '"', parts["text"]).otherwise(j)
    if to == "number":
        return F.coalesce(text.try_cast("double"), F.unix_millis(F.try_to_timestamp(text)).cast("double"))
    if to == "boolean":
        low = F.lower(F.trim(text))
        return F.when(low.isin("true", "yes", "y", "on", "1"), True).when(low.isin("false", "no", "n", "off", "0"), False)
    if to == "array":
        return F.when(kind == "[", F.from_json(j, "array<string>")).otherwise(F.split(text, r"\s*,\s*"))
    if to == "object":
        return F.when(kind == "{", j).when(j.isNotNull(), F.to_json(F.struct(text.alias("value"))))
    return F.when(kind == "[", F.array_join(F.from_json(j, "array<string>"), ", ")).otherwise(text)


def _type_of(j: Column) -> Column:
    kind = F.substr(j, F.lit(1), F.lit(1))
    return (
        F.when(kind == '"', "string").when(kind == "[", "array").when(kind == "{", "object").when(kind.isin("t", "f"), "boolean").otherwise("number")
    )


def _column_names(columns: list[str]) -> dict[str, str]:
    """Column -> its name in the table.  Spark compares column names without case: those that differ in case only are numbered."""
    out: dict[str, str] = {}
    taken: set[str] = set()
    for c in sorted(columns):
        name, k = f"field_{c}", 1
        while name.lower() in taken:
            k += 1
            name = f"field_{c}_{k}"
        taken.add(name.lower())
        out[c] = name
    return out


def unify(files: DataFrame, versions_: DataFrame, defaults: dict[str, object] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """All notes as one table, each routed through its version's chain of rules in a :func:`registry`: ``path, vault,
    month, version`` (the fingerprint), one column per meaning, ``other`` and ``applied``, the rules that changed something
    in the note: renames, casts, defaults of fields that entered its vault later (``defaults`` by column, else null),
    values kept in ``other``.  ``counts`` is what :func:`survey` gave beside the registry, else it is counted again.
    ``other`` holds, by name and as JSON, what no column holds: fields without a column, the
    further values of a note that carries several names of one column, and values that cannot be read as the type of
    their column."""
    defaults = defaults or {}
    steps, fields = steps_of(versions_), templates_of(versions_)
    every = counts
    if every is None:
        spread_out = exploded(files)
        every = cut(carried(spread_out), "drift-carried")
        discard(spread_out)
    columns, kinds = meanings(steps, fields, every)
    ranked = {n: (c, i) for c, group in columns.items() for i, n in enumerate(group)}
    moves = cut(chains(versions_.select("vault", "month"), fields, steps, {n: c for n, (c, _) in ranked.items()}), "unify-moves")
    # names that a vault keeps apart from their column; never more than there are names
    own = [r.col for r in moves.select(F.explode(F.map_values("moves")).alias("col")).distinct().collect() if r.col not in columns]
    if own:
        kinds |= {r.field: r.type for r in every.join(F.broadcast(files.sparkSession.createDataFrame([(c,) for c in own], "field string")), "field").collect()}
        columns |= {c: [c] for c in own}
    notes = dated_notes(files)
    fingerprints = versions_.select("vault", "month", F.col("fingerprint").alias("version"))
    notes = notes.join(moves.join(fingerprints, ["vault", "month"], "left"), ["vault", "month"], "left")
    pairs = [x for n, (c, i) in ranked.items() for x in (F.lit(n), F.struct(F.lit(c).alias("col"), F.lit(i).alias("rank")))]
    known = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,struct<col:string,rank:int>>")

    def entry(e: Column) -> Column:
        parts, to = json_parts(e["value"]), F.try_element_at(known, e["key"])
        moved = F.try_element_at("moves", e["key"])
        rank = F.when(moved.isNull(), to["rank"]).when(moved == e["key"], 0).otherwise(MAX_COLUMNS)
        return F.struct(F.coalesce(moved, to["col"]).alias("col"), rank.alias("rank"), e["key"].alias("name"), parts["json"].alias("json"), parts["text"].alias("text"))

    # the entries of a note by column, its best name first
    read = F.transform(F.map_entries(F.try_variant_get("v", "$", "map<string,variant>")), entry)
    read = F.array_sort(F.filter(read, lambda e: e["json"] != "null"))
    notes = notes.withColumn("e", once(F.coalesce(read, F.array().cast("array<struct<col:string,rank:int,name:string,json:string,text:string>>"))))
    first = lambda e, i: e["col"].isNotNull() & ((i == 0) | ~F.get(F.col("e"), i - 1)["col"].eqNullSafe(e["col"]))
    best = F.map_from_entries(F.transform(F.filter("e", first), lambda e: F.struct(e["col"], e)))
    rest = F.filter("e", lambda e, i: ~first(e, i))
    notes = notes.withColumn("g", once(F.struct(best.alias("best"), rest.alias("rest"))))
    order = sorted(columns)
    at = {c: f"c{i}" for i, c in enumerate(order)}
    pick = {c: F.try_element_at(F.col("g.best"), F.lit(c)) for c in order}
    if order:
        notes = notes.withColumn("p", once(F.struct(*(pick[c].alias(at[c]) for c in order))))
        notes = notes.withColumn("c", once(F.struct(*(cast_value(F.col("p")[at[c]], kinds[c]).alias(at[c]) for c in order))))
    shown = _column_names(order)
    out, applied, unread = [], [], []
    for c in order:
        p = F.col("p")[at[c]]
        value = F.col("c")[at[c]]
        missing = p["name"].isNull() & F.coalesce(F.array_contains("entered", c), F.lit(False))
        default = F.lit(defaults[c]) if c in defaults else None
        out.append((value if default is None else F.when(missing, default).otherwise(value)).alias(shown[c]))
        applied.append(F.when(missing, f"default {c}"))
        on_the_way = F.array_join(F.try_element_at("casts", p["name"]), ", ")
        applied.append(F.when(p["name"].isNotNull(), F.concat(F.lit(f"cast {c} on the way to "), on_the_way)))
        applied.append(F.when(p["name"] != c, F.concat(F.lit("rename "), p["name"], F.lit(f" to {c}"))))
        was = _type_of(p["json"])
        applied.append(F.when(p["name"].isNotNull() & (was != kinds[c]), F.concat(F.lit(f"cast {c} from "), was, F.lit(f" to {kinds[c]}"))))
        unread.append(F.when(p["name"].isNotNull() & value.isNull(), F.struct(p["name"].alias("name"), p["json"].alias("json"))))
    kept = F.transform("g.rest", lambda e: F.struct(e["name"].alias("name"), e["json"].alias("json")))
    said = F.transform(
        "g.rest", lambda e: F.when(e["col"].isNull(), F.concat(F.lit("other "), e["name"])).otherwise(F.concat(F.lit("conflict "), e["name"], F.lit(" in "), e["col"]))
    )
    if order:
        kept = F.concat(kept, F.array_compact(F.array(*unread)))
        said = F.concat(F.array_compact(F.array(*applied)), said)
    other = F.when(F.size(kept) > 0, F.map_from_entries(kept))
    return notes.select("path", "vault", "month", "version", *out, other.alias("other"), said.alias("applied"))
