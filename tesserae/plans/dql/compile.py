"""Syntax tree -> DataFrame.

The plan starts from ``files`` and grows only what the query names: implicit arrays and inline fields
are pre-aggregated and joined on demand, conditions on tags and links become semi joins when they stand
alone and existence flags under OR and NOT.  Links are matched by equi-joins on their path or name key,
never by an OR of both.  No Python runs in the plan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import keys as K
from ...functions import typed as T
from ..catalog import Catalog
from . import syntax as S

# fixed values: the implicit fields of the query language, their columns and other names
DIRECT = {
    "file.name": "name",
    "file.path": "path",
    "file.folder": "folder",
    "file.extension": "extension",
    "file.size": "size",
    "file.mtime": "mtime",
    "file.ctime": "ctime",
}
NUMERIC = frozenset(("size", "mtime", "ctime"))
ARRAYS = ("file.tags", "file.inlinks", "file.outlinks", "file.tasks")
ALIASES = {
    "file.tags": ("file.tags", "tags", "tag"),
    "file.inlinks": ("file.inlinks", "inlinks", "inlink"),
    "file.outlinks": ("file.outlinks", "outlinks", "outlink"),
    "file.tasks": ("file.tasks", "tasks", "task"),
    "file.frontmatter": ("file.frontmatter", "frontmatter"),
}
AGGREGATES = frozenset(("count()", "length(rows)", "rows"))
_NAME = re.compile(r"[A-Za-z0-9_]+\Z")


@dataclass
class Compiled:
    df: DataFrame
    columns: list[str]
    type: str


def compile_query(catalog: Catalog, query: S.Query, sort_tasks: bool = False) -> Compiled:
    """``sort_tasks`` honours SORT in TASK queries, which are otherwise ordered by path and line."""
    return _Compiler(catalog, query, sort_tasks).run()


class _Compiler:
    def __init__(self, catalog: Catalog, query: S.Query, sort_tasks: bool):
        self.c, self.q, self.sort_tasks = catalog, query, sort_tasks
        self.joins: dict[str, DataFrame] = {}  # sub-plans keyed by `__path`, joined once each
        self.semis: list[DataFrame] = []  # of one column `__path`
        self.inline: set[str] = set()
        self.dynamic: set[str] = set()
        self.whole = False
        self.flags = 0
        self.task = query.type == "TASK"

    # ---- fields -------------------------------------------------------------------------------------

    def direct(self, name: str) -> Column:
        return F.col(f"f_{DIRECT[name]}")

    def parts(self, name: str) -> Column:
        """A frontmatter field, taken from the parsed object once per row."""
        self.dynamic.add(name)
        return F.col("__fields")[name]

    def inline_text(self, name: str) -> Column:
        self.inline.add(name.lower())
        return F.col(f"__inline_{name.lower()}")

    def array(self, name: str) -> Column:
        """The implicit array, sorted, empty where a file has none."""
        col = "__" + name.replace(".", "_")
        if name not in self.joins:
            self.joins[name] = {
                "file.tags": self.tags_plan,
                "file.inlinks": self.inlinks_plan,
                "file.outlinks": self.outlinks_plan,
                "file.tasks": self.tasks_plan,
            }[name](col)
        kind = "array<struct<status:string,text:string,due:string>>" if name == "file.tasks" else "array<string>"
        return F.coalesce(F.col(col), F.array().cast(kind))

    def tags_plan(self, col: str) -> DataFrame:
        t = self.c.tags.filter("tag IS NOT NULL")
        return t.groupBy(F.col("file_path").alias("__path")).agg(F.sort_array(F.collect_set("tag")).alias(col))

    def outlinks_plan(self, col: str) -> DataFrame:
        return self.c.links.groupBy(F.col("source").alias("__path")).agg(F.sort_array(F.collect_set("target")).alias(col))

    def tasks_plan(self, col: str) -> DataFrame:
        item = F.struct(
            "line_number", F.col("status").alias("status"), F.col("text").alias("text"), F.col("due_date").alias("due")
        )
        t = self.c.tasks.groupBy(F.col("file_path").alias("__path")).agg(F.sort_array(F.collect_list(item)).alias("l"))
        return t.select("__path", F.transform("l", lambda x: F.struct(x.status.alias("status"), x.text.alias("text"), x.due.alias("due"))).alias(col))

    def link_keys(self, links: DataFrame) -> DataFrame:
        """``kind, key, source``: P for links with a path, B for bare names."""
        qualified = F.col("target_path_key").isNotNull()
        return links.select(
            F.when(qualified, "P").otherwise("B").alias("kind"),
            F.when(qualified, F.col("target_path_key")).otherwise(F.col("target_key")).alias("key"),
            "source",
        )

    def inlinks_plan(self, col: str) -> DataFrame:
        sets = self.link_keys(self.c.links).groupBy("kind", "key").agg(F.collect_set("source").alias("s"))
        f = self.c.files.select(F.col("path").alias("__path"), "path_key", "name_key")
        p = sets.filter("kind = 'P'").select(F.col("key").alias("path_key"), F.col("s").alias("p"))
        b = sets.filter("kind = 'B'").select(F.col("key").alias("name_key"), F.col("s").alias("b"))
        none = F.array().cast("array<string>")
        both = F.array_union(F.coalesce("p", none), F.coalesce("b", none))
        return f.join(p, "path_key", "left").join(b, "name_key", "left").select("__path", F.sort_array(both).alias(col))

    def typed(self, name: str) -> T.TypedKey:
        if name in DIRECT:
            c = self.direct(name)
            return T.of_number(c) if DIRECT[name] in NUMERIC else T.of_text(c)
        if name in ARRAYS:
            return T.of_text(F.to_json(self.array(name)))
        if name == "file.frontmatter":
            return T.of_text(F.coalesce("f_frontmatter", F.lit("{}")))
        self.check(name)
        return T.either(T.of_parts(self.parts(name)), T.of_text(self.inline_text(name)))

    def check(self, name: str) -> None:
        if not _NAME.match(name):
            raise S.DqlSyntaxError(f"unsupported field {name}")

    def output(self, name: str) -> Column:
        if name in DIRECT:
            return self.direct(name)
        if name in ARRAYS:
            return self.array(name)
        if name == "file.frontmatter":
            return F.coalesce(F.col("f_frontmatter"), F.lit("{}"))
        return self.typed(name).text()

    # ---- conditions ---------------------------------------------------------------------------------

    def exists(self, paths: DataFrame, alone: bool) -> Column | None:
        """A condition "path is in paths": a semi join where it stands alone, else a flag."""
        if alone:
            self.semis.append(paths)
            return None
        self.flags += 1
        flag = f"__flag{self.flags}"
        self.joins[flag] = paths.distinct().withColumn(flag, F.lit(True))
        return F.coalesce(F.col(flag), F.lit(False))

    def tagged(self, tag: str, any_case: bool = False) -> DataFrame:
        t = F.col("tag")
        same = K.ascii_lower(t) == tag.translate(_ASCII) if any_case else t == tag
        below = K.ascii_lower(t).startswith(tag.translate(_ASCII) + "/")
        return self.c.tags.filter(same | below).select(F.col("file_path").alias("__path"))

    def linking(self, target: str) -> DataFrame:
        t = K.strip_link(target)
        cond = F.col("target_path_key") == K.path_key_of(t) if "/" in t else F.col("target_key") == K.link_key_of(t)
        return self.c.links.filter(cond).select(F.col("source").alias("__path"))

    def linked_from(self, source: str) -> DataFrame:
        t = K.strip_link(source)
        own = F.col("path_key") == K.path_key_of(t) if "/" in t else F.col("name_key") == K.link_key_of(t)
        src = self.c.files.filter(own).select(F.col("path").alias("source"))
        return self.files_of(self.link_keys(self.c.links.join(src, "source", "left_semi")).select("kind", "key").distinct())

    def source(self, s: S.Source) -> Column | None:
        if s.kind == "tag":
            return self.exists(self.tagged(s.value), True)
        if s.kind == "link":
            return self.exists(self.linking(s.value), True)
        return in_folder(F.col("f_folder"), s.value) if s.value else None

    def condition(self, e, alone: bool = True) -> Column | None:
        """A Column, or None where the condition became a semi join."""
        if isinstance(e, S.Logic):
            if e.op == "and":
                a, b = self.condition(e.left, alone), self.condition(e.right, alone)
                return b if a is None else a if b is None else a & b
            return self.condition(e.left, False) | self.condition(e.right, False)
        if isinstance(e, S.Not):
            return ~self.condition(e.expr, False)
        if isinstance(e, S.Truthy):
            return self.truthy(e.field, alone)
        if isinstance(e, S.IsNull):
            return self.is_null(e)
        if isinstance(e, S.Compare):
            return self.compare(e)
        return self.call(e, alone)

    def done(self) -> Column:
        return F.col("k_status").isin("x", "X")

    def key_count(self) -> Column:
        return F.coalesce(F.size(F.json_object_keys("f_frontmatter")), F.lit(0))

    def owning(self, name: str) -> DataFrame:
        """Notes with at least one element of an implicit array: a semi join, where the array itself would be built of
        all elements, a hot link key's sources among them."""
        if name == "file.tags":
            return self.c.tags.filter("tag IS NOT NULL").select(F.col("file_path").alias("__path"))
        if name == "file.outlinks":
            return self.c.links.filter("target IS NOT NULL").select(F.col("source").alias("__path"))
        if name == "file.tasks":
            return self.c.tasks.select(F.col("file_path").alias("__path"))
        return self.files_of(self.link_keys(self.c.links).select("kind", "key").distinct())

    def files_of(self, keys: DataFrame) -> DataFrame:
        """Notes that the link keys ``(kind, key)`` name."""
        f = self.c.files
        by_path = f.join(keys.filter("kind = 'P'").select(F.col("key").alias("path_key")), "path_key", "left_semi")
        by_name = f.join(keys.filter("kind = 'B'").select(F.col("key").alias("name_key")), "name_key", "left_semi")
        return by_path.select(F.col("path").alias("__path")).unionByName(by_name.select(F.col("path").alias("__path")))

    def truthy(self, name: str, alone: bool = False) -> Column | None:
        if self.task and name == "completed":
            return self.done()
        if name in DIRECT:
            c = self.direct(name)
            return c.isNotNull() if DIRECT[name] in NUMERIC else c.isNotNull() & (c != "")
        if name in ARRAYS:
            return self.exists(self.owning(name), alone)
        if name == "file.frontmatter":
            return self.key_count() > 0
        self.check(name)
        parts = self.parts(name)
        return T.truthy(T.of_parts(parts), parts, self.inline_text(name))

    def is_null(self, e: S.IsNull) -> Column:
        if e.field == "file.frontmatter":
            return self.key_count() > 0 if e.negated else self.key_count() == 0
        null = self.typed(e.field).is_null()
        return ~null if e.negated else null

    def compare(self, e: S.Compare) -> Column:
        if self.task and e.field == "completed" and not e.fn and e.op in ("=", "!="):
            want = e.value is True or e.value == "true"
            return self.done() if want == (e.op == "=") else ~self.done()
        if e.fn:
            return self.scalar(e.fn, e.field).compare(e.op, e.value)
        value = e.value
        if e.field in DIRECT:
            if DIRECT[e.field] in NUMERIC:
                if isinstance(value, str):
                    try:
                        value = float(value)
                    except ValueError:
                        pass  # a number sorts before any text
            elif isinstance(value, (int, float)) and not isinstance(value, bool):
                value = repr(float(value))  # a text column turns a number into text
        return self.typed(e.field).compare(e.op, value)

    def scalar(self, fn: str, name: str) -> T.TypedKey:
        if fn == "length":
            if name in ARRAYS:
                return T.of_number(F.size(self.array(name)))
            return T.of_number(F.length(self.text(name)))
        k = self.typed(name)
        if fn == "round":
            prefix = F.regexp_extract(k.txt, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
            num = F.when(k.rank == 1, k.num).when(k.rank == 2, F.coalesce(F.nullif(prefix, F.lit("")).try_cast("double"), F.lit(0.0)))
            return T.of_number(F.signum(num) * F.floor(F.abs(num) + 0.5))
        fold = K.ascii_lower if fn == "lower" else K.ascii_upper
        return T.of_text(fold(self.text(name)))

    def text(self, name: str) -> Column:
        if name in DIRECT:
            return self.direct(name).cast("string")
        return self.typed(name).text()

    def call(self, e: S.Call, alone: bool) -> Column | None:
        arg = e.arg if isinstance(e.arg, str) else repr(e.arg)
        if e.fn in ("contains", "icontains"):
            if e.field == "file.tags":
                return self.exists(self.tagged(arg.removeprefix("#"), e.fn == "icontains"), alone)
            if e.field == "file.outlinks":
                return self.exists(self.linking(arg), alone)
            if e.field == "file.inlinks":
                return self.exists(self.linked_from(arg), alone)
        t = self.text(e.field)
        if e.fn == "regexmatch":
            return K.regex_match(t, arg)
        t, a = K.ascii_lower(t), F.lit(arg.translate(_ASCII))
        if e.fn == "startswith":
            return t.startswith(a)
        if e.fn == "endswith":
            return t.endswith(a)
        return t.contains(a)

    # ---- plan ---------------------------------------------------------------------------------------

    def base(self, where: Column | None) -> DataFrame:
        f = self.c.files
        cols = [c for c in (*DIRECT.values(), "frontmatter") if c in f.columns]
        df = f.select(*(F.col(c).alias(f"f_{c}") for c in cols))
        if self.dynamic or self.whole:
            is_object = F.ltrim("f_frontmatter").startswith("{")
            df = df.withColumn("__fm", T.once(F.when(is_object, F.try_parse_json("f_frontmatter"))))
        if self.dynamic:
            fields = [T.json_parts(F.try_variant_get("__fm", f"$.{n}", "variant")).alias(n) for n in sorted(self.dynamic)]
            df = df.withColumn("__fields", T.once(F.struct(*fields)))
        if self.task:
            t = self.c.tasks.select(*(F.col(c).alias(f"k_{c}") for c in ("file_path", "line_number", "status", "text", "due_date")))
            df = t.join(df, F.col("k_file_path") == F.col("f_path"))
        for paths in self.semis:
            df = df.join(paths, F.col("f_path") == F.col("__path"), "left_semi")
        if self.inline:
            fields = self.c.inline_fields.filter(F.col("key_norm").isin(*sorted(self.inline)))
            last = [
                F.max_by(F.when(F.col("key_norm") == k, F.col("value")), F.when(F.col("key_norm") == k, F.col("line_number"))).alias(f"__inline_{k}")
                for k in sorted(self.inline)
            ]
            self.joins["inline"] = fields.groupBy(F.col("file_path").alias("__path")).agg(*last)
        for plan in self.joins.values():
            df = df.join(plan, F.col("f_path") == F.col("__path"), "left").drop("__path")
        return df if where is None else df.filter(where)

    def where(self) -> Column | None:
        parts = []
        if self.q.source:
            parts.append(self.source(self.q.source))
        if self.q.where is not None:
            parts.append(self.condition(self.q.where))
        out = None
        for p in parts:
            if p is not None:
                out = p if out is None else out & p
        return out

    def run(self) -> Compiled:
        q = self.q
        where = self.where()
        if self.task:
            return self.tasks(where)
        return self.grouped(where) if q.group_by else self.plain(where)

    def tasks(self, where: Column | None) -> Compiled:
        q = self.q
        cols = ["task.text", "task.status", "task.due", "file.path"]
        order = [c for s in q.sort for c in self.sort_columns(s)] if self.sort_tasks else []
        df = self.base(where)
        if q.limit is not None or order:
            df = df.orderBy(*order, "f_path", "k_line_number")
        if q.limit is not None:
            df = df.limit(q.limit)
        values = ("k_text", "k_status", "k_due_date", "f_path")
        return Compiled(df.select(*(F.col(v).alias(n) for v, n in zip(values, cols))), cols, "TASK")

    def sort_columns(self, s: S.SortKey) -> list[Column]:
        if s.field in ARRAYS or s.field == "file.frontmatter":
            raise S.DqlSyntaxError(f"cannot sort by {s.field}, it is no scalar")
        if s.field in DIRECT:
            return [self.direct(s.field).desc() if s.descending else self.direct(s.field).asc()]
        return self.typed(s.field).order(s.descending)

    def elements(self) -> Column:
        """The array that FLATTEN opens; a file without elements has no row."""
        f = self.q.flatten
        if f == "file.tasks":
            return F.transform(self.array(f), lambda x: F.to_json(x))
        if f in ARRAYS:
            return self.array(f)
        if f == "file.frontmatter":
            self.whole = True
            values = F.map_values(F.try_variant_get("__fm", "$", "map<string,variant>"))
            return F.transform(values, lambda v: T.of_variant(v).text())
        raise S.DqlSyntaxError(f"FLATTEN needs an array, {f} is a single value")

    def plain(self, where: Column | None) -> Compiled:
        q = self.q
        names = ([] if q.without_id else ["file.name"]) + (["file.path"] if q.type == "LIST" else q.fields)
        flat = ALIASES.get(q.flatten, ()) if q.flatten else ()
        if q.flatten:
            elements = self.elements()
            if q.type == "LIST" or not any(f in flat for f in q.fields):
                names = [*names, q.flatten]
        names = list(dict.fromkeys(names))
        out = [F.col("__flat") if n in flat else self.output(n) for n in names]
        order = [c for s in q.sort for c in self.sort_columns(s)]
        df = self.base(where)
        if q.flatten:
            df = df.withColumn("__flat", F.explode(elements))
        if order or q.limit is not None:
            df = df.orderBy(*order, "f_path", *(["__flat"] if q.flatten else []))
        if q.limit is not None:
            df = df.limit(q.limit)
        return Compiled(df.select(*(c.alias(n) for c, n in zip(out, names))), names, q.type)

    def grouped(self, where: Column | None) -> Compiled:
        q = self.q
        key = self.typed(q.group_by)
        names = list(dict.fromkeys(q.fields if q.type == "TABLE" and q.fields else [q.group_by, "rows"]))
        elements = self.elements() if q.flatten else None
        aggs = []
        for i, n in enumerate(names):
            if n in ("count()", "length(rows)"):
                a = F.count_distinct("f_path")
            elif n == "rows":
                a = F.sort_array(F.collect_set("f_path"))
            elif "(" in n:
                raise S.DqlSyntaxError(f"unsupported field {n}")
            else:
                a = F.min_by(self.output(n), F.col("f_path"))  # of the first file by path
            aggs.append(a.alias(f"o{i}"))
        order = []
        for j, s in enumerate(q.sort):
            if s.field in ARRAYS or s.field == "file.frontmatter":
                raise S.DqlSyntaxError(f"cannot sort by {s.field}, it is no scalar")
            k = self.typed(s.field)
            part = {"rank": k.rank, "num": k.num, "txt": k.txt}
            for p, c in part.items():
                aggs.append(F.min_by(c, F.col("f_path")).alias(f"s{j}_{p}"))
                order.append(F.col(f"s{j}_{p}").desc() if s.descending else F.col(f"s{j}_{p}").asc())
        df = self.base(where)
        if elements is not None:
            df = df.withColumn("__flat", F.explode(elements))
        df = df.groupBy(key.rank.alias("__rank"), key.num.alias("__num"), key.txt.alias("__txt")).agg(*aggs)
        if order or q.limit is not None:
            df = df.orderBy(*order, "__rank", "__num", "__txt")
        if q.limit is not None:
            df = df.limit(q.limit)
        return Compiled(df.select(*(F.col(f"o{i}").alias(n) for i, n in enumerate(names))), names, q.type)


_ASCII = str.maketrans(K.UPPER, K.LOWER)


def in_folder(folder: Column, name: str) -> Column:
    return (folder == name) | K.ascii_lower(folder).startswith(name.translate(_ASCII) + "/")
