"""Queries for what SQL cannot say over the tables: a few notes go through the operator, and the rows that must come
out are stored beside it.  The SQL of such a query is the list of those rows."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import actions, lint, meta, parse, scan
from ..operators.profiles import get_profile
from ..runtime import hadoop_path, shared_dir
from ..sources import notes as N
from ..sources.layout import Layout
from .catalog import Catalog

Rows = list[tuple]

NOTE = "\r\n".join([  # CRLF, repeated links, code, callout, tasks, blocks and inline fields
    "---", "title: One", "tag: '#a, b/c'", "when: 2024-05-06", "---",
    "# Head", "See [[Two|second]] and [[Two]] and [[two#Part]], ![[pic.PNG]] `[[no]]`",
    "[x](sub/a%20b.md \"t\") and ![i](p.png)", "```", "[[hidden]] #hidden", "- [x] hidden", "```",
    "> [!Note]- Folded", "> inner", "", "- [ ] open 2024-01-02", "  * [/] half", "==bright== #tag/x #1", "text ^b1", "again ^b1",
    "(rate:: 5) and done:: yes", "Key:: value [x:: 1]",
])
BROKEN = "---\nkey: [1, 2\n---\n#still [[Here]]\n"
NOTES = {"One.md": NOTE, "d/Broken.md": BROKEN, "d/Two.md": "no block\n[[#Own]]\n"}


def _notes(spark: SparkSession, notes: dict[str, str] | None = None) -> DataFrame:
    rows = [(p, len(t), 1_700_000_000_000, 1_600_000_000_000, t) for p, t in (notes or NOTES).items()]
    return spark.createDataFrame(rows, "path string, size bigint, mtime bigint, ctime bigint, content string")


def _files(spark: SparkSession, notes: dict[str, str]) -> str:
    """The notes as files in a folder that all executors share; its path."""
    root = f"{shared_dir(spark)}/fixture-{uuid.uuid4().hex}"
    for name, text in notes.items():
        path, fs = hadoop_path(spark, f"{root}/{name}")
        out = fs.create(path, True)
        out.write(bytearray(text.encode()))
        out.close()
        crc, _ = hadoop_path(spark, f"{root}/{os.path.dirname(name)}/.{os.path.basename(name)}.crc")
        fs.delete(crc, False)
    return root.removeprefix("file://")


def _built(name: str, *cols: str) -> Callable:
    return lambda spark: parse.build_tables(_notes(spark))[name].select(*cols)


def _nodes(kind: str, *cols: str) -> Callable:
    def run(spark: SparkSession) -> DataFrame:
        n = parse.parse_notes(_notes(spark)).select("path", F.explode("nodes").alias("n")).filter(F.col("n.type") == kind)
        return n.select("path", *(F.col(f"n.{c}").alias(c) for c in cols))

    return run


def src3_all_files(spark: SparkSession) -> DataFrame:
    root = _files(spark, {"a.md": "x", "_b.md": "y", ".hidden.md": "z", "d/c.MD": "w", "d/p.png": "v", ".git/e.md": "u"})
    every = N.list_files(spark, Layout.of(root), notes_only=False).select("path", F.lit("file").alias("kind"))
    return every.unionByName(N.notes(spark, root).select("path", F.lit("note").alias("kind")))


def src4_roots(spark: SparkSession) -> DataFrame:
    root = _files(spark, {"v/a.md": "x", "w/d/b.md": "y"})
    layout = Layout.of([f"{root}/v", f"{root}/w", f"{root}/w/d"])  # a root inside another is left out
    rows = [(layout.key(f"{root}/{p}"), layout.absolute(layout.key(f"{root}/{p}")) == f"{root}/{p}") for p in ("v/a.md", "w/d/b.md")]
    return spark.createDataFrame([("roots", len(layout.roots) == 2), *rows], "key string, holds boolean")


def snk1_versions(spark: SparkSession) -> DataFrame:
    """A catalog written twice: the second version counts, and one without its mark does not."""
    d = f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}"
    Catalog(**parse.build_tables(_notes(spark))).write(d)
    Catalog(**parse.build_tables(_notes(spark, {"d/Two.md": NOTES["d/Two.md"]}))).write(d)
    _notes(spark).write.parquet(f"{d}/version-000000009/files.parquet")  # a writer that died
    c = Catalog.from_parquet(spark, d)
    return c.files.agg(F.count(F.lit(1)).alias("files")).crossJoin(c.links.agg(F.count(F.lit(1)).alias("links")))  # one row each


def snk5_two_roots(spark: SparkSession) -> DataFrame:
    """Notes of two roots edited and written back, each under its own."""
    root = _files(spark, {"v/a.md": "---\ntag: x\n---\n", "w/a.md": "---\ntag: y\n---\n", "w/b.md": "plain\n"})
    layout = Layout.of([f"{root}/v", f"{root}/w"])
    e = meta.edit(N.notes(spark, list(layout.roots)), lambda doc, row: meta.normalize(doc))
    meta.write_notes(e, layout).collect()
    return N.notes(spark, list(layout.roots)).select("path", "content")


def scan2_batches(spark: SparkSession) -> DataFrame:
    """A scan in batches of two, seen after each: what is done, what remains, and the notes of the catalog."""
    before = Catalog(**parse.build_tables(_notes(spark, {"gone.md": "x", "same.md": "y", "old.md": "z"})))
    listing = _notes(spark, {"same.md": "y", "old.md": "longer #new", "n1.md": "[[same]]", "n2.md": "b", "n3.md": "c"})
    rows = [(p.batch, p.done, p.remaining, p.catalog.files.count(), p.catalog.tags.count()) for p in scan.scan_batches(before, listing, batch_size=2)]
    return spark.createDataFrame(rows, "batch int, done int, remaining int, files int, tags int")


def _edited(change: Callable) -> Callable:
    def run(spark: SparkSession) -> DataFrame:
        e = meta.edit(_notes(spark), lambda doc, row: change(doc))
        return e.select("path", "changed", F.substring_index("new_content", "# Head", 1).alias("head"), F.col("error").isNotNull().alias("failed"))

    return run


def met1_read(spark: SparkSession) -> DataFrame:
    doc = meta.split_document(NOTE)
    rows = [(k, json.dumps(meta.get(doc, k)), meta.has(doc, k)) for k in ("title", "tag", "when", "none")]
    return spark.createDataFrame(rows, "key string, value string, held boolean")


def met8_diff(spark: SparkSession) -> DataFrame:
    d = meta.diff_profile(meta.split_document(NOTE), get_profile("ssg-blog"))
    return spark.createDataFrame([(k, "|".join(v)) for k, v in d.items()], "role string, keys string")


def met9_apply(spark: SparkSession) -> DataFrame:
    doc = meta.split_document("text\n")
    meta.apply_profile(doc, get_profile("ssg-blog"), 1_700_000_000_500, 0, {"title": "007", "draft": "true", "tags": "a, b"})
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in doc.data().items()], "key string, value string")


def act1_chain(spark: SparkSession) -> DataFrame:
    """A chain over three events: one note is edited, one cannot be parsed, one was deleted."""
    p = actions.Pipeline.of({"actions": ["parse", "normalize", "rename title name", "set seen=3", "unset when"]})
    ev = spark.createDataFrame([("One.md", "change"), ("d/Broken.md", "add"), ("x.md", "unlink")], "path string, type string")
    out = actions.run_actions(ev, _notes(spark), p)
    return out.select("path", "changed", "skipped", F.col("error").isNotNull().alias("failed"), F.substring_index("new_content", "\r\n# Head", 1).alias("head")).withColumn("head", F.when(F.col("changed"), F.col("head")))


def str8_stop(spark: SparkSession) -> DataFrame:
    """``onError: stop``: what comes after the first failing note is left alone."""
    p = actions.Pipeline.of({"actions": ["normalize"], "onError": "stop"})
    notes = {"a.md": "---\ntag: x\n---\n", "b.md": BROKEN, "c.md": "---\ntag: x\n---\n"}
    ev = spark.createDataFrame([(n, "change", i) for i, n in enumerate(("a.md", "b.md", "c.md"))], "path string, type string, first_seq bigint")
    return actions.run_actions(ev, _notes(spark, notes), p).select("path", "changed", "skipped", F.col("error").isNotNull().alias("failed"))


def lnk4_diagnostics(spark: SparkSession) -> DataFrame:
    d = lint.check_links(_notes(spark), _notes(spark).select("path"))
    return d.select("file", "line", "column", "target", "reason")


def lnt1_lint(spark: SparkSession) -> DataFrame:
    own = {"base": {"required": ["title"]}, "note": {"extends": "base", "required": ["kind"], "include": "**/*.md"}}
    d = lint.lint(_notes(spark), _notes(spark).select("path"), ["links", "metadata"], lint.resolve_profile("note", own))
    return d.select("file", "rule", "reason", "target")


FRONT = "---\r\ntitle: One\r\ntag: '#a, b/c'\r\nwhen: 2024-05-06\r\n---\r\n"

#: name -> (operator, columns, rows that must come out)
CASES: dict[str, tuple[Callable, str, Rows]] = {
    "src3_all_files": (src3_all_files, "path kind", [("_b.md", "file"), ("_b.md", "note"), ("a.md", "file"), ("a.md", "note"), ("d/c.MD", "file"), ("d/c.MD", "note"), ("d/p.png", "file")]),
    "src4_roots": (src4_roots, "key holds", [("roots", True), ("v/a.md", True), ("w/d/b.md", True)]),
    "snk1_versions": (snk1_versions, "files links", [(1, 1)]),
    "snk5_two_roots": (snk5_two_roots, "path content", [("v/a.md", "---\ntags:\n- x\n---\n"), ("w/a.md", "---\ntags:\n- y\n---\n"), ("w/b.md", "plain\n")]),
    "scan2_batches": (scan2_batches, "batch done remaining files tags", [(0, 1, 4, 2, 0), (1, 3, 2, 4, 0), (2, 5, 0, 5, 1)]),
    "par1_bad_yaml": (_built("files", "path", "frontmatter"), "path frontmatter", [("One.md", '{"title": "One", "tag": "#a, b/c", "when": "2024-05-06T00:00:00.000Z"}'), ("d/Broken.md", "{}"), ("d/Two.md", "{}")]),
    "par2_positions": (_nodes("wikilink", "target", "heading", "alias", "embed", "line", "column"), "path target heading alias embed line column", [
        ("One.md", "Two", None, "second", False, 7, 5), ("One.md", "Two", None, None, False, 7, 24), ("One.md", "two", "Part", None, False, 7, 36), ("One.md", "pic.PNG", None, None, True, 7, 50),
        ("d/Broken.md", "Here", None, None, False, 4, 8), ("d/Two.md", "", "Own", None, False, 2, 1)]),
    "par4_distinct_links": (_built("links", "source", "target", "target_key", "heading", "is_embed"), "source target target_key heading is_embed", [
        ("One.md", "Two", "two", None, False), ("One.md", "two", "two", "Part", False), ("One.md", "pic.PNG", "pic", None, True), ("d/Broken.md", "Here", "here", None, False), ("d/Two.md", "", "", "Own", False)]),
    "par5_markdown_links": (_nodes("markdownLink", "text", "target", "title", "image"), "path text target title image", [("One.md", "x", "sub/a%20b.md", "t", False), ("One.md", "i", "p.png", None, True)]),
    "par6_all_tags": (_built("tags", "file_path", "tag", "in_frontmatter"), "file_path tag in_frontmatter", [("One.md", "a", True), ("One.md", "b/c", True), ("One.md", "tag/x", False), ("d/Broken.md", "still", False), ("d/Two.md", "Own", False)]),
    "par8_all_tasks": (_built("tasks", "line_number", "status", "text", "due_date"), "line_number status text due_date", [(11, " ", "open 2024-01-02", "2024-01-02"), (12, "/", "half", None), (6, "x", "hidden", None)]),
    "par10_last_block": (_built("blocks", "block_id", "content", "line_number"), "block_id content line_number", [("b1", "again", 15)]),
    "par11_all_inline": (_built("inline_fields", "key", "value", "line_number"), "key value line_number", [("rate", "5", 16), ("Key", "value [x:: 1]", 17)]),
    "par12_callout": (_nodes("callout", "value", "title", "foldable", "content"), "path value title foldable content", [("One.md", "note", "Folded", True, "inner")]),
    "par13_highlight": (_nodes("highlight", "text"), "path text", [("One.md", "bright")]),
    "met1_read": (met1_read, "key value held", [("none", "null", False), ("tag", '"#a, b/c"', True), ("title", '"One"', True), ("when", '"2024-05-06"', True)]),
    "met2_set": (_edited(lambda doc: meta.set_key(doc, "title", ["p"])), "path changed head failed", [
        ("One.md", True, FRONT.replace("title: One\r\n", "title:\r\n- p\r\n"), False), ("d/Broken.md", False, BROKEN, True), ("d/Two.md", True, "---\ntitle:\n- p\n---\n" + NOTES["d/Two.md"], False)]),
    "met3_rename": (_edited(lambda doc: meta.rename_or(doc, "tag", "title", "overwrite")), "path changed head failed", [
        ("One.md", True, "---\r\ntitle: '#a, b/c'\r\nwhen: 2024-05-06\r\n---\r\n", False), ("d/Broken.md", False, BROKEN, True), ("d/Two.md", False, NOTES["d/Two.md"], False)]),
    "met5_normalize": (_edited(meta.normalize), "path changed head failed", [
        ("One.md", True, FRONT.replace("tag: '#a, b/c'\r\n", "tags:\r\n- a\r\n- b/c\r\n"), False), ("d/Broken.md", False, BROKEN, True), ("d/Two.md", False, NOTES["d/Two.md"], False)]),
    "met8_diff": (met8_diff, "role keys", [("optional", "updatedDate|draft|tags|slug"), ("present", "title"), ("recommended", ""), ("required", "pubDate|description")]),
    "met9_apply": (met9_apply, "key value", [("draft", "true"), ("pubDate", '"2023-11-14T22:13:20Z"'), ("tags", '["a", "b"]'), ("title", '"007"'), ("updatedDate", '"2023-11-14T22:13:20Z"')]),
    "act1_chain": (act1_chain, "path changed skipped failed head", [
        ("One.md", True, False, False, "---\r\nname: One\r\ntags:\r\n- a\r\n- b/c\r\nseen: 3\r\n---"), ("d/Broken.md", False, False, True, None), ("x.md", False, True, False, None)]),
    "str8_stop": (str8_stop, "path changed skipped failed", [("a.md", True, False, False), ("b.md", False, False, True), ("c.md", False, True, False)]),
    "lnk4_diagnostics": (lnk4_diagnostics, "file line column target reason", [
        ("One.md", 7, 50, "![[pic.PNG]]", "not_found"), ("One.md", 8, 1, "sub/a%20b.md", "not_found"), ("One.md", 8, 27, "p.png", "not_found"), ("d/Broken.md", 4, 8, "[[Here]]", "not_found"), ("d/Two.md", 2, 1, "[[#Own]]", "not_found")]),
    "lnt1_lint": (lnt1_lint, "file rule reason target", [
        ("One.md", "links", "not_found", "![[pic.PNG]]"), ("One.md", "links", "not_found", "sub/a%20b.md"), ("One.md", "links", "not_found", "p.png"),  # a root note is not under **/
        ("d/Broken.md", "links", "not_found", "[[Here]]"), ("d/Broken.md", "metadata/required-missing", "required_missing", "kind"), ("d/Broken.md", "metadata/required-missing", "required_missing", "title"),
        ("d/Two.md", "links", "not_found", "[[#Own]]"), ("d/Two.md", "metadata/required-missing", "required_missing", "kind"), ("d/Two.md", "metadata/required-missing", "required_missing", "title")]),
}


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, int):
        return str(x)
    return "'" + str(x).replace("'", "''") + "'"


def _sql(columns: str, rows: Rows) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) t({', '.join(chr(34) + c + chr(34) for c in columns.split())})"


def queries():
    return {n: (lambda spark, d, f=f: f(spark)) for n, (f, _, _) in CASES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: _sql(c, rows) for n, (_, c, rows) in CASES.items()}
