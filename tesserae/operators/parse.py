"""Reading notes: frontmatter, links, tags, tasks, blocks, callouts, highlights and inline fields.

One vectorised Python pass turns a text into a nested row; the child tables are exploded from it in the
JVM.  YAML and code masking are why Python is needed at all; a note is never split over workers.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import keys as K
from ..runtime import cut

# fixed patterns of the note syntax
WIKILINK = re.compile(r"(!?)\[\[([^\[\]]+?)\]\]")
TAG = re.compile(r"(?<!\w)#([\w/-]+)")
TASK = re.compile(r"^\s*[-*]\s+\[(.)\]\s+(.*)$")
DUE = re.compile(r"\b(\d{4}-\d{2}-\d{2})\b", re.A)
BLOCK = re.compile(r"(?:^|\s)\^([A-Za-z0-9-]+)\s*$")
CALLOUT = re.compile(r"^>\s*\[!([^\]]+)\]([+-]?)\s*(.*)$")
HIGHLIGHT = re.compile(r"==(.+?)==")
FIELD_LINE = re.compile(r"^\s*(?:[-*]\s+)?([A-Za-z0-9_]+)::\s*(.+)$")
FIELD_BRACKET = re.compile(r"\[([A-Za-z0-9_]+)::\s*([^\[\]]*)\]")
FIELD_PAREN = re.compile(r"\(([A-Za-z0-9_]+)::\s*([^()]*)\)")


_Loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)


class _Yaml(_Loader):
    """YAML in which only true/false are booleans, and the last of equal keys counts."""


_Yaml.yaml_implicit_resolvers = {
    c: [(tag, rx) for tag, rx in rs if tag != "tag:yaml.org,2002:bool"] for c, rs in yaml.SafeLoader.yaml_implicit_resolvers.items()
}
_Yaml.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))


def _plain(x):
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [_plain(v) for v in x]
    if isinstance(x, dt.datetime):
        if x.tzinfo:
            x = x.astimezone(dt.timezone.utc)
        return x.strftime("%Y-%m-%dT%H:%M:%S.") + f"{x.microsecond // 1000:03d}Z"
    if isinstance(x, dt.date):
        return f"{x.isoformat()}T00:00:00.000Z"
    if isinstance(x, float) and (x != x or x in (float("inf"), float("-inf"))):
        return None
    return x


def split_frontmatter(text: str) -> tuple[dict, str, int]:
    """(fields, body, lines before the body).  Bad YAML or an open block: no fields, all is body."""
    m = re.match(r"﻿?---[ \t]*\r?\n((?:.*?\r?\n)??)---[ \t]*(?:\r?\n|\Z)", text, re.S)
    if not m:
        return {}, text, 0
    try:
        data = yaml.load(m[1], Loader=_Yaml)  # noqa: S506 - a SafeLoader
    except (yaml.YAMLError, ValueError, OverflowError):
        return {}, text, 0
    body = text[m.end() :]
    return (_plain(data) if isinstance(data, dict) else {}), body, text[: m.end()].count("\n")


def mask_code(body: str) -> str:
    """Code replaced by blanks of the same length; line ends stay."""
    if "`" not in body and "~~~" not in body:
        return body
    out, fence = [], ""
    for line in body.split("\n"):
        mark = re.match(r"\s*(`{3,}|~{3,})", line)
        if fence:
            out.append(" " * len(line))
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line[mark.end() :].strip():
                fence = ""
        elif mark:
            fence = mark[1]
            out.append(" " * len(line))
        elif "`" in line:
            out.append(_mask_spans(line))
        else:
            out.append(line)
    return "\n".join(out)


def _mask_spans(line: str) -> str:
    runs = [(m.start(), m.end()) for m in re.finditer("`+", line)]
    by_size: dict[int, list[int]] = {}
    for k, (a, z) in enumerate(runs):
        by_size.setdefault(z - a, []).append(k)
    out, k, done = [], 0, 0
    while k < len(runs):
        a, z = runs[k]
        same = by_size[z - a]
        while same and same[0] <= k:
            same.pop(0)
        if not same:  # never closed: ordinary characters
            k += 1
            continue
        c = same[0]
        out += [line[done:z], " " * (runs[c][0] - z)]
        done, k = runs[c][0], c
        done = runs[c][0]
        out.append(line[done : runs[c][1]])
        done, k = runs[c][1], c + 1
    out.append(line[done:])
    return "".join(out)


class _Lines:
    """Line and UTF-16 column of an offset."""

    def __init__(self, text: str, before: int):
        self.text, self.before = text, before
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def at(self, pos: int) -> tuple[int, int]:
        from bisect import bisect_right

        k = bisect_right(self.starts, pos) - 1
        return k + 1 + self.before, len(self.text[self.starts[k] : pos].encode("utf-16-le", "surrogatepass")) // 2 + 1


def wikilink(inner: str) -> dict | None:
    """Target, alias and anchor of the text between the brackets."""
    link, bar, alias = inner.partition("|")
    link = link.strip()
    target, hash_, anchor = link.partition("#")
    out = {"target": target if hash_ else link, "alias": alias.strip() or None if bar else None}
    if hash_:
        out["block_id" if anchor.startswith("^") else "heading"] = anchor.removeprefix("^")
    return out


def _destination(raw: str) -> tuple[str, str | None]:
    m = re.match(r"""(\S+)\s+(?:"([^"]*)"|'([^']*)')\Z""", raw.strip())
    return (m[1], m[2] if m[2] is not None else m[3]) if m else (raw.strip(), None)


def markdown_links(text: str) -> Iterator[tuple[int, int, str, str, str | None, bool]]:
    """(start, stop, text, target, title, is image) of inline links; linear in the text."""
    i = 0
    while True:
        a = text.find("[", i)
        z = text.find("]", a + 1) if a >= 0 else -1
        if z < 0:
            return
        if text[z + 1 : z + 2] != "(":
            i = z + 1
            continue
        end = text.find(")", z + 2)
        if end < 0:
            return
        i = end + 1
        label, dest = text[a + 1 : z], text[z + 2 : end]
        if "\n" in label or "\n" in dest:
            continue
        target, title = _destination(dest)
        if target:
            image = a > 0 and text[a - 1] == "!"
            yield a - image, end + 1, label, target, title, image


def inline_fields(masked: str) -> list[tuple[str, str, int]]:
    """(key, value, line): the last one of a key in any case counts."""
    last: dict[str, tuple[str, str, int]] = {}
    if "::" not in masked:
        return []
    for n, line in enumerate(re.split(r"\r?\n", masked), 1):
        if "::" not in line:
            continue
        m = FIELD_LINE.match(line)
        found = [m.groups()] if m else [*FIELD_BRACKET.findall(line), *FIELD_PAREN.findall(line)]
        for key, value in found:
            if value.strip():
                last[key.lower()] = (key, value.strip(), n)
    return list(last.values())


def parse(text: str) -> tuple[dict, list[dict]]:
    """(frontmatter, nodes) of a note."""
    fm, body, before = split_frontmatter(text)
    masked = mask_code(body)
    where = _Lines(body, before)
    nodes: list[dict] = []
    for m in WIKILINK.finditer(masked):
        if m[2].strip():
            line, column = where.at(m.start())
            nodes.append({"type": "wikilink", "embed": m[1] == "!", "line": line, "column": column, "raw": body[m.start() : m.end()], **wikilink(m[2])})
    for a, z, label, target, title, image in markdown_links(masked):
        line, column = where.at(a)
        nodes.append({"type": "markdownLink", "text": label, "target": target, "title": title, "image": image, "line": line, "column": column, "raw": body[a:z]})
    tags = dict.fromkeys(t for t in TAG.findall(masked) if any(c.isalpha() or c == "_" for c in t))
    nodes += [{"type": "tag", "value": t} for t in tags]
    lines = re.split(r"\r?\n", body)
    i = 0
    while i < len(lines):
        m = CALLOUT.match(lines[i])
        i += 1
        if m:
            quoted = []
            while i < len(lines) and lines[i].startswith(">"):
                quoted.append(re.sub(r"^>\s?", "", lines[i]))
                i += 1
            nodes.append({"type": "callout", "value": m[1].strip().lower(), "title": m[3].strip(), "foldable": bool(m[2]), "content": "\n".join(quoted)})
    for n, line in enumerate(lines, 1):
        m = TASK.match(line)
        if m:
            nodes.append({"type": "task", "status": m[1], "text": m[2].strip(), "line": n})
    nodes += [{"type": "highlight", "text": t} for t in HIGHLIGHT.findall(masked)]
    for n, line in enumerate(lines, 1):
        m = BLOCK.search(line)
        if m:
            nodes.append({"type": "blockRef", "block_id": m[1], "content": line[: m.start()].strip(), "line": n})
    nodes += [{"type": "inlineField", "key": k, "value": v, "line": n} for k, v, n in inline_fields(masked)]
    return fm, nodes


def frontmatter_tags(fm: dict) -> list[str]:
    """Tags of ``tags``, else ``tag``: lists or texts, split at blanks and commas, repeats kept."""
    value = fm.get("tags", fm.get("tag")) if fm.get("tags") is not None else fm.get("tag")
    items = value if isinstance(value, list) else [value]
    out = [w.removeprefix("#") for x in items if isinstance(x, str) for w in re.split(r"[\s,]+", x)]
    return [w for w in out if w]


_FIELDS = [f.split()[0] for f in model.NODE.split(", ")]
_NODE_STRUCT = "struct<" + ",".join(f"{a}:{b}" for a, b in (f.split() for f in model.NODE.split(", "))) + ">"
PARSED = f"path string, frontmatter string, fm_tags array<string>, nodes array<{_NODE_STRUCT}>"
_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}
_NODES = pa.list_(pa.struct([(a, _ARROW[b]) for a, b in (f.split() for f in model.NODE.split(", "))]))


def parse_notes(notes: DataFrame) -> DataFrame:
    """``path, frontmatter, fm_tags, nodes`` of ``(path, content)``; a null content is an empty note."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parsed = [parse(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([json.dumps(fm, ensure_ascii=False) for fm, _ in parsed], pa.string()),
                    pa.array([frontmatter_tags(fm) for fm, _ in parsed], pa.list_(pa.string())),
                    pa.array([nodes for _, nodes in parsed], _NODES),
                ],
                ["path", "frontmatter", "fm_tags", "nodes"],
            )

    return notes.select("path", "content").mapInArrow(run, PARSED)


def file_columns(df: DataFrame) -> DataFrame:
    """Derived columns of ``files`` from ``path``; the folder of a note in the root is empty."""
    base = K.basename(F.col("path"))
    return df.withColumns(
        {
            "name": K.strip_extension(base),
            "name_key": K.link_key(F.col("path")),
            "path_key": K.path_key(F.col("path")),
            "extension": F.regexp_replace(K.extension(base), r"^\.", ""),
            "folder": F.regexp_extract("path", r"^(.*)/[^/]*$", 1),
        }
    )


def tables_of(parsed: DataFrame) -> dict[str, DataFrame]:
    """The child tables of parsed notes."""
    n = parsed.select("path", F.posexplode("nodes").alias("pos", "n"))
    link = n.filter("n.type = 'wikilink'").select(
        F.col("path").alias("source"),
        F.col("n.target").alias("target"),
        K.link_key(F.col("n.target")).alias("target_key"),
        F.when(F.col("n.target").contains("/"), K.path_key(F.col("n.target"))).alias("target_path_key"),
        F.col("n.alias").alias("alias"),
        F.col("n.heading").alias("heading"),
        F.col("n.block_id").alias("block_id"),
        F.col("n.embed").alias("is_embed"),
        "pos",
    )
    # a note's links with equal base name, anchor and embed flag count once, the first of them
    anchor = F.lower(F.coalesce("heading", F.concat(F.lit("^"), "block_id"), F.lit("")))
    rest = [c.split()[0] for c in model.LINKS.split(", ")]
    links = (
        link.groupBy("source", "is_embed", "target_key", anchor.alias("anchor"))
        .agg(F.min_by(F.struct(*rest), "pos").alias("l"))
        .select("l.*")
    )
    inline = n.filter("n.type = 'tag'").select(F.col("path").alias("file_path"), F.col("n.value").alias("tag"), F.lit(False).alias("in_frontmatter"))
    fm = parsed.select(F.col("path").alias("file_path"), F.explode("fm_tags").alias("tag"), F.lit(True).alias("in_frontmatter"))
    due = F.nullif(F.regexp_extract("n.text", r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b", 1), F.lit(""))
    tasks = n.filter("n.type = 'task'").select(
        F.col("path").alias("file_path"), F.col("n.line").alias("line_number"), F.col("n.status").alias("status"), F.col("n.text").alias("text"), due.alias("due_date")
    )
    blocks = (
        n.filter("n.type = 'blockRef'")
        .groupBy(F.col("path").alias("file_path"), F.col("n.block_id").alias("block_id"))
        .agg(F.max_by("n.content", "n.line").alias("content"), F.max("n.line").alias("line_number"))
    )
    fields = n.filter("n.type = 'inlineField'").select(
        F.col("path").alias("file_path"), F.col("n.key").alias("key"), F.lower("n.key").alias("key_norm"), F.col("n.value").alias("value"), F.col("n.line").alias("line_number")
    )
    return {"links": links, "tags": fm.unionByName(inline), "tasks": tasks, "blocks": blocks, "inline_fields": fields}


def build_tables(notes: DataFrame) -> dict[str, DataFrame]:
    """All six tables of ``(path, size, mtime, ctime, content)``.  Notes are parsed once: the parsed rows are
    written to the shared folder, and the tables are read from there."""
    parsed = cut(parse_notes(notes), "parsed-notes")
    fm = parsed.select("path", "frontmatter")
    cols = [c.split()[0] for c in model.FILES.split(", ")]
    files = file_columns(notes.join(fm, "path")).select(*cols)
    return {"files": files, **tables_of(parsed)}
