"""Note files as DataFrames.

Spark's own file sources leave out names that begin with ``_``, which are notes here, and know no birth
time; so files are listed by walking, in parallel over the folders of the upper levels, and their
contents are read where their rows are.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import time
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from .layout import Layout

LISTING = "path string, absolute string, size bigint, mtime bigint, ctime bigint"


def walk(top: str, deep: bool = True, notes_only: bool = True) -> Iterator[tuple[str, int, int, int]]:
    """(path, size, mtime, birth time) of regular files; hidden names and links are skipped."""
    try:
        entries = sorted(os.scandir(top), key=lambda e: e.name)
    except FileNotFoundError:
        return
    for e in entries:
        if e.name.startswith("."):
            continue
        if e.is_dir(follow_symlinks=False):
            if deep:
                yield from walk(e.path, True, notes_only)
        elif e.is_file(follow_symlinks=False) and (not notes_only or e.name.lower().endswith(".md")):
            s = e.stat()
            birth = getattr(s, "st_birthtime", 0) or s.st_ctime
            yield e.path, s.st_size, s.st_mtime_ns // 1_000_000, int(birth * 1000)


def present_roots(layout: Layout) -> tuple[list[str], list[str]]:
    """(present, missing) roots; a missing one is skipped with a warning, all missing is an error."""
    have = [r for r in layout.roots if os.path.isdir(r)]
    missing = [r for r in layout.roots if r not in have]
    if not have:
        raise FileNotFoundError(f"none of the roots exists: {', '.join(missing)}")
    for r in missing:
        warnings.warn(f"root {r} is missing and skipped", stacklevel=2)
    return have, missing


def folders(roots: list[str], depth: int = 2) -> list[tuple[str, bool]]:
    """(folder, whether all below it belongs to it): what the tasks of a listing walk."""
    out: list[tuple[str, bool]] = []

    def go(d: str, level: int) -> None:
        out.append((d, level == depth))
        if level < depth:
            for e in sorted(os.scandir(d), key=lambda e: e.name):
                if e.is_dir(follow_symlinks=False) and not e.name.startswith("."):
                    go(e.path, level + 1)

    for r in roots:
        go(r, 0)
    return out


def list_files(spark: SparkSession, layout: Layout, notes_only: bool = True) -> DataFrame:
    """Listing of the present roots, each file once."""
    parts = folders(present_roots(layout)[0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, deep in zip(b["dir"], b["deep"]):
                rows = [(layout.key(p), p, size, mtime, ctime) for p, size, mtime, ctime in walk(d, bool(deep), notes_only)]
                yield pd.DataFrame(rows, columns=["path", "absolute", "size", "mtime", "ctime"])

    dirs = spark.createDataFrame(parts, "dir string, deep boolean")
    tasks = min(len(parts), spark.sparkContext.defaultParallelism * 4)
    return dirs.repartition(tasks).mapInPandas(run, LISTING).dropDuplicates(["absolute"])


def read_notes(listing: DataFrame) -> DataFrame:
    """Adds ``content`` (UTF-8, damaged bytes replaced) and ``error`` of files that cannot be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text, error = [], []
            for p in b["absolute"]:
                try:
                    with open(p, "rb") as f:
                        text.append(f.read().decode("utf-8", "replace"))
                    error.append(None)
                except OSError as e:
                    text.append(None)
                    error.append(str(e))
            yield b.assign(content=text, error=error)

    return listing.mapInPandas(run, LISTING + ", content string, error string")


def notes(spark: SparkSession, roots: str | list[str]) -> DataFrame:
    """``path, size, mtime, ctime, content`` of all readable notes."""
    df = read_notes(list_files(spark, Layout.of(roots)))
    return df.filter("error IS NULL").select("path", "size", "mtime", "ctime", "content")


class _Folder(InputPartition):
    def __init__(self, folder: str, deep: bool):
        super().__init__((folder, deep))


class NoteReader(DataSourceReader):
    def __init__(self, layout: Layout):
        self.layout = layout

    def partitions(self):
        return [_Folder(d, deep) for d, deep in folders(present_roots(self.layout)[0])]

    def read(self, partition):
        d, deep = partition.value
        for p, size, mtime, ctime in walk(d, deep):
            with open(p, "rb") as f:
                yield self.layout.key(p), size, mtime, ctime, f.read().decode("utf-8", "replace")


class WatchReader(SimpleDataSourceStreamReader):
    """Change events between listings.  The offset is the number of a listing; the listing itself and the events that
    led to it are kept in the folder ``state``, so offsets stay small and a restart replays exactly what was seen.
    Files younger than the stability window wait for the next poll."""

    def __init__(self, layout: Layout, stable_ms: int, state: str):
        self.layout, self.stable_ms, self.state = layout, stable_ms, state
        os.makedirs(state, exist_ok=True)

    def _file(self, version: int) -> str:
        return os.path.join(self.state, f"{version:012d}.json")

    def _load(self, version: int) -> dict:
        with open(self._file(version), encoding="utf-8") as f:
            return json.load(f)

    def _store(self, version: int, kept: dict) -> dict:
        with open(self._file(version) + ".writing", "w", encoding="utf-8") as f:
            json.dump(kept, f)
        os.replace(self._file(version) + ".writing", self._file(version))
        return {"version": version}

    def _snapshot(self) -> dict[str, list[int]]:
        out = {}
        for r in self.layout.roots:
            for p, size, mtime, _ in walk(r):
                out[self.layout.key(p)] = [mtime, size]
        return out

    def initialOffset(self) -> dict:
        return self._store(0, {"files": self._snapshot(), "seq": 0, "events": []})

    def read(self, start: dict):
        before = self._load(start["version"])
        now = time.time() * 1000
        old, new, seq, events = before["files"], {}, before["seq"], []
        for path, (mtime, size) in self._snapshot().items():
            known = old.get(path)
            if known == [mtime, size]:
                new[path] = known
            elif now - mtime < self.stable_ms:
                if known is not None:
                    new[path] = known
            else:
                seq += 1
                events.append([path, "change" if known is not None else "add", mtime, size, seq])
                new[path] = [mtime, size]
        for path in sorted(set(old) - set(new)):
            if not os.path.exists(self.layout.absolute(path)):
                seq += 1
                events.append([path, "unlink", None, None, seq])
            else:
                new[path] = old[path]
        if not events:
            return iter([]), start
        return iter([tuple(e) for e in events]), self._store(start["version"] + 1, {"files": new, "seq": seq, "events": events})

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([tuple(e) for v in range(start["version"] + 1, end["version"] + 1) for e in self._load(v)["events"]])

    def commit(self, end: dict) -> None:
        for name in os.listdir(self.state):
            if name.endswith(".json") and int(name.split(".")[0]) < end["version"] - 1:
                os.remove(os.path.join(self.state, name))


class NotesDataSource(DataSource):
    """``spark.read.format("tesserae_notes").option("roots", "/a:/b").load()`` reads notes;
    ``spark.readStream`` of the same gives change events."""

    @classmethod
    def name(cls) -> str:
        return "tesserae_notes"

    def _layout(self) -> Layout:
        return Layout.of([r for r in self.options.get("roots", "").split(os.pathsep) if r])

    def schema(self) -> str:
        if self.options.get("events", "false") == "true":
            return "path string, type string, mtime bigint, size bigint, seq bigint"
        return "path string, size bigint, mtime bigint, ctime bigint, content string"

    def reader(self, schema) -> NoteReader:
        return NoteReader(self._layout())

    def simpleStreamReader(self, schema) -> WatchReader:
        return WatchReader(self._layout(), int(self.options.get("stable_ms", "100")), self.options["state"])


def watch(spark: SparkSession, roots: list[str], stable_ms: int = 100, state: str | None = None) -> DataFrame:
    """Stream of change events; files that exist at the start give none.  ``state``: a folder on the machine that holds
    the files, for the listings; one beside the stream's checkpoint lets a restart go on where it stopped."""
    spark.dataSource.register(NotesDataSource)
    state = state or tempfile.mkdtemp(prefix="tesserae-watch-")
    return spark.readStream.format("tesserae_notes").options(roots=os.pathsep.join(roots), events="true", stable_ms=str(stable_ms), state=state).load()


def merged_config(start: str, home: str | None = None) -> dict:
    """Settings of ``.tesserae/config.{yaml,yml,json5,json}``: the project's over the user's, key by key."""
    out: dict = {}
    for base in (home or os.path.expanduser("~"), start):
        out = _overlay(out, _config_in(base))
    return out


def _config_in(base: str) -> dict:
    import yaml

    for ext in ("yaml", "yml", "json5", "json"):
        p = os.path.join(base, CONFIG_DIR, f"config.{ext}")
        if os.path.exists(p):
            with open(p, encoding="utf-8") as f:
                text = f.read()
            data = json.loads(text) if ext == "json" else read_json5(text) if ext == "json5" else yaml.safe_load(text)
            if data is not None and not isinstance(data, dict):
                raise ValueError(f"{p} is no mapping")
            return data or {}
    return {}


_JSON5 = re.compile(r"""(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|//[^\n\u2028\u2029]*|/\*.*?\*/|(?P<sign>[+-]?)(?P<odd>Infinity|NaN)\b|(?P<hex>[+-]?0[xX][0-9a-fA-F]+)|(?P<number>[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)|(?P<word>[\w$]+)|(?P<comma>,\s*(?=[}\]]))""", re.S)


def read_json5(text: str):
    """JSON5 read as JSON: comments and trailing commas go, single quotes, plain keys and numbers of other forms are written anew."""

    def quoted(t: str) -> str:
        body = re.sub(r"\\(\r\n|[\s\S])", lambda m: "" if m[1] in ("\n", "\r\n", "\u2028", "\u2029") else {"'": "'", "v": "\\u000b", "0": "\\u0000"}.get(m[1], m[0] if m[1] in '"\\/bfnrtu' else m[1]), t[1:-1])
        return '"' + (re.sub(r'(?<!\\)"', '\\"', body) if t[0] == "'" else body) + '"'

    def token(m: re.Match) -> str:
        if m["text"]:
            return quoted(m["text"])
        if m["odd"]:
            return ("-" if m["sign"] == "-" else "") + m["odd"]
        if m["hex"]:
            return str(int(m["hex"], 16))
        if m["number"]:
            x = m["number"].removeprefix("+")
            x = re.sub(r"^(-?)\.", r"\g<1>0.", x)
            return re.sub(r"\.(?=$|[eE])", ".0", x)
        if m["word"]:
            return m["word"] if m["word"] in ("true", "false", "null") else json.dumps(m["word"])
        return "" if m["comma"] else " "

    def uncomma(t: str) -> str:
        return re.sub(r"""("(?:[^"\\]|\\.)*")|,\s*(?=[}\]])""", lambda m: m[1] or "", t)

    return json.loads(uncomma(_JSON5.sub(token, text)))


CONFIG_DIR = ".tesserae"


def _overlay(low: dict, high: dict) -> dict:
    out = dict(low)
    for k, v in high.items():
        out[k] = _overlay(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def emit(rows: list[dict] | dict, kind: str = "json") -> str:
    """Pretty JSON, or YAML; another kind is JSON."""
    import yaml

    return yaml.safe_dump(rows, allow_unicode=True, sort_keys=False) if kind == "yaml" else json.dumps(rows, ensure_ascii=False, indent=2, default=str)
