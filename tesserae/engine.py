"""Entry point: queries, lists and searches over a catalog."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import keys as K
from .operators import search as fts
from .plans.catalog import Catalog
from .plans.dql.compile import _ASCII, compile_query, in_folder
from .plans.dql.syntax import parse


def clamp(value, default: int | None, most: int | None = None) -> int | None:
    """Truncated and clamped to [0, most]; ``default`` for None and NaN."""
    if value is None or value != value:
        return default
    n = max(0, int(value))
    return n if most is None else min(n, most)


@dataclass
class Result:
    """Lazy rows of a request.  ``total`` counts all rows, ``rows`` holds the page."""

    all_rows: DataFrame
    columns: list[str]
    type: str
    offset: int = 0
    size: int | None = None
    counted: DataFrame | None = None  # what to count where ``all_rows`` does not reach beyond the page

    @property
    def df(self) -> DataFrame:
        out = self.all_rows
        if self.offset:
            out = out.offset(self.offset)
        return out if self.size is None else out.limit(self.size)

    @cached_property
    def total(self) -> int:
        return (self.all_rows if self.counted is None else self.counted).count()

    @cached_property
    def rows(self) -> list[dict]:
        return [] if self.size == 0 else [r.asDict(recursive=True) for r in self.df.collect()]

    @property
    def returned(self) -> int:
        return len(self.rows)

    @property
    def has_more(self) -> bool:
        return self.offset + self.returned < self.total

    def to_dict(self) -> dict:
        return {
            "type": self.type, "columns": self.columns, "total": self.total, "offset": self.offset, "size": self.size,
            "returned": self.returned, "hasMore": self.has_more, "rows": self.rows,
        }


class Engine:
    def __init__(self, catalog: Catalog, index: fts.GramIndex | None = None):
        self.catalog, self.index = catalog, index

    def with_index(self, directory: str) -> Engine:
        """With the search index kept in ``directory``, which is built where it is missing or of another version."""
        return Engine(self.catalog, fts.GramIndex.ensure(self.catalog.files, directory))

    def rebuild_index(self, directory: str) -> Engine:
        """With a search index of the present files, written anew."""
        return Engine(self.catalog, fts.GramIndex.write(self.catalog.files, directory))

    def query(self, text: str, offset=None, size=None, now: datetime | None = None, sort_tasks: bool = False) -> Result:
        """Rows of a query.  Paging applies outside the query's own LIMIT."""
        c = compile_query(self.catalog, parse(text, now), sort_tasks)
        return Result(c.df, c.columns, c.type, clamp(offset, 0), clamp(size, None))

    def list(self, folder: str = "", tag: str = "", name: str = "", offset=None, size=None) -> Result:
        """Files by folder, tag and part of the name, by path; an empty value is no condition."""
        f = self.catalog.files
        if folder:
            f = f.filter(in_folder(F.col("folder"), folder))
        if tag:
            t, low = tag.removeprefix("#"), tag.removeprefix("#").translate(_ASCII)
            hit = (F.col("tag") == t) | K.ascii_lower(F.col("tag")).startswith(low + "/")
            f = f.join(self.catalog.tags.filter(hit).select(F.col("file_path").alias("path")), "path", "left_semi")
        if name:
            f = f.filter(K.ascii_lower(F.col("name")).contains(name.translate(_ASCII)))
        cols = ["path", "name", "folder", "mtime"]
        return Result(f.select(*cols).orderBy("path"), cols, "LIST", clamp(offset, 0), clamp(size, None))

    def search(self, text: str, offset=None, size=None) -> Result:
        """Full-text search: ``path, name, snippet``, best first."""
        offset, size, columns = clamp(offset, 0), clamp(size, None), ["path", "name", "snippet"]
        if self.index is None or size is None:
            return Result(fts.search(self.catalog.files, text, self.index), columns, "SEARCH", offset, size)
        page = fts.search(self.catalog.files, text, self.index, most=offset + size)
        return Result(page, columns, "SEARCH", offset, size, fts.count_hits(self.catalog.files, text, self.index))

    def read_note(self, path: str, offset=None, size=None) -> Result:
        """A window of a note's body lines: 200 by default, at most 2000."""
        f = self.catalog.files.filter(F.col("path") == path)
        lines = f.select(F.posexplode(F.split(fts.body_of(F.col("content")), "\n")).alias("line", "text"))
        return Result(lines.orderBy("line"), ["line", "text"], "LINES", clamp(offset, 0), clamp(size, 200, 2000))
