"""The six tables of a collection as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..runtime import exists, hadoop_path, load, remove
from .dql.syntax import NotIndexed


VERSION, COMPLETE = "version-", "_COMPLETE"


def _versions(spark: SparkSession, directory: str) -> list[int]:
    """The complete versions of a written catalog, oldest first."""
    root, fs = hadoop_path(spark, directory)
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(int(n[len(VERSION) :]) for n in names if n.startswith(VERSION) and exists(spark, f"{directory.rstrip('/')}/{n}/{COMPLETE}"))


def _current(spark: SparkSession, directory: str) -> str:
    """The folder of the newest complete version; the directory itself where tables lie there directly."""
    found = _versions(spark, directory)
    return f"{directory.rstrip('/')}/{VERSION}{found[-1]:09d}" if found else directory


@dataclass(frozen=True)
class Catalog:
    files: DataFrame
    links: DataFrame
    tags: DataFrame
    tasks: DataFrame
    blocks: DataFrame
    inline_fields: DataFrame

    @classmethod
    def from_tables(cls, spark: SparkSession, **tables: DataFrame) -> Catalog:
        """Tables not given are empty."""
        unknown = set(tables) - set(model.TABLES)
        if unknown:
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        return cls(**{n: tables.get(n) if n in tables else spark.createDataFrame([], s) for n, s in model.TABLES.items()})

    @classmethod
    def from_parquet(cls, spark: SparkSession, directory: str) -> Catalog:
        """Tables of a directory; rows repeated whole count once where the table has a key."""
        directory = _current(spark, directory)
        if not exists(spark, f"{directory}/files.parquet"):
            raise NotIndexed(f"no files table in {directory}")
        have = {n: load(spark, directory, n) for n in model.TABLES if n in ("files", "links", "tags", "tasks") or exists(spark, f"{directory}/{n}.parquet")}
        keys = {"files": ["path"], "links": ["id"], "tasks": ["file_path", "line_number"]}
        for n, k in keys.items():
            if all(c in have[n].columns for c in k):
                have[n] = have[n].dropDuplicates(k)
        return cls.from_tables(spark, **have)

    def with_tables(self, **tables: DataFrame) -> Catalog:
        return replace(self, **tables)

    def write(self, directory: str) -> None:
        """Full refresh: the tables are written as a new version, which counts once its marker file is there, so a reader
        finds either all old or all new tables.  The version before stays for readers that have begun; older ones go."""
        spark = self.files.sparkSession
        before = _versions(spark, directory)
        version = f"{directory.rstrip('/')}/{VERSION}{before[-1] + 1 if before else 1:09d}"
        try:
            for n in model.TABLES:
                getattr(self, n).write.mode("overwrite").parquet(f"{version}/{n}.parquet")
            marker, fs = hadoop_path(spark, f"{version}/{COMPLETE}")
            fs.create(marker, True).close()
        except Exception:
            remove(spark, version)  # the old tables stay as they are
            raise
        for v in before[:-1]:
            remove(spark, f"{directory.rstrip('/')}/{VERSION}{v:09d}")

    def last_blocks(self) -> DataFrame:
        """A block id that occurs twice in a note names its last line."""
        return self.blocks.groupBy("file_path", "block_id").agg(
            F.max_by("content", "line_number").alias("content"), F.max("line_number").alias("line_number")
        )
