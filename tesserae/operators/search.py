"""Full-text search: substring terms, ranked by BM25 over trigram documents.

Without an index everything runs as expressions over one scan.  A :class:`GramIndex` is kept in a folder: postings
with positions, laid out by a hash of the gram and sorted by gram, so a search reads the few row groups of its
grams.  A term occurs where its overlapping trigrams stand in a row; hits, how often each term occurs, document
frequencies and scores all come from postings and lengths.  Contents are read for the page that is shown.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import typed as T
from ..plans.dql.syntax import NotIndexed
from ..runtime import cut, hadoop_path, parallelism, remove

GRAM, SHORTEST = 3, 2
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
INDEX_VERSION, DESCRIPTION = 2, "index.json"
_CJK = re.compile("[㐀-䶿一-鿿]")


def body_of(content: Column) -> Column:
    """The text after a leading frontmatter block."""
    return F.regexp_replace(content, r"\A---[ \t]*\r?\n(?s:.*?\r?\n)??---[ \t]*(?:\r?\n|\z)", "")


def utf16(s: str) -> int:
    return len(s.encode("utf-16-le", "surrogatepass")) // 2


def grams(term: str) -> list[str]:
    """Overlapping trigrams, once each."""
    return list(dict.fromkeys(term[i : i + GRAM] for i in range(len(term) - GRAM + 1)))


@dataclass(frozen=True)
class GramIndex:
    """Postings ``(bucket, gram, f0, f1, at)`` (``at``: where the gram begins in path, name and content, one after the other)
    and ``(f0, f1, path, length)`` below ``directory``, with the number of files, their mean length and of buckets.  f0
    and f1 are two hashes of the path, which stand for it in the postings."""

    spark: SparkSession
    directory: str
    n_files: int
    mean_length: float
    buckets: int

    @classmethod
    def write(cls, files: DataFrame, directory: str, buckets: int | None = None) -> GramIndex:
        """Build the index of ``files`` (path, name, content); it counts once its description is written, at the end."""
        spark, root = files.sparkSession, directory.rstrip("/")
        buckets = buckets or parallelism(spark)
        remove(spark, f"{root}/{DESCRIPTION}")
        known = [F.xxhash64("path").alias("f0"), F.xxhash64("path", F.lit(1)).alias("f1")]
        text = F.lower(F.concat_ws("\u0000", "path", "name", "content")).alias("text")
        postings = files.select(*known, text).mapInArrow(_postings, "f0 bigint, f1 bigint, gram string, at array<int>")
        postings = postings.withColumn("bucket", F.pmod(F.crc32("gram"), F.lit(buckets)).cast("int"))
        laid = postings.repartition("bucket", F.pmod("f0", F.lit(4))).sortWithinPartitions("bucket", "gram")
        laid.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/postings")
        files.select(*known, "path", _length().alias("length")).write.mode("overwrite").parquet(f"{root}/lengths")
        size = spark.read.parquet(f"{root}/lengths").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg")).first()
        out = cls(spark, root, size.n, float(size.avg or 1.0), buckets)
        path, fs = hadoop_path(spark, f"{root}/{DESCRIPTION}")
        stream = fs.create(path, True)
        stream.write(bytearray(json.dumps({"version": INDEX_VERSION, "n_files": out.n_files, "mean_length": out.mean_length, "buckets": buckets}).encode()))
        stream.close()
        return out

    @classmethod
    def open(cls, spark: SparkSession, directory: str) -> GramIndex:
        root = directory.rstrip("/")
        path, fs = hadoop_path(spark, f"{root}/{DESCRIPTION}")
        if not fs.exists(path):
            raise NotIndexed(f"no search index in {directory}")
        stream = fs.open(path)
        try:
            d = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        if d.get("version") != INDEX_VERSION:
            raise NotIndexed("the search index was built by another version; build it again")
        return cls(spark, root, d["n_files"], d["mean_length"], d["buckets"])

    @classmethod
    def ensure(cls, files: DataFrame, directory: str) -> GramIndex:
        """The index in ``directory``; built where there is none or one of another version."""
        try:
            return cls.open(files.sparkSession, directory)
        except NotIndexed:
            return cls.write(files, directory)

    @property
    def lengths(self) -> DataFrame:
        return self.spark.read.schema("f0 bigint, f1 bigint, path string, length int").parquet(f"{self.directory}/lengths")

    def postings(self, wanted: list[str]) -> DataFrame:
        """The postings of some grams: only their buckets and row groups are read."""
        p = self.spark.read.schema("gram string, f0 bigint, f1 bigint, at array<int>, bucket int").parquet(f"{self.directory}/postings")
        of = sorted({zlib.crc32(g.encode("utf-8", "surrogatepass")) % self.buckets for g in wanted})
        return p.filter(F.col("bucket").isin(of) & F.col("gram").isin(wanted))

    def counts(self, term: str) -> DataFrame:
        """``(f0, f1, c)`` of the files that hold the term: how often, overlapping occurrences too."""
        places = [(i, term[i : i + GRAM]) for i in range(len(term) - GRAM + 1)]
        flat = list(dict.fromkeys(g for _, g in places))
        per_file = self.postings(flat).groupBy("f0", "f1").agg(F.map_from_entries(F.collect_list(F.struct("gram", "at"))).alias("m"))  # a row per gram of the term
        per_file = per_file.filter(F.size("m") == len(flat))
        begins = None
        for i, g in places:
            at = _less(F.col("m")[g], i)
            begins = at if begins is None else F.array_intersect(begins, at)
        return per_file.select("f0", "f1", F.size(begins).alias("c")).filter("c > 0")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The grams of each text ``(f0, f1, text)`` with the positions where they begin; what runs over a separator is none."""
    for b in batches:
        for k, t in enumerate(b.column(2).to_pylist()):
            c = np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32)
            if len(c) < GRAM:
                continue
            a = np.lib.stride_tricks.sliding_window_view(c, GRAM)
            at = np.flatnonzero(a.all(axis=1)).astype(np.int32)
            g = (a[at, 0].astype(np.uint64) << np.uint64(42)) | (a[at, 1].astype(np.uint64) << np.uint64(21)) | a[at, 2]
            order = np.argsort(g, kind="stable")
            begin = np.flatnonzero(np.diff(g[order], prepend=np.uint64(0)))  # no gram is 0
            flat = np.ascontiguousarray(a[at[order[begin]]]).tobytes().decode("utf-32-le")
            names = pa.array([flat[i : i + GRAM] for i in range(0, len(flat), GRAM)], pa.string())
            places = pa.ListArray.from_arrays(pa.array(np.append(begin, len(at)).astype(np.int32)), pa.array(at[order]))
            own = [pa.array(np.full(len(begin), b.column(i)[k].as_py(), np.int64)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, names, places], ["f0", "f1", "gram", "at"])


def _less(c: Column, n: int) -> Column:
    return F.transform(c, lambda x: x - n)


def _length() -> Column:
    """Trigrams of a file over its columns."""
    part = lambda c: F.greatest(F.coalesce(F.length(c), F.lit(0)) - F.lit(GRAM - 1), F.lit(0))
    return part("path") + part("name") + part("content")


def _quoted(s: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", s, flags=re.A) if s.isascii() else "".join("\\" + c if c.isascii() and not c.isalnum() and not c.isspace() else c for c in s)


def snippet(terms: list[str]) -> Column:
    """The earliest hit in brackets, 20 characters before and 44 after; the first 64 without one."""
    flat = F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+", " "))
    low = F.lower(flat)
    at = [F.instr(low, F.lit(t.lower())) for t in terms]
    far = F.lit(1 << 30)
    first = F.least(*(F.when(a > 0, a).otherwise(far) for a in at), far)
    hit = F.lit(0)
    for a, t in reversed(list(zip(at, terms))):
        hit = F.when(a == first, F.lit(len(t))).otherwise(hit)
    start = F.greatest(first - 20, F.lit(1))
    stop = F.least(F.length(flat) + 1, first + hit + 44)
    text = F.concat(
        F.when(start > 1, "… ").otherwise(""), F.substr(flat, start, first - start), F.lit("["), F.substr(flat, first, hit), F.lit("]"),
        F.substr(flat, first + hit, stop - first - hit), F.when(stop <= F.length(flat), " …").otherwise(""),
    )
    return F.when(first < far, text).otherwise(F.substr(flat, F.lit(1), F.lit(64)))


def terms_of(text: str) -> list[str]:
    q = text.strip()
    if utf16(q) < SHORTEST:
        raise ValueError(f"search needs at least {SHORTEST} characters")
    return q.split()


def like_search(files: DataFrame, terms: list[str]) -> DataFrame:
    """Files whose content or name holds every term, by path."""
    from ..functions.keys import LOWER, UPPER, ascii_lower

    hit = F.lit(True)
    for t in terms:
        low = t.translate(str.maketrans(UPPER, LOWER))
        hit = hit & (F.coalesce(ascii_lower(F.col("content")).contains(low), F.lit(False)) | F.coalesce(ascii_lower(F.col("name")).contains(low), F.lit(False)))
    return files.filter(hit).select("path", "name", snippet(terms).alias("snippet")).orderBy("path")


def _idf(n_files: int, n: int) -> float:
    return max(LEAST_IDF, math.log((n_files - n + 0.5) / (n + 0.5))) if n_files else LEAST_IDF


def _score(idf: float, c: Column, length: Column, mean: float) -> Column:
    return F.lit(idf) * c * (K1 + 1) / (c + K1 * (1 - B + B * length / F.lit(mean)))


def ranked(files: DataFrame, phrases: list[str], all_of: bool, show: list[str]) -> DataFrame:
    """``path, name, snippet, score``: BM25, best first.  Statistics cover all files; scores only the matching."""
    low = [p.lower() for p in phrases]
    # the folded text is made once per row; the optimizer would else copy it into every condition and count
    text = T.once(F.lower(F.concat_ws("\u0000", "path", "name", "content"))).alias("__text")
    scan = files.select("path", "name", "content", text)
    held = [F.col("__text").contains(p) for p in low]
    counted = scan.agg(*(F.sum(h.cast("bigint")).alias(f"n{i}") for i, h in enumerate(held)), F.count(F.lit(1)).alias("n"), F.avg(_length()).alias("avg")).first()
    hit, score = None, F.lit(0.0)
    for h in held:
        hit = h if hit is None else (hit & h if all_of else hit | h)
    for i, p in enumerate(low):
        c = F.regexp_count("__text", F.lit("(?=" + _quoted(p) + ")"))  # overlapping occurrences
        score = score + _score(_idf(counted.n, counted[f"n{i}"] or 0), c, _length(), float(counted.avg or 1.0))
    out = scan.filter(hit).select("path", "name", snippet(show).alias("snippet"), score.alias("score"))
    return out.orderBy(F.desc("score"), "path")


def indexed_hits(index: GramIndex, phrases: list[str], all_of: bool) -> DataFrame:
    """``(path, score)`` of the matching files, best first, as :func:`ranked` would; no content is read."""
    low = list(dict.fromkeys(p.lower() for p in phrases))
    counted = [index.counts(p) for p in low]
    every = None
    for i, df in enumerate(counted):
        one = df.select("f0", "f1", F.lit(i).alias("term"), "c")
        every = one if every is None else every.unionByName(one)
    every = cut(every, "search-hits")
    found = {r.term: r["count"] for r in every.groupBy("term").count().collect()}  # a row per term
    times = {p.lower(): [q.lower() for q in phrases].count(p.lower()) for p in phrases}
    idf = F.create_map(*(x for i, p in enumerate(low) for x in (F.lit(i), F.lit(_idf(index.n_files, found.get(i, 0)) * times[p]))))
    part = F.col("c") * (K1 + 1) / (F.col("c") + K1 * (1 - B + B * F.col("length") / F.lit(index.mean_length)))
    scored = every.join(index.lengths, ["f0", "f1"]).groupBy("path").agg(F.sum(idf[F.col("term")] * part).alias("score"), F.count(F.lit(1)).alias("held"))
    return (scored.filter(F.col("held") == len(low)) if all_of else scored).select("path", "score").orderBy(F.desc("score"), "path")


def search(files: DataFrame, text: str, index: GramIndex | None = None, with_score: bool = False, most: int | None = None) -> DataFrame:
    """``path, name, snippet`` of the files that match ``text``, or the first ``most`` of them.

    A term under three characters: every term must be in the content or name, by path.  Ideographs: any
    trigram of the terms, by rank.  Otherwise: every term in the path, name or content, by rank.
    """
    terms = terms_of(text)
    if any(utf16(t) < GRAM for t in terms):
        out = like_search(files, terms)
        return out if most is None else out.limit(most)
    any_gram = bool(_CJK.search(text))
    phrases = list(dict.fromkeys(g for t in terms for g in grams(t))) if any_gram else terms
    if index is None:
        out = ranked(files, phrases, not any_gram, terms)
        out = out if most is None else out.limit(most)
    else:
        hits = indexed_hits(index, phrases, not any_gram)
        hits = hits if most is None else F.broadcast(hits.limit(most))  # the page bounds it
        shown = files.select("path", "name", "content").join(hits, "path")
        out = shown.select("path", "name", snippet(terms).alias("snippet"), "score").orderBy(F.desc("score"), "path")
    return out if with_score else out.drop("score")


def count_hits(files: DataFrame, text: str, index: GramIndex | None = None) -> DataFrame:
    """The paths that :func:`search` finds, for counting: from postings alone where there is an index."""
    terms = terms_of(text)
    if index is None or any(utf16(t) < GRAM for t in terms):
        return search(files, text).select("path")
    any_gram = bool(_CJK.search(text))
    return indexed_hits(index, list(dict.fromkeys(g for t in terms for g in grams(t))) if any_gram else terms, not any_gram).select("path")
