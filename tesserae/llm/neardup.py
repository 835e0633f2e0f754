"""Near-duplicate texts by a chosen-path join.

Texts are sets of word shingles, embedded into minhash coordinates.  A node of the join is a set of texts that share
the tokens on the path from the root.  The root is split on ``repeats`` samples of ``depth`` coordinates; a node with
more than ``SMALL`` texts is split again on ``splits`` sampled coordinates: a text goes to one child per sample, named
by its tokens there, so two texts with similarity s meet again with probability s per coordinate.  Small nodes are
compared by brute force on 4-bit sketches, which leaves few false pairs; the survivors are checked exactly on their
shingle sets.  The repetitions follow from the threshold and the target recall (:func:`plan`): however deep the nodes
go, a pair at the threshold meets with at least that probability, and a more similar one with a higher.

A node is read as a stream of sorted rows: a task holds at most ``SMALL`` texts of it and passes the rows of a larger
node on to the next level.  The hottest nodes, told from a sample of texts, are passed on before the shuffle, so no
task receives them; where a node is split changes nothing about the pairs that are checked.  A node that is still
large after ``LEVELS`` levels holds texts that agree on every coordinate sampled on the way, so nearly all of its pairs
are links; it is compared block against block, each block pair a row set of bounded size.

Texts with the same set of shingles form a class.  Only one text per class takes part in the join,
so a third of all rows being copies of each other costs one row.

Defined results
* null texts and texts of fewer than ``min_words`` words are no cases; empty ones neither;
* the leading frontmatter block (``---`` lines included) is not part of the text; one that is never
  closed is text;
* rows that repeat a key count once; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, discard

#: Chance that a pair at the threshold is found, and that it survives one split of a node.
RECALL, SURVIVAL = 0.998, 0.9
#: Largest node that is compared by brute force.
SMALL = 256
LEVELS = 12
#: Rows or texts sent to the other side up to this many (some 20 MB); beyond, both are shuffled.
BROADCAST_KEYS = 200_000
#: One text in so many is looked at to find hot nodes; a node with so many of them is hot, and at most so many are.
SAMPLE, HOT, HOTTEST = 64, 64, 100_000
_SEED = 0x7E55E7AE
_MOST = 512
_RNG = np.random.default_rng(_SEED)
_MUL = _RNG.integers(1, 1 << 63, _MOST, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(1, 1 << 63, _MOST, dtype=np.uint64)
_K1, _K2, _K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_FRONT = re.compile(r"---[ \t]*\r?\n(?:.*?\r?\n)??---[ \t]*(?:\r?\n|\Z)", re.S)
_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Plan:
    """How the join splits for a threshold.  ``whole`` coordinates are kept whole, ``slots`` as four bits."""

    threshold: float
    depth: int
    repeats: int
    splits: int
    whole: int
    slots: int

    @property
    def row(self) -> str:
        return "node bigint, id bigint, " + ", ".join(f"s{k} bigint" for k in range(self.slots // 16))


def plan(threshold: float, recall: float = RECALL) -> Plan:
    """The fewest repetitions with the target recall at the threshold.  A split of a node samples so many coordinates
    that a pair survives it, and all splits below it, with ``SURVIVAL``; the root counts on no more than that."""
    if not 0 < threshold <= 1 or not 0 < recall < 1:
        raise ValueError("threshold is in (0, 1], recall in (0, 1)")

    def times(chance: float, target: float) -> int:
        return 1 if chance >= 1 else math.ceil(math.log(1 - target) / math.log(1 - chance))

    depth = 2 if times(threshold**2 * SURVIVAL, recall) <= 16 else 1
    repeats, splits = times(threshold**depth * SURVIVAL, recall), times(threshold * SURVIVAL, SURVIVAL)
    whole = max(32, repeats * depth, splits)
    slots = max(64, -(-whole // 16) * 16)
    if slots > _MOST:
        raise ValueError(f"a threshold of {threshold} needs more than {_MOST} coordinates")
    return Plan(threshold, depth, repeats, splits, whole, slots)


def expected_recall(p: Plan, similarity: float, levels: int = 1) -> float:
    """Chance that two texts of this similarity meet in a node that is compared, if the nodes of the first
    ``levels`` - 1 levels are all large and so are split."""
    met = 1.0
    for _ in range(levels - 1):
        met = 1 - (1 - similarity * met) ** p.splits
    return 1 - (1 - similarity**p.depth * met) ** p.repeats


def body(text: str) -> str:
    """The text after a leading frontmatter block."""
    if text.startswith("---"):
        m = _FRONT.match(text)
        if m:
            return text[m.end() :]
    return text


class _Words(dict):
    """Blank-separated chunk -> concatenated 8-byte hashes of its words."""

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > 1_000_000:  # bounds memory; forgotten chunks are hashed again
            self.clear()
        v = self[chunk] = b"".join(xxhash.xxh3_64_digest(w.encode("utf-8", "replace")) for w in _WORD.findall(chunk.lower()))
        return v


_words = _Words()


def shingles(text: str | None, width: int = 3, min_words: int = 20) -> np.ndarray | None:
    """Sorted hashes of the different runs of ``width`` words; None for a text that is no case."""
    if not text:
        return None
    w = np.frombuffer(b"".join(map(_words.__getitem__, body(text).split())), np.uint64)
    if len(w) < max(min_words, width):
        return None
    n = len(w) - width + 1
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = (h ^ w[k : k + n]) * _K1
        h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(s: np.ndarray, slots: int) -> np.ndarray:
    """Minhash coordinates of a shingle set."""
    out = np.full(slots, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(s), 2048):
        h = s[a : a + 2048, None] * _MUL[:slots] + _ADD[:slots]
        h ^= h >> np.uint64(32)
        h *= _K2
        out = np.minimum(out, (h >> np.uint64(32)).min(axis=0).astype(np.uint32))
    return out


def _packed(sig: np.ndarray, whole: int) -> bytes:
    """The whole coordinates, then four bits of each."""
    low = (sig & np.uint32(15)).astype(np.uint8)
    return sig[:whole].tobytes() + (low[0::2] << 4 | low[1::2]).tobytes()


_EQUAL = np.array([(x >> 4 == 0) + (x & 15 == 0) for x in range(256)], np.uint8)  # equal halves of two bytes, by their xor


def signed_texts(df: DataFrame, key: str, text: str, p: Plan, width: int, min_words: int) -> DataFrame:
    """``(key, c0, c1, sig)`` of the texts that are cases; c0 and c1 are a 128-bit hash of the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, cls, sig = [], [], []
            for k, t in zip(b.column(0), b.column(1)):
                s = shingles(t.as_py(), width, min_words)
                if s is not None:
                    keys.append(k.as_py())
                    cls.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sig.append(_packed(signature(s, p.slots), p.whole))
            c = np.frombuffer(b"".join(cls), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(c[:, 0].copy()), pa.array(c[:, 1].copy()), pa.array(sig, pa.binary())], ["key", "c0", "c1", "sig"]
            )

    src = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).filter("key IS NOT NULL AND text IS NOT NULL")
    return src.mapInArrow(run, "key string, c0 bigint, c1 bigint, sig binary")


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(30)
    h *= _K2
    return h ^ (h >> np.uint64(27))


def _roots(p: Plan, whole: np.ndarray) -> np.ndarray:
    """Nodes of each text below the root: one per repetition, on coordinates of its own."""
    out = np.empty((len(whole), p.repeats), np.uint64)
    for j in range(p.repeats):
        h = np.full(len(whole), (np.uint64(j + 1) * _K3), np.uint64)
        for k in range(p.depth):
            h = _mixed((h ^ whole[:, j * p.depth + k].astype(np.uint64)) * _K1)
        out[:, j] = h
    return out


def _children(p: Plan, whole: np.ndarray, nodes: np.ndarray, level: int) -> np.ndarray:
    """Child node of each text on each of the coordinates that its node samples."""
    out = np.empty((len(whole), p.splits), np.uint64)
    base = nodes ^ (np.uint64(level + 1) * _K3)
    order = (base[:, None] * _MUL[None, : p.whole]) ^ _ADD[None, : p.whole]  # ranks the coordinates, per node
    order ^= order >> np.uint64(31)
    order *= _K2
    slots = np.argpartition(order, p.splits - 1, axis=1)[:, : p.splits]
    slots.sort(axis=1)
    for j in range(p.splits):
        at = slots[:, j]
        out[:, j] = _mixed((whole[np.arange(len(whole)), at].astype(np.uint64) * _K1 + at.astype(np.uint64)) ^ base)
    return out


def _split(rows: DataFrame, p: Plan, level: int) -> DataFrame:
    """The children (columns ``p.row``) of rows ``(node, id, sig)``."""
    names = [x.split()[0] for x in p.row.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(n, p.whole * 4 + p.slots // 2)
            whole = sig[:, : p.whole * 4].copy().view(np.uint32)
            kids = _children(p, whole, np.asarray(b.column(0)).astype(np.int64).view(np.uint64), level) if level else _roots(p, whole)
            rest = [np.asarray(b.column(1)), *sig[:, p.whole * 4 :].copy().view(np.int64).T]
            times = kids.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(kids.ravel().view(np.int64)), *(pa.array(np.repeat(x, times)) for x in rest)], names)

    return rows.select("node", "id", "sig").mapInArrow(run, p.row)


def _agreeing(p: Plan) -> int:
    """Coordinates that must agree: four standard deviations below what the threshold lets expect."""
    q = p.threshold + (1 - p.threshold) / 16
    return int(p.slots * q - 4 * (p.slots * q * (1 - q)) ** 0.5)


def _similar(ids: np.ndarray, low: np.ndarray, begin: np.ndarray, size: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ids, smaller first, within each run of rows, whose sketches agree on ``least`` coordinates."""
    for m in np.unique(size[size > 1]):
        i, j = np.triu_indices(m, 1)
        at = begin[size == m]
        for part in np.array_split(at, max(1, len(at) * len(i) // 300_000)):
            x, y = (part[:, None] + i).ravel(), (part[:, None] + j).ravel()
            ok = _EQUAL[low[x] ^ low[y]].sum(axis=1, dtype=np.int32) >= least
            a, b = ids[x[ok]], ids[y[ok]]
            if len(a):
                yield np.minimum(a, b), np.maximum(a, b)


LEVEL = "a bigint, b bigint, node bigint"  # a pair, or (b null) text a in a node that is passed on


def _by_node(rows: DataFrame, p: Plan, small: int) -> DataFrame:
    """``LEVEL`` rows of the nodes: pairs of nodes of at most ``small`` texts, the rows of larger ones."""
    least, n_words = _agreeing(p), p.slots // 16
    sorted_rows = rows.repartition("node").sortWithinPartitions("node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the node that the batches so far end with
        over = None  # a node already known to be large

        def out(a, b=None, node=None):
            none = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(a), none if b is None else pa.array(b), none if node is None else pa.array(node)], ["a", "b", "node"])

        def compare(m: np.ndarray, begin: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
            low = np.ascontiguousarray(m[:, 2:]).view(np.uint8)
            for a, b in _similar(m[:, 1], low, begin, size, least):
                yield out(a, b)

        for batch in batches:
            if not batch.num_rows:
                continue
            m = np.stack([np.asarray(batch.column(k)) for k in range(2 + n_words)], axis=1)
            if held:
                m = np.concatenate((*held, m))
                held = []
            if over is not None:
                n = int(np.searchsorted(m[:, 0] != over, True))
                if n:
                    yield out(m[:n, 1].copy(), node=m[:n, 0].copy())
                m = m[n:]
                if not len(m):
                    continue
                over = None
            begin = np.concatenate(([0], np.flatnonzero(np.diff(m[:, 0])) + 1))
            size = np.diff(np.append(begin, len(m)))
            if size[-1] <= small:  # its node may go on
                held = [m[begin[-1] :]]
            else:
                over = m[begin[-1], 0]
                yield out(m[begin[-1] :, 1].copy(), node=m[begin[-1] :, 0].copy())
            begin, size = begin[:-1], size[:-1]
            big = np.repeat(size > small, size)
            if big.any():
                yield out(m[: len(big)][big, 1].copy(), node=m[: len(big)][big, 0].copy())
            yield from compare(m, begin[size <= small], size[size <= small])
        if held:
            yield from compare(held[0], np.zeros(1, np.int64), np.array([len(held[0])]))

    return sorted_rows.mapInArrow(run, LEVEL)


def _blocks(rows: DataFrame, p: Plan) -> DataFrame:
    """Pairs of nodes of any size: every block of about ``SMALL / 2`` texts against every other."""
    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"))
    blocks = rows.join(sizes, "node").withColumn("of", F.ceil(F.col("size") * 2 / F.lit(SMALL)).cast("int"))
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("id"), F.col("of")).cast("int"))
    cells = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    cells = cells.withColumn("node", F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")))
    return _by_node(cells.select(*rows.columns), p, 1 << 30)  # a cell is two blocks


def _hot_nodes(classes: DataFrame, todo: DataFrame, p: Plan, level: int) -> DataFrame | None:
    """Nodes of this level that hold thousands of texts, by a sample of the texts; ``HOTTEST`` at most."""
    part = todo.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0)
    counts = _split(part, p, level).groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HOT)
    hot = counts.orderBy(F.desc("n"), "node").limit(HOTTEST).select("node").collect()
    return classes.sparkSession.createDataFrame([(r.node,) for r in hot], "node bigint") if hot else None


def candidates(classes: DataFrame, p: Plan) -> DataFrame:
    """Different pairs ``(a, b)`` of ids, a < b, that probably reach the threshold; ``classes`` is ``(id, sig)``.

    Each level is one job: its rows are shuffled by node once, small nodes are compared, and what the large ones hold
    is written for the next level.
    """
    todo = classes.select(F.lit(0).cast("bigint").alias("node"), "id", "sig")
    found, made = None, []
    for level in range(LEVELS + 1):
        rows, last = _split(todo, p, level), level == LEVELS
        hot = None if last else _hot_nodes(classes, todo, p, level)
        if last:
            out = _blocks(cut(rows, "neardup-blocks"), p)
        elif hot is None:
            out = _by_node(rows, p, SMALL)
        else:
            marked = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "node", "left")  # HOTTEST bounds it
            marked = cut(marked, f"neardup-marked{level}")
            made.append(marked)
            passed = marked.filter("hot").select(F.col("id").alias("a"), F.lit(None).cast("bigint").alias("b"), "node")
            out = _by_node(marked.filter("hot IS NULL").drop("hot").select(*rows.columns), p, SMALL).unionByName(passed)
        out = cut(out, f"neardup-level{level}")
        made.append(out)
        pairs = out.filter("b IS NOT NULL").select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        rest = out.filter("b IS NULL").select("node", F.col("a").alias("id"))
        n = rest.count()
        if not n:
            break
        todo = (F.broadcast(rest) if n <= BROADCAST_KEYS else rest).join(classes, "id")
    result = cut(found.distinct(), "neardup-candidates")
    discard(*made)
    return result


def class_links(df: DataFrame, reps: DataFrame, key: str, text: str, p: Plan, width: int, min_words: int) -> DataFrame:
    """Links ``(a, b, similarity)`` between classes, exact; ``reps`` is ``(id, key, sig)``, a text for each class."""
    cand = candidates(reps.select("id", "sig"), p)
    wanted = cand.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    keys = cut(reps.select("id", "key").join(wanted, "id", "left_semi"), "neardup-keys")
    few = keys.count() <= BROADCAST_KEYS
    texts = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).join(F.broadcast(keys) if few else keys, "key").select("id", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [shingles(t.as_py(), width, min_words).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.binary())], ["id", "s"])

    shingled = cut(texts.mapInArrow(sets, "id bigint, s binary").dropDuplicates(["id"]), "neardup-sets")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sim = []
            for x, y in zip(b.column(2), b.column(3)):
                q, r = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                n = len(np.intersect1d(q, r, assume_unique=True))
                sim.append(n / (len(q) + len(r) - n))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sim, pa.float64())], ["a", "b", "similarity"])

    pairs = (
        cand.join(shingled.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
        .join(shingled.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
        .select("a", "b", "sa", "sb")
    )
    links = cut(pairs.mapInArrow(exact, "a bigint, b bigint, similarity double").filter(F.col("similarity") >= p.threshold), "neardup-links")
    discard(cand, keys, shingled)
    return links


def similar_pairs(df: DataFrame, key: str = "path", text: str = "content", threshold: float = 0.7, width: int = 3, min_words: int = 20, recall: float = RECALL) -> DataFrame:
    """All pairs ``(key_a, key_b, similarity)`` of different keys, key_a < key_b.  Copies are expanded into pairs, so the
    output grows with the square of a class: :func:`groups` is the form for use at scale."""
    members, links = classes_and_links(df, key, text, threshold, width, min_words, recall)
    a = members.select(F.col("id").alias("a"), F.col("key").alias("x"))
    b = members.select(F.col("id").alias("b"), F.col("key").alias("y"))
    # members of one class are equal sets; those of linked classes inherit the similarity of the link
    same = a.join(b, (F.col("a") == F.col("b")) & (F.col("x") < F.col("y")))
    other = links.join(a, "a").join(b, "b")
    pairs = same.select("x", "y", F.lit(1.0).alias("similarity")).unionByName(other.select("x", "y", "similarity"))
    return pairs.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"), "similarity")


def classes_and_links(df: DataFrame, key: str = "path", text: str = "content", threshold: float = 0.7, width: int = 3, min_words: int = 20, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """Membership ``(id, key)`` of every case, and exact links ``(a, b, similarity)`` between different classes."""
    p = plan(threshold, recall)
    signed = cut(signed_texts(df, key, text, p, width, min_words), "neardup-signed")
    first = F.min(F.struct("key", "sig")).alias("r")
    reps = signed.groupBy("c0", "c1").agg(first).select("c0", "c1", F.col("r.key").alias("key"), F.col("r.sig").alias("sig"))
    reps = cut(reps.withColumn("id", F.monotonically_increasing_id()), "neardup-classes")  # fixed once written
    links = class_links(df, reps.select("id", "key", "sig"), key, text, p, width, min_words)
    members = cut(signed.select("c0", "c1", "key").distinct().join(reps.select("c0", "c1", "id"), ["c0", "c1"]).select("id", "key"), "neardup-members")
    discard(signed, reps)
    return members, links


def groups(df: DataFrame, key: str = "path", text: str = "content", threshold: float = 0.7, width: int = 3, min_words: int = 20, recall: float = RECALL) -> DataFrame:
    """``(key, group_key, n_links)`` of every case: the smallest key of its connected group and its links to
    different texts.  A text without links forms its own group with its exact copies."""
    members, links = classes_and_links(df, key, text, threshold, width, min_words, recall)
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("n_links"))
    label = components(both)
    with_root = members.join(label, members.id == label.a, "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    name = with_root.groupBy("root").agg(F.min("key").alias("group_key"))
    return (
        with_root.join(name, "root")
        .join(degree, F.col("id") == F.col("a"), "left")
        .select("key", "group_key", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))
    )


def components(both: DataFrame) -> DataFrame:
    """``(a, root)``: connected components of a symmetric edge list by alternating large and small stars."""
    edges = cut(both.filter("a <> b").distinct(), "components-0")
    step = 0
    while True:
        step += 1
        # large star: every larger neighbour is linked to the smallest of the neighbourhood
        sym = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        low = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = sym.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: every smaller neighbour, and the node, is linked to the smallest
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
        best = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(best, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        nxt = cut(small.unionByName(best.select("a", F.col("m").alias("b"))).distinct(), f"components-{step}")
        changed = nxt.exceptAll(edges).limit(1).count() + edges.exceptAll(nxt).limit(1).count()
        discard(edges)
        edges = nxt
        if not changed:
            break
    roots = edges.select(F.col("b").alias("root")).distinct()
    return edges.select("a", F.col("b").alias("root")).unionByName(roots.select(F.col("root").alias("a"), "root"))
