"""Abusive, hateful or sexual content: a factorization machine over hashed terms.

Texts are reduced to a normal form in which disguised spellings meet the plain ones (case, digits for
letters, separators, blanks and zero-width characters inside words, stretched letters, markup).  Words and
pairs of neighbouring words are hashed.  Every run of ``SPAN`` words is one instance: a factorization machine
adds the weights of its terms and, through the inner products of their factors, what their pairs say: an
insult together with the mention of a group, or the same word inside a neutral account, which an additive
model cannot tell apart.  A text scores as its worst run does, so a short passage in a long page counts as
much as alone, and every text is scored by the machine; no list of words decides beforehand.

The model is fitted on the driver, in mini-batches, on at most ``MAX_LABELLED`` voted documents (chosen by
hash of the key when there are more).  Each round looks for the worst run of every document under the present
model, so documents voted clean give the runs that are easiest to mistake (quotations, technical use, other
vandalism), then fits on those runs.  Votes can be wrong: how often is estimated from documents with several
votes, and each document's target is its chance of being abusive given its votes and a model fitted on other
pages.  The threshold is the highest with nearly the best expected F1 over all voted documents, each scored by a
model that has not seen its page.  Scoring covers all rows in one pass without a shuffle, over whole texts.

Defined results
* null, empty and blank texts score 0 and are never flagged;
* several votes for a document are averaged; votes for unknown documents and null votes are ignored;
* without any usable positive and negative vote nothing is flagged, every score is 0;
* a repeated document row is scored each time; other columns are ignored; empty tables give empty results;
* a null source is reported as a source of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LABELLED = 50_000
#: Words of an instance.
SPAN = 8
#: A term becomes a feature when it occurs in documents of so many groups (pages).
LEAST_GROUPS = 2
FACTORS, ROUNDS, PASSES, BATCH = 8, 7, 4, 256
L2_WEIGHT, L2_FACTOR, RATE_WEIGHT, RATE_FACTOR = 1e-3, 2e-3, 0.15, 0.1
#: A model of other pages is believed up to this probability, and up to 1 less it.
SURE = 0.005
#: Folds of pages of the cross-fits, and the threshold where they cannot be made.
FOLDS, THRESHOLD, SLACK = 2, 0.5, 0.001
#: No document below this probability is flagged, however few votes the threshold was chosen on.
LEAST_THRESHOLD = 0.1
#: Words looked at together: bounds memory.
BLOCK = 200_000

_GONE = re.compile(r"&nbsp;|&#?\w{1,8};|</?\w{1,10}[^<>\n]{0,60}>|'{2,}|[​-‏⁠﻿­]")
_SPLIT_WORD = re.compile(r"^\W*[^\W_](?:[-._*~+|][^\W_]){2,}\W*$")
_LEET = str.maketrans("013457@$", "oieastas")
_PIECE = re.compile(r"[^\W_]+|[぀-ヿ一-鿿]")
_MASKED = re.compile(r"([^\W\d_])\*{2,}([^\W\d_]?)")
_RUN = re.compile(r"(.)\1+")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ \t]+){2,}[^\W\d_](?![^\W_])")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")


def normal_words(chunk: str) -> list[str]:
    """Normal forms of the words in a run of non-blanks."""
    if chunk == "=":  # X = insult
        return ["="]
    chunk = chunk.lower()
    if _SPLIT_WORD.match(chunk):  # i-d-i-o-t
        chunk = "".join(c for c in chunk if c.isalnum())
    masked = [f"{a}*{z}" for a, z in _MASKED.findall(chunk)]
    if masked:
        return masked
    out = []
    for w in _PIECE.findall(chunk):
        if not w.isdigit():
            w = w.translate(_LEET) if any(c.isdigit() for c in w) else w
        elif len(w) > 2:
            w = "0"  # years and counts are one word
        else:
            w = w.translate(_LEET)
        w = _RUN.sub(r"\1", w)
        if _CJK.search(w):  # no blanks between words: pairs of characters
            out += [w[i : i + 2] for i in range(max(1, len(w) - 1))]
        else:
            out.append(w)
    return out


class _Words(dict):
    def __missing__(self, chunk: str) -> bytes:
        if len(self) > 1_000_000:  # bounds memory; forgotten chunks are hashed again
            self.clear()
        v = self[chunk] = b"".join(xxhash.xxh3_64_digest(w.encode("utf-8", "replace"))[:4] for w in normal_words(chunk))
        return v


_words = _Words()


def word_hashes(text: str | None) -> np.ndarray:
    if not text:
        return np.empty(0, np.uint32)
    if "@" in text or "$" in text:
        text = text.replace("@", "a").replace("$", "s")
    text = _SPACED.sub(lambda m: "".join(m.group().split()), _GONE.sub("", text))  # i d i o t
    return np.frombuffer(b"".join(map(_words.__getitem__, text.split())), np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Texts:
    """Word hashes of many texts, one after the other."""

    words: np.ndarray
    begin: np.ndarray  # of each text, and the end of the last

    @staticmethod
    def of(docs: list[np.ndarray]) -> Texts:
        begin = np.concatenate(([0], np.cumsum([len(d) for d in docs], dtype=np.int64)))
        return Texts(np.concatenate(docs) if docs else np.empty(0, np.uint32), begin)

    def __len__(self) -> int:
        return len(self.begin) - 1

    def blocks(self) -> Iterator[tuple[int, int]]:
        """Ranges of texts that hold about ``BLOCK`` words; a longer text is a block of its own."""
        a = 0
        while a < len(self):
            b = max(a + 1, int(np.searchsorted(self.begin, self.begin[a] + BLOCK, side="right")) - 1)
            yield a, b
            a = b

    def terms(self, a: int, b: int) -> np.ndarray:
        """Two terms at each word of the texts a to b: the word, and its pair with the next word of its text (0 at the end)."""
        w = self.words[self.begin[a] : self.begin[b]].astype(np.uint64)
        out = np.zeros((len(w), 2), np.uint64)
        out[:, 0] = _mix(w) | np.uint64(1)
        if len(w) > 1:
            out[:-1, 1] = _mix((w[:-1] << np.uint64(32)) ^ w[1:] ^ np.uint64(0x165667B1)) & ~np.uint64(1)
        ends = self.begin[a + 1 : b + 1] - self.begin[a] - 1
        out[ends[np.diff(self.begin[a : b + 1]) > 0], 1] = 0
        return out


@dataclass
class Model:
    """Feature k + 1 is the k-th term; row 0 stands for every other term and is all zero."""

    terms: np.ndarray  # sorted
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    threshold: float = THRESHOLD

    def features(self, terms: np.ndarray) -> np.ndarray:
        if not len(self.terms):
            return np.zeros(terms.shape, np.int32)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at + 1, 0).astype(np.int32)

    def known(self) -> np.ndarray:
        """Which low 20 bits of a term some feature has: rules out most terms before the search."""
        mark = np.zeros(1 << 20, bool)
        mark[(self.terms >> np.uint64(8)).astype(np.int64) & 0xFFFFF] = True
        return mark


def _worst(m: Model, f: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of the worst run of each text and where it begins (-1: no words); ``f`` has two features a word."""
    out, at = np.full(len(begin) - 1, -30.0), np.full(len(begin) - 1, -1, np.int64)
    n = len(f)
    if not n:
        return out, at
    square = (m.factor**2).sum(axis=1)
    own = m.weight[f].sum(axis=1) - 0.5 * square[f].sum(axis=1)
    sums = np.zeros((n + 1, FACTORS + 1))
    sums[1:, 0] = own
    sums[1:, 1:] = m.factor[f[:, 0]] + m.factor[f[:, 1]]
    np.cumsum(sums, axis=0, out=sums)
    size = np.diff(begin)
    end = np.minimum(np.arange(n) + SPAN, np.repeat(begin[1:], size))
    run = sums[end] - sums[:n]
    z = m.bias + run[:, 0] + 0.5 * (run[:, 1:] ** 2).sum(axis=1)
    some = np.flatnonzero(size > 0)
    best = np.maximum.reduceat(z, begin[some])
    hit = np.flatnonzero(z == np.repeat(best, size[some]))
    texts, first = np.unique(np.repeat(some, size[some])[hit], return_index=True)
    out[some], at[texts] = best, hit[first]
    return out, at


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Coded:
    """Labelled texts, the texts of a group side by side, with numbered terms; what all fits share."""

    texts: Texts
    group: np.ndarray  # of each text, numbered
    values: np.ndarray  # the terms, sorted
    codes: np.ndarray  # of the two terms at each word
    of_term: np.ndarray  # the different pairs of a term and a text that holds it, sorted
    of_text: np.ndarray

    @staticmethod
    def of(docs: list[np.ndarray], groups: np.ndarray) -> Coded:
        texts = Texts.of(docs)
        terms = np.concatenate([np.empty((0, 2), np.uint64), *(texts.terms(a, b) for a, b in texts.blocks())])
        values, codes = np.unique(terms, return_inverse=True)
        codes = codes.reshape(terms.shape).astype(np.int32)
        n = max(1, len(docs))
        at = np.repeat(np.arange(len(docs)), np.diff(texts.begin))
        pairs = np.unique((codes.astype(np.int64) * n + at[:, None]).ravel())
        return Coded(texts, np.unique(groups, return_inverse=True)[1], values, codes, (pairs // n).astype(np.int32), (pairs % n).astype(np.int32))

    def holding(self, chosen: np.ndarray) -> np.ndarray:
        """How many groups of the ``chosen`` texts (a mask) hold each term."""
        m = chosen[self.of_text]
        t, g = self.of_term[m], self.group[self.of_text[m]]
        new = np.append(True, (np.diff(t) != 0) | (np.diff(g) != 0))[: len(t)]
        return np.bincount(t[new], minlength=len(self.values))


def _train(c: Coded, y: np.ndarray, chosen: np.ndarray, seed: int = 7) -> Model | None:
    """A model of the targets ``y`` of the ``chosen`` texts (a mask): chances, taken as the likelier side and weighed by how
    certain they are, so that a vote which is probably wrong teaches nothing about its page; None where one side is
    missing."""
    likely = y > 0.5
    if not (likely & chosen).any() or not (~likely & chosen).any():
        return None
    # how many groups hold a term, in all and on either side
    pos, neg, both = (c.holding(m) for m in (chosen & likely, chosen & ~likely, chosen))
    keep = (both >= LEAST_GROUPS) & (c.values > 0)
    n_pos, n_neg = len(np.unique(c.group[chosen & likely])), len(np.unique(c.group[chosen & ~likely]))
    place = np.where(keep, np.cumsum(keep), 0).astype(np.int32)
    size = np.where(chosen, np.diff(c.texts.begin), 0)
    f = place[c.codes[np.repeat(chosen, np.diff(c.texts.begin))]]
    texts = Texts(np.empty(0, np.uint32), np.concatenate(([0], np.cumsum(size[chosen], dtype=np.int64))))
    y, certain = y[chosen], np.abs(2 * y[chosen] - 1)
    n = int(keep.sum()) + 1
    share = n_pos / (n_pos + n_neg)
    odds = np.log((pos + 2 * share) / (n_pos + 2)) - np.log((neg + 2 * (1 - share)) / (n_neg + 2))
    start = 0.5 * np.clip(odds, -2, 2) * np.where(pos + neg < 5, 0.5, 1.0)
    rng = np.random.default_rng(seed)
    m = Model(c.values[keep], -4.0, np.concatenate(([0.0], start[keep])), rng.normal(0, 0.03, (n, FACTORS)).astype(np.float32))
    m.factor[0] = 0
    grad_w, grad_v, grad_b = np.full(n, 1e-2), np.full((n, FACTORS), 1e-2), 1e-2
    worst = np.empty(len(texts), np.int64)
    for _ in range(ROUNDS):
        for a, b in texts.blocks():
            lo = texts.begin[a]
            at = _worst(m, f[lo : texts.begin[b]], texts.begin[a : b + 1] - lo)[1]
            worst[a:b] = np.where(at >= 0, at + lo, -1)
        have = np.flatnonzero(worst >= 0)
        where = worst[have, None] + np.arange(SPAN)
        runs = np.zeros((len(texts), SPAN, 2), np.int32)
        runs[have] = np.where((where < texts.begin[have + 1, None])[..., None], f[np.minimum(where, len(f) - 1)], 0)
        runs = runs.reshape(len(texts), -1)
        for _ in range(PASSES):
            order = rng.permutation(len(texts))
            for k in range(0, len(order), BATCH):
                rows = order[k : k + BATCH]
                r = runs[rows]
                v = m.factor[r]
                s = v.sum(axis=1)
                z = m.bias + m.weight[r].sum(axis=1) + 0.5 * ((s**2).sum(axis=1) - (v**2).sum(axis=(1, 2)))
                e = (_sigmoid(z) - (y[rows] > 0.5)) * certain[rows]
                used, back = np.unique(r, return_inverse=True)
                back = back.ravel()
                times = np.bincount(back, minlength=len(used))
                dw = np.bincount(back, np.repeat(e, r.shape[1]), len(used)) + L2_WEIGHT * m.weight[used] * times
                each = (e[:, None, None] * (s[:, None, :] - v)).reshape(-1, FACTORS)
                dv = np.stack([np.bincount(back, each[:, j], len(used)) for j in range(FACTORS)], axis=1)
                dv += L2_FACTOR * m.factor[used] * times[:, None]
                grad_w[used] += dw**2
                grad_v[used] += dv**2
                grad_b += e.sum() ** 2
                m.weight[used] -= RATE_WEIGHT * dw / np.sqrt(grad_w[used])
                m.factor[used] -= RATE_FACTOR * dv / np.sqrt(grad_v[used])
                m.bias -= RATE_FACTOR * e.sum() / np.sqrt(grad_b)
                m.weight[0], m.factor[0] = 0, 0
    return m


def _log_odds(m: Model, docs: list[np.ndarray]) -> np.ndarray:
    texts, out, known = Texts.of(docs), np.empty(len(docs)), m.known()
    for a, b in texts.blocks():
        t = texts.terms(a, b)
        f = np.zeros(t.shape, np.int32)
        maybe = known[(t >> np.uint64(8)).astype(np.int64) & 0xFFFFF]
        f[maybe] = m.features(t[maybe])
        out[a:b] = _worst(m, f, texts.begin[a : b + 1] - texts.begin[a])[0]
    return out


def _cross(c: Coded, docs: list[np.ndarray], y: np.ndarray, groups: np.ndarray) -> np.ndarray | None:
    """Probability of each document by a model of other groups; None where a fold cannot be fitted."""
    fold = np.array([xxhash.xxh3_64_intdigest(str(g)) % FOLDS for g in groups])
    out = np.empty(len(docs))
    for k in range(FOLDS):
        m = _train(c, y, fold != k)
        if m is None:
            return None
        mine = np.flatnonzero(fold == k)
        out[mine] = _sigmoid(_log_odds(m, [docs[i] for i in mine]))
    return out


def wrong_votes(y: np.ndarray, n: np.ndarray) -> float:
    """Share of wrong votes, from how often two votes for one document differ: 2 e (1 - e)."""
    pairs = (n * (n - 1) / 2).sum()
    apart = (y * n * (n - y * n)).sum() / pairs if pairs else 0.1
    return float(np.clip((1 - np.sqrt(max(0.0, 1 - 2 * apart))) / 2, 0.01, 0.2))


def _believed(p: np.ndarray, y: np.ndarray, n: np.ndarray, wrong: float) -> np.ndarray:
    """Chance of each document given a model's probability and its votes."""
    p = np.clip(p, SURE, 1 - SURE)
    return _sigmoid(np.log(p / (1 - p)) + (2 * y - 1) * n * np.log((1 - wrong) / wrong))


def best_threshold(p: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(threshold, expected F1): the highest with an F1 at most ``SLACK`` below the best, as votes are sought where
    abuse is likely and the corpus holds more clean documents than the voted ones do."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    last = np.append(p[order][1:] < p[order][:-1], True)  # equal scores are flagged together
    k = int(np.argmax(last & (f1 >= f1[last].max() - SLACK)))
    low = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float((p[order][k] + low) / 2), float(f1[k])


def fit(docs: list[np.ndarray], y: np.ndarray, groups: np.ndarray, votes: np.ndarray | None = None) -> Model:
    """Fit on word hashes, the mean vote of each document, its group and its number of votes (1 if not given)."""
    y, groups = np.asarray(y, float), np.asarray(groups)
    n = np.ones(len(y)) if votes is None else np.asarray(votes, float)
    none = Model(np.empty(0, np.uint64), -30.0, np.zeros(1), np.zeros((1, FACTORS)))
    if not len(y) or not (y > 0.5).any() or not (y <= 0.5).any():
        return none
    order = np.argsort(groups, kind="stable")
    docs, y, groups, n = [docs[i] for i in order], y[order], groups[order], n[order]
    coded = Coded.of(docs, groups)
    target, threshold = y, THRESHOLD
    p = _cross(coded, docs, y, groups)
    if p is not None:
        e = wrong_votes(y, n)
        target = _believed(p, y, n, e)
        p = _cross(coded, docs, target, groups)
        if p is not None:
            target = _believed(p, y, n, e)
            threshold = max(LEAST_THRESHOLD, best_threshold(p, target)[0])
    m = _train(coded, target, np.ones(len(docs), bool))
    if m is None:
        return none
    used = (np.abs(m.weight[1:]) > 0.01) | (np.abs(m.factor[1:]).max(axis=1) > 0.15)
    row = np.concatenate(([True], used))
    return Model(m.terms[used], m.bias, m.weight[row], m.factor[row].astype(np.float32), threshold)


def score_words(m: Model, docs: list[np.ndarray]) -> np.ndarray:
    """Probability of each text; 0 for a text without words or by a model without features."""
    if not len(m.terms):
        return np.zeros(len(docs))
    p = _sigmoid(_log_odds(m, docs))
    p[[not len(d) for d in docs]] = 0.0
    return p


def labelled_words(documents: DataFrame, votes: DataFrame, key: str = "doc_id", text: str = "text", vote: str = "abusive", group: str = "page_id", most: int = MAX_LABELLED):
    """(word hashes, mean votes, groups, numbers of votes) of the voted documents, brought to the driver: at most ``most``."""
    mean = votes.filter(F.col(vote).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.avg(vote).alias("y"), F.count(vote).alias("n"))
    mean = mean.orderBy(F.xxhash64("k"), "k").limit(most)
    d = documents.select(F.col(key).alias("k"), F.col(group).alias("g"), F.col(text).alias("t"))
    joined = d.join(F.broadcast(mean), "k").select("k", "g", "y", "n", "t")  # `most` bounds the broadcast

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "g": b["g"], "y": b["y"], "n": b["n"], "w": [word_hashes(t).tobytes() for t in b["t"]]})

    got = joined.mapInPandas(run, "k bigint, g bigint, y double, n bigint, w binary").toPandas().drop_duplicates("k").sort_values("k")
    return [np.frombuffer(w, np.uint32) for w in got["w"]], got["y"].to_numpy(), got["g"].fillna(-1).to_numpy(), got["n"].to_numpy()


def score(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("source",)) -> DataFrame:
    """``(key, *keep, score, flagged)`` of every row."""
    src = documents.select(key, *keep, F.col(text).alias("__text"))
    kinds = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in (key, *keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = score_words(model, [word_hashes(t) for t in b.column(b.num_columns - 1).to_pylist()])
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(p, pa.float64()), pa.array(p >= model.threshold)], [key, *keep, "score", "flagged"]
            )

    return src.mapInArrow(run, f"{kinds}, score double, flagged boolean")


def rates(scored: DataFrame, source: str = "source") -> DataFrame:
    """Documents, flagged documents and their share per source."""
    return scored.groupBy(source).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.col("flagged").cast("bigint")).alias("n_flagged"),
        F.avg(F.col("flagged").cast("double")).alias("rate"),
        F.avg("score").alias("mean_score"),
    )
