"""Splitting oversized texts at natural boundaries.

Every text longer than ``max_chars`` code points becomes pieces of at most ``max_chars``; each piece
after the first begins with the last ``overlap`` characters of the piece before it.  Cut positions
come from a dynamic programme over boundary positions: the cost of a cut is the penalty of its
boundary (heading 0, paragraph, line, sentence, word, inside a word) and each piece adds the square
of its deviation from an even share, so the plan is the cheapest over the whole text, not greedy.

Word positions enter only in stretches where sentences leave gaps, and hard positions only where
words do, which keeps the programme linear in the text.

Defined results
* null and empty texts, and texts of at most ``max_chars``, give no piece here (they need no cut);
* a text without any boundary (one run of 100,000 letters) is cut inside the run, never between
  CR and LF and never before a combining mark or low-joining character where that can be avoided;
* the first piece holds at least ``overlap`` + 1 characters;
* rows that repeat a key are split once; which repeat is taken is free, as repeats are equal;
* an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHARS, OVERLAP = 4000, 200
KINDS = ("heading", "paragraph", "line", "sentence", "word", "hard", "end")
PENALTY = np.array([0.0, 0.4, 1.0, 1.6, 4.0, 12.0, 0.0])

_LINE = re.compile(r"\r\n|\n|\r")
_HEAD = re.compile(r"#{1,6}[ \t]")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_SENT = re.compile(r"[.!?…]+[\"'”’)\]]*\s+|[。！？]+[」』）]*\s*")
_WORD = re.compile(r"\s+")


def boundaries(text: str, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (exclusive of 0, inclusive of the end) and kinds of the candidates for a cut.

    Consecutive candidates are less than ``step`` apart.
    """
    n = len(text)
    kind: dict[int, int] = {}

    def put(p: int, k: int) -> None:
        if 0 < p < n and kind.get(p, 9) > k:
            kind[p] = k

    start, fence, blank = 0, "", False
    while start < n:
        m = _LINE.search(text, start)
        stop, nxt = (m.start(), m.end()) if m else (n, n)
        f = _FENCE.match(text, start, stop)
        if fence:
            put(start, 2)
            if f and f[1][0] == fence[0] and len(f[1]) >= len(fence) and not text[f.end() : stop].strip():
                fence = ""
        else:
            put(start, 0 if _HEAD.match(text, start, stop) else 1 if blank else 2)
            fence = f[1] if f else ""
        blank = not text[start:stop].strip()
        start = nxt
    for m in _SENT.finditer(text):
        put(m.end(), 3)

    def gaps(limit: int) -> list[tuple[int, int]]:
        p = [0, *sorted(kind), n]
        return [(a, b) for a, b in zip(p, p[1:]) if b - a > limit]

    for a, b in gaps(step // 8):
        for m in _WORD.finditer(text, a, b):
            put(m.end(), 4)
    hard = max(1, step // 40)
    for a, b in gaps(step // 3):
        for p in range(a + hard, b, hard):
            for q in range(p, max(a, p - 16), -1):  # not before a mark, a joiner or the LF of a CR LF
                if not (unicodedata.combining(text[q]) or text[q] in "‍️" or text[q - 1] == "‍" or text[q - 1 : q + 1] == "\r\n"):
                    p = q
                    break
            put(p, 5)
    pos = np.array([*sorted(kind), n], dtype=np.int64)
    return pos, np.array([kind.get(int(p), 6) for p in pos[:-1]] + [6], dtype=np.int64)


def plan(text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut at the end) of the pieces of ``text``."""
    n, step = len(text), max_chars - overlap
    if n <= max_chars:
        return [(0, n, "end")] if n else []
    pos, kind = boundaries(text, step)
    share = n / np.ceil((n - overlap) / step)
    P = np.concatenate(([0], pos))
    best = np.full(len(P), np.inf)
    best[0] = 0.0
    back = np.zeros(len(P), dtype=np.int64)
    low = np.searchsorted(P, P - step)  # after the first piece a piece brings at most `step` new characters
    cost = np.concatenate(([0.0], PENALTY[kind]))
    for j in range(1, len(P)):
        a = int(low[j])
        c = best[a:j] + ((P[j] - P[a:j]) / share - 1.0) ** 2
        if a == 0:
            c[0] = (P[j] / share - 1.0) ** 2 if overlap < P[j] <= max_chars else np.inf
        elif P[j] <= max_chars:  # the first piece has no overlap to carry
            first = (P[j] / share - 1.0) ** 2
            if first < c.min():
                best[j], back[j] = first + cost[j], 0
                continue
        k = int(np.argmin(c))
        best[j], back[j] = c[k] + cost[j], a + k
    cuts, j = [], len(P) - 1
    while j:
        cuts.append(j)
        j = int(back[j])
    cuts.reverse()
    out, begin = [], 0
    for j in cuts:
        end = int(P[j])
        out.append((begin, end, KINDS[int(kind[j - 1])]))
        begin = end - overlap
    return out


#: Pieces that leave a worker in one frame.
FRAME = 2_000
PIECES = "path string, piece_no int, n_pieces int, start int, stop int, cut_at string, piece string"


def split_oversized(df: DataFrame, key: str = "path", text: str = "content", max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every text longer than ``max_chars``.  The filter runs in the scan's stage; only
    oversized texts are shuffled (to drop repeats) and only they reach Python."""
    if not 0 <= overlap * 2 < max_chars:
        raise ValueError("overlap must be less than half of max_chars")
    big = (
        df.select(F.col(key).alias("path"), F.col(text).alias("text"))
        .filter(F.length("text") > max_chars)
        .dropDuplicates(["path"])
    )

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PIECES.split(", ")]
        for b in batches:
            rows = []
            for path, t in zip(b["path"], b["text"]):
                p = plan(t, max_chars, overlap)
                rows += [(path, i, len(p), a, z, k, t[a:z]) for i, (a, z, k) in enumerate(p, 1)]
                if len(rows) >= FRAME:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return big.mapInPandas(pieces, PIECES)
