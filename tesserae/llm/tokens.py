"""Encoding a corpus with a public byte-level BPE vocabulary by prefix-sharing trie traversal.

A byte-level BPE has this property: the encoding of a prefix of a word ends in one token, and that
token is the only token ``t`` that ends there such that the last token ``l`` of the shorter prefix
(without ``t``) and ``t`` stay apart when their bytes are merged.  So the state of a trie node is one
token, it follows from the states above it, and the encoding of a word is read backwards along its path.

The distinct new words of a batch are put into a trie.  It is walked depth first: the words in byte
order are the trie's leaves from left to right, and a stack holds the states on the path from the
root.  States of a shared prefix are computed once for all words that begin with it.

No shuffle: every task keeps the words it has met, the texts stay where they are.

Defined results
* null and empty texts give an empty list (an encoder option can set other ids for them);
* blank texts are texts: their blanks are encoded;
* strings of special tokens inside a text are ordinary text;
* the result of a text does not depend on the batch, the task or the texts beside it;
* repeated rows give repeated results; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
#: A worker forgets its words beyond so many; they are then computed again.  It bounds memory, not results.
KEEP = 1_000_000
_BLANK_BEFORE_BLANK = re.compile(r"[\s\x1c-\x1f] ").search


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class TrieEncoder:
    """Byte-level BPE over ``vocabulary`` (a file of base64 token and rank) with ``pattern`` as word rule."""

    def __init__(self, vocabulary: str | None = None, pattern: str | None = None, keep: int = KEEP):
        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        with open(vocabulary or vocabulary_path(), "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.words_of = regex.compile(pattern).findall
        self.keep = keep
        self.apart: dict[tuple[int, int], bool] = {}
        self.ids: dict[str, tuple[int, ...]] = {}
        self.inner: dict[str, tuple[int, ...]] = {}
        longest: dict[bytes, int] = {}
        for t in self.ranks:  # the longest token that ends in these two bytes
            if len(t) > 1 and len(t) > longest.get(t[-2:], 1):
                longest[t[-2:]] = len(t)
        self.longest = longest

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of the two tokens gives the two tokens back."""
        known = self.apart.get((left, right))
        if known is None:
            a, b = self.tokens[left], self.tokens[right]
            parts = [bytes([x]) for x in a + b]
            while True:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    r = self.ranks.get(parts[i] + parts[i + 1])
                    if r is not None and (best is None or r < best):
                        best, at = r, i
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            known = self.apart[left, right] = parts == [a, b]
        return known

    def encode_words(self, words: Iterable[str]) -> None:
        """Walk the trie of ``words`` and remember the ids of each."""
        ranks, tokens, longest, apart = self.ranks, self.tokens, self.longest, self._stay_apart
        leaves = sorted((w.encode("utf-8", "replace"), w) for w in words)
        state: list[int] = []  # state[i]: last token of the prefix of i + 1 bytes on the current path
        above = b""
        for data, word in leaves:
            shared, most = 0, min(len(above), len(data))
            while shared < most and above[shared] == data[shared]:
                shared += 1
            del state[shared:]
            for end in range(shared + 1, len(data) + 1):
                for size in range(min(end, longest.get(data[max(0, end - 2) : end], 1)), 0, -1):
                    t = ranks.get(data[end - size : end])
                    if t is not None and (size == end or apart(state[end - size - 1], t)):
                        state.append(t)
                        break
            above = data
            out, end = [], len(data)
            while end:
                t = state[end - 1]
                out.append(t)
                end -= len(tokens[t])
            self.ids[word] = tuple(reversed(out))

    def encode_batch(self, texts: list[str | None], empty: tuple[int, ...] = ()) -> list[list[int]]:
        """Ids of each text; ``empty`` for null and empty texts.

        A text is cut before each single blank that follows a non-blank; no word of the pattern spans such
        a cut.  ``inner`` holds the ids of pieces after a cut (their blank included), ``ids`` those of others.
        """
        ids, inner = self.ids, self.inner
        if len(ids) + len(inner) > self.keep:
            ids.clear()
            inner.clear()
        if len(self.apart) > self.keep:
            self.apart.clear()
        cut: list[list[str]] = []
        for t in texts:
            raw = t.split(" ") if t else []
            if len(raw) > 1 and _BLANK_BEFORE_BLANK(t):  # pieces that meet at a longer run of blanks stay together
                joined = [raw[0]]
                for x in raw[1:]:
                    if joined[-1] and not joined[-1][-1].isspace():
                        joined.append(x)
                    else:
                        joined[-1] += " " + x
                raw = joined
            cut.append(raw)
        outer = {raw[0] for raw in cut if raw}.difference(ids)
        after = set().union(*(raw[1:] for raw in cut)).difference(inner)
        parts = {c: self.words_of(c) for c in outer}
        parts_after = {c: self.words_of(" " + c) for c in after}
        self.encode_words({w for ws in chain(parts.values(), parts_after.values()) for w in ws}.difference(ids))
        for known, new in ((ids, parts), (inner, parts_after)):
            for c, ws in new.items():
                known[c] = tuple(chain.from_iterable(map(ids.__getitem__, ws)))
        get, flat = inner.__getitem__, chain.from_iterable
        return [list(chain(ids[raw[0]], flat(map(get, raw[1:])))) if raw else list(empty) for raw in cut]


_encoders: dict[str, TrieEncoder] = {}


def encoder(vocabulary: str) -> TrieEncoder:
    """One encoder per worker process."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = TrieEncoder(vocabulary)
    return _encoders[vocabulary]


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, empty: tuple[int, ...] = ()) -> DataFrame:
    """``(key, ids array<int>)`` of every row."""
    path = vocabulary or vocabulary_path()
    src = df.select(F.col(key), F.col(text).alias("text"))
    kind = src.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            ids = enc.encode_batch(b.column(1).to_pylist(), empty)
            flat = pa.array(list(chain.from_iterable(ids)), pa.int32())
            ends = [0]
            for x in ids:
                ends.append(ends[-1] + len(x))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["k", "ids"])

    return src.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(key, n_tokens int)`` of every row; the ids themselves do not leave the worker."""
    path = vocabulary or vocabulary_path()
    src = df.select(F.col(key), F.col(text).alias("text"))
    kind = src.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n = [len(x) for x in enc.encode_batch(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], ["k", "n_tokens"])

    return src.mapInArrow(run, f"`{key}` {kind}, n_tokens int")
