"""Token ids of a byte-level BPE vocabulary.

A text is cut into words by the vocabulary's pattern. A word's merges run over a
segment tree of the ranks of its adjacent pairs: the root holds the leftmost pair
of the lowest rank, and each merge is three point updates, so a word of n bytes
takes O(n log n). Words are first cut, exactly, at places that no token of the
vocabulary can span, and the ids of the resulting parts are kept in bounded
caches of the worker; so scripts without spaces don't make every word a new one.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from leafmill.functions.columns import keyed

TOKENIZERS = "/opt/tokenizers"

# The pattern of the vocabulary's authors.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The code points of the property White_Space.
SPACES = "\t-\r \x85\xa0  -     　"

_EXACT = regex.compile(PATTERN.replace(r"[^\s", f"[^{SPACES}").replace(r"(?!\S)", f"(?![^{SPACES}])").replace(r"\s+", f"[{SPACES}]+"))
#: The same pattern for texts without numerals that `\d` leaves out; several times as fast.
_FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w{SPACES}]+|_+)+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
_ODD = re.compile("[" + "".join(re.escape(c) for c in map(chr, range(0x10000)) if unicodedata.category(c) in ("Nl", "No")) + "\U00010000-\U0010ffff]")

CACHED_WORDS = 200_000
NO_PAIR = sys.maxsize


def words_of(text: str) -> list[str]:
    return (_EXACT if _ODD.search(text) else _FAST).findall(text)


class PairTree:
    """Minimum of (rank, place) over the adjacent pairs of a word's symbols."""

    def __init__(self, values: list[int]) -> None:
        self.size = 1 << max(0, len(values) - 1).bit_length()
        tree = [NO_PAIR] * self.size + values + [NO_PAIR] * (self.size - len(values))
        for i in range(self.size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        self.tree = tree

    def root(self) -> int:
        return self.tree[1] if self.size > 1 else self.tree[-1]

    def put(self, at: int, value: int) -> None:
        tree, i = self.tree, at + self.size
        tree[i] = value
        while i > 1:
            a, b = tree[i], tree[i ^ 1]
            i >>= 1
            least = a if a < b else b
            if tree[i] == least:
                break
            tree[i] = least


class BytePairEncoder:
    """Ids by a table of ranks (token bytes to id; the id of a merge's result is its rank)."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.words: dict[str, bytes] = {}
        self.parts: dict[bytes, bytes] = {}
        self.joins: dict[str, bool] = {}
        # Each place inside a token, as what is left and right of it: the token's own begin or
        # end, or (True) a whole character beyond which the token goes on.
        spans = set()
        for token in ranks:
            for j in range(1, len(token)):
                if token[j - 1] < 0x80 and token[j] < 0x80:
                    continue
                lefts = [(token[:j], False)] * (j <= 4) + [(token[j - k : j], True) for k in range(1, min(j, 5))]
                rights = [(token[j:], False)] * (len(token) - j <= 4) + [(token[j : j + k], True) for k in range(1, min(len(token) - j, 5))]
                spans.update((*a, *b) for a in lefts for b in rights)
        self.spans = spans

    def joined(self, pair: str) -> bool:
        """Whether a token could hold bytes of both characters of `pair`."""
        known = self.joins.get(pair)
        if known is None:
            a, b = pair[0].encode("utf-8", "replace"), pair[1].encode("utf-8", "replace")
            if len(a) == 1 and len(b) == 1:
                known = True
            else:
                lefts = [(a[-k:], False) for k in range(1, len(a) + 1)] + [(a, True)]
                rights = [(b[:k], False) for k in range(1, len(b) + 1)] + [(b, True)]
                known = any((*x, *y) in self.spans for x in lefts for y in rights)
            if len(self.joins) >= CACHED_WORDS:
                self.joins.clear()
            self.joins[pair] = known
        return known

    def merge(self, part: bytes) -> list[int]:
        """Ids of one part by merges of the leftmost lowest-ranked pair."""
        ranks = self.ranks
        whole = ranks.get(part)
        if whole is not None:
            return [whole]
        n = len(part)
        ends = list(range(1, n + 1))  # symbol i is part[i:ends[i]]
        before = list(range(-1, n - 1))

        def value(i: int) -> int:
            j = ends[i]
            if j >= n:
                return NO_PAIR
            rank = ranks.get(part[i : ends[j]])
            return NO_PAIR if rank is None else rank * n + i

        tree = PairTree([value(i) for i in range(n - 1)])
        while (best := tree.root()) != NO_PAIR:
            i = best % n
            j = ends[i]
            ends[i] = ends[j]
            if ends[i] < n:
                before[ends[i]] = i
            if j < n - 1:
                tree.put(j, NO_PAIR)
            if i < n - 1:
                tree.put(i, value(i))
            if before[i] >= 0:
                tree.put(before[i], value(before[i]))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[part[i : ends[i]]])
            i = ends[i]
        return ids

    def part_ids(self, part: str) -> bytes:
        raw = part.encode("utf-8", "replace")
        ids = self.parts.get(raw)
        if ids is None:
            ids = np.array(self.merge(raw), "<i4").tobytes()
            if len(raw) <= 64:
                if len(self.parts) >= CACHED_WORDS:
                    self.parts.clear()
                self.parts[raw] = ids
        return ids

    def word_ids(self, word: str) -> bytes:
        """Packed ids of a word."""
        if len(word) < 3 or word.isascii():
            return self.part_ids(word)
        joins, out, start = self.joins, [], 0
        for i in range(1, len(word)):
            pair = word[i - 1 : i + 1]
            known = joins.get(pair)
            if not (self.joined(pair) if known is None else known):
                out.append(self.part_ids(word[start:i]))
                start = i
        out.append(self.part_ids(word[start:]))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Packed ids (little-endian int32) of `text`."""
        words, out = self.words, []
        for word in words_of(text):
            ids = words.get(word)
            if ids is None:
                ids = self.word_ids(word)
                if len(word) <= 16:
                    if len(words) >= CACHED_WORDS:
                        words.clear()
                    words[word] = ids
            out.append(ids)
        return b"".join(out)


def read_ranks(path: str) -> bytes:
    """The rank file as it is; below 2 MB for any public vocabulary."""
    return Path(path).read_bytes()


_encoders: dict[int, BytePairEncoder] = {}


def encoder_of(rank_file: bytes) -> BytePairEncoder:
    """The worker's encoder for a rank file; it lives as long as the worker, with its caches."""
    key = hash(rank_file)
    if key not in _encoders:
        lines = (line.split() for line in rank_file.splitlines() if line)
        _encoders[key] = BytePairEncoder({base64.b64decode(token): int(rank) for token, rank in lines})
    return _encoders[key]


def _mapped(df: DataFrame, keys: Sequence[str], text: str, path: str, counts: bool) -> DataFrame:
    out = "n_tokens" if counts else "ids"
    rows, names = keyed(df, keys, [out], _text=text)
    kind = T.LongType() if counts else T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([*(rows.schema[n] for n in names), T.StructField(out, kind, False)])
    shipped = df.sparkSession.sparkContext.broadcast(read_ranks(path))  # the vocabulary: a fixed file of under 2 MB

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shipped.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("_text"))
            for at in range(0, len(texts), 512):  # bounds the ids held at once
                packed = [encoder.encode(t) if t else b"" for t in texts.slice(at, 512).to_pylist()]
                sizes = np.array([len(p) // 4 for p in packed], np.int64)
                kept = [batch.column(batch.schema.get_field_index(n)).slice(at, 512) for n in names]
                if counts:
                    made = pa.array(sizes)
                else:
                    offsets = np.zeros(len(sizes) + 1, np.int32)
                    np.cumsum(sizes, out=offsets[1:])
                    made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                yield pa.RecordBatch.from_arrays([*kept, made], names=[*names, out])

    return rows.mapInArrow(encode, schema)


def token_ids(df: DataFrame, keys: Sequence[str], text: str, path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """keys and ids (array<int>) of every text, without special tokens; strings of such tokens are ordinary text.

    Empty and null texts have an empty list. Repeated rows come out repeated,
    other columns are left out, a key named `ids` is passed on as `ids_key`.
    Nothing is shuffled; texts of any length are encoded whole.
    """
    return _mapped(df, keys, text, path, counts=False)


def token_counts(df: DataFrame, keys: Sequence[str], text: str, path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """keys and n_tokens (long) of every text: the lengths of the lists of `token_ids`, which are never built."""
    return _mapped(df, keys, text, path, counts=True)
