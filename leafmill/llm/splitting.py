"""Cuts oversized texts into overlapping pieces at natural boundaries."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions.columns import keyed, text_or_empty

#: Boundary patterns, the strongest first; a boundary lies behind each match.
BOUNDARIES = [
    re.compile(r"\n[^\S\n]*\n\s*"),
    re.compile(r"[.!?…։؟]+[\"”’»)\]]*\s+|[。！？．｡।॥]+[」』”’）)]*\s*|\n"),
    re.compile(r"\s+|[、，；：,;:]\s*"),
]
#: Code points that stay with the one before them: marks, joiners, variation selectors.
ATTACHED = re.compile("[̀-ͯ҃-҉֑-ֽً-ٟऀ-ःऺ-ॏ॑-ॗัำ-ฺ็-๎‍⃐-⃿゙゚︀-️\U0001f3fb-\U0001f3ff]")
_SEGMENTS = re.compile(r"\s+|[^\s]")


def piece_spans(text: str, limit: int, overlap: int, size_of: Callable[[str], int] | None = None) -> list[tuple[int, int]]:
    """The code point spans of the pieces of `text`, each of at most `limit` in size.

    A cut is the last boundary of the strongest kind in reach: a paragraph end
    in the upper half of the piece, else a sentence or line end, else a blank or
    comma, else between two code points (not before a combining mark if any
    other place is left). Each further piece begins `overlap` before the last
    cut. `size_of` weighs a code point; without it each weighs 1. An overlap of
    `limit` or more counts as `limit - 1`; a limit under 1 counts as 1.
    """
    n = len(text)
    limit = max(1, limit)
    overlap = min(max(0, overlap), limit - 1)
    # sums[i] is the size of text[:i]; with unit sizes an offset is its own prefix sum.
    sums: Sequence[int] = range(n + 1) if size_of is None else [0, *accumulate(map(size_of, text))]
    if sums[n] <= limit:
        return [(0, n)]
    levels = [[m.end() for m in p.finditer(text)] for p in BOUNDARIES]
    spans: list[tuple[int, int]] = []
    start = cut = 0
    while sums[n] - sums[start] > limit:
        last = max(bisect_right(sums, sums[start] + limit) - 1, cut + 1)
        first = min(max(bisect_right(sums, sums[start] + overlap), cut + 1), last)
        found = -1
        for level, ends in enumerate(levels):
            least = first if level else max(first, start + (last - start) // 2)
            k = bisect_right(ends, last) - 1
            if k >= 0 and ends[k] >= least:
                found = ends[k]
                break
        if found < 0:
            found = last
            while found > first and ATTACHED.match(text, found):
                found -= 1
            if ATTACHED.match(text, found):
                found = last
        spans.append((start, found))
        cut = found
        start = max(bisect_left(sums, sums[cut] - overlap), start + 1) if overlap else cut
    spans.append((start, n))
    return spans


def split_oversized(df: DataFrame, keys: Sequence[str], text: str, limit: str, overlap: str) -> DataFrame:
    """Pieces of every text: keys, piece_no (from 1), n_pieces, start_pos, end_pos, piece.

    `limit` and `overlap` are columns of code point counts. A text within its
    limit is one piece and never leaves the JVM. Null and empty texts are one
    empty piece. A null limit means no limit, a null overlap none. Rows that
    are repeated come out repeated. Other columns are left out; a key named like
    an output is passed on as `<key>_key`. The pieces of a text are made in one
    task from that text alone, so nothing is shuffled.
    """
    out = ["piece_no", "n_pieces", "start_pos", "end_pos", "piece"]
    rows, names = keyed(df, keys, out, _text=text, _limit=limit, _overlap=overlap)
    rows = rows.select(*names, text_or_empty("_text").alias("_text"), F.col("_limit").cast("int"), F.coalesce(F.col("_overlap"), F.lit(0)).cast("int").alias("_overlap"))
    over = F.length("_text") > F.col("_limit")
    whole = rows.where(~F.coalesce(over, F.lit(False))).select(
        *names, F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start_pos"), F.length("_text").alias("end_pos"), F.col("_text").alias("piece")
    )
    schema = T.StructType([rows.schema[n] for n in names] + [T.StructField(c, T.IntegerType(), False) for c in out[:-1]] + [T.StructField("piece", T.StringType(), False)])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made: list[tuple[int, int, int, int, int, str]] = []
            for i, (t, at_most, lap) in enumerate(zip(batch["_text"], batch["_limit"], batch["_overlap"])):
                spans = piece_spans(t, int(at_most), int(lap))
                made += [(i, k + 1, len(spans), a, b, t[a:b]) for k, (a, b) in enumerate(spans)]
            pieces = pd.DataFrame(made, columns=["_row", *out])
            yield pd.concat([batch[names].iloc[pieces["_row"]].reset_index(drop=True), pieces[out]], axis=1)

    return whole.unionByName(rows.where(over).mapInPandas(cut, schema))
