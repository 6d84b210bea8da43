"""Places of texts that stand word for word in other texts, by difference-cover anchors.

D is a perfect difference set modulo V: any two offsets differ, modulo V, by a
difference of two members of D, so any two equal spans of V - 1 + W code points
hold equal windows of W that both begin at offsets in D modulo V. Hashing the
windows at those offsets only (a ninth of all) finds a window of every long match.
The windows that two rows share are then extended: all spans of full length
around them are hashed (96 bits) and looked up in the same manner, and
overlapping found spans are merged to maximal runs.

Both look-ups send, of a task's equal hashes, those of a single row through the shuffle, and of
these one for each stretch that the repeats cover;
rows that already met in the task are sure, so a text copied
into a third of all rows loads no task more than any other. Shared anchors, and the rows that
have one, come back to the texts as filters of bounded size, so no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.checkpoints import cut_lineage
from leafmill.llm.filters import filter_of

#: A perfect difference set modulo 91.
PERIOD = 91
COVER = (0, 1, 3, 9, 27, 49, 56, 61, 77, 81)

ROWS_AT_ONCE = 1_000_000

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))
_SALTS = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0xBF58476D1CE4E5B9))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WindowHash:
    """Hashes of all windows of a code point array, from prefix sums of a polynomial modulo 2^64."""

    def __init__(self, which: int) -> None:
        self.base, self.salt = _BASES[which], _SALTS[which]
        self.powers = self.inverse = np.ones(1, np.uint64)

    def reserve(self, n: int) -> None:
        if len(self.powers) < n:
            m = max(n, 1 << 14)
            back = np.uint64(pow(int(self.base), -1, 1 << 64))
            self.powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m, self.base))])
            self.inverse = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m, back))])

    def at(self, points: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
        self.reserve(len(points) + 1)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mixed(points.astype(np.uint64) + self.salt) * self.powers[: len(points)], out=sums[1:])
        return mixed((sums[starts + width] - sums[starts]) * self.inverse[starts])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def anchor_starts(n: int, width: int) -> np.ndarray:
    """Offsets of the cover's windows in a text of n code points."""
    blocks = np.arange(0, n, PERIOD)[:, None] + np.array(COVER)
    starts = blocks.ravel()
    return starts[starts + width <= n]


def _met(order_keys: tuple[np.ndarray, ...], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts by key and row id: the order, which sorted entries have a key that two rows share, which are of a key's first row."""
    order = np.lexsort((docs, *order_keys[::-1]))
    first = np.ones(len(order), bool)
    first[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in order_keys])
    group = np.cumsum(first) - 1
    ends = np.append(np.flatnonzero(first)[1:], len(order)) - 1
    d = docs[order]
    heads = d[np.flatnonzero(first)]
    return order, (heads != d[ends])[group], d == heads[group]


ANCHORS = T.StructType([T.StructField("h", T.LongType()), T.StructField("doc", T.LongType())])
#: `more` is how much further the last of a span's repeats begins, each of which overlaps or touches the one before.
SPANS = T.StructType([T.StructField("h", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("tail", T.LongType()), T.StructField("more", T.IntegerType())])
#: An anchor's hash is even; that of an anchor which two rows share in one task is made odd.
SURE_ANCHOR = np.int64(1)
#: A span's tail holds 32 bits of its second hash and its start; a sure span's tail its end, this bit, and its start.
SURE_SPAN = np.int64(1 << 31)


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def _groups_of_several(batches: Iterator[pa.RecordBatch], keys: Callable[[pa.RecordBatch], tuple[np.ndarray, ...]]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of sorted rows with a mask of those whose group, rows of equal keys, has more than one doc.

    The last group of a batch is held back until it ends. A group has one row for each
    flush of a task at most, however many rows of the input it stands for.
    """
    held: pa.RecordBatch | None = None

    def mask(rows: pa.RecordBatch) -> tuple[np.ndarray, int]:
        docs = rows.column("doc").to_numpy()
        first = np.ones(len(docs), bool)
        first[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys(rows)])
        at = np.flatnonzero(first)
        ends = np.append(at[1:], len(docs)) - 1
        return (docs[at] != docs[ends])[np.cumsum(first) - 1], int(at[-1])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.concat_batches([held, batch])
        several, last = mask(rows)
        held = rows.slice(last)
        yield rows.slice(0, last), several[:last]
    if held is not None and held.num_rows:
        yield held, mask(held)[0]


def _anchors(length: int):
    width = length - PERIOD + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WindowHash(0)

        def flush(hashes: list[np.ndarray], docs: list[np.ndarray]) -> pa.RecordBatch:
            h, d = np.concatenate(hashes), np.concatenate(docs)
            order, shared, _ = _met((h,), d)
            fresh = np.ones(len(h), bool)
            fresh[1:] = np.diff(h[order]) != 0
            sure = np.zeros(len(h), bool)
            sure[order] = shared
            # Of each hash one row, and of each doc with a sure one; in the order of rows, in which the ids next to each other compress.
            met = np.flatnonzero(sure)
            at = np.union1d(order[fresh], met[np.unique(d[met], return_index=True)[1]])
            return _batch(h=h[at] | sure[at], doc=d[at])

        hashes, docs, held = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column("_doc").to_pylist(), batch.column("_text")):
                points = code_points(text.as_py())
                starts = anchor_starts(len(points), width)
                hashes.append(hasher.at(points, starts, width).view(np.int64) & ~SURE_ANCHOR)
                docs.append(np.full(len(starts), doc, np.int64))
                held += len(starts)
                if held >= ROWS_AT_ONCE:
                    yield flush(hashes, docs)
                    hashes, docs, held = [], [], 0
        if held:
            yield flush(hashes, docs)

    return run


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, dh) of sorted anchors that two docs share, dh being a hash of a doc that has one."""
    even = ~SURE_ANCHOR
    for rows, several in _groups_of_several(batches, lambda r: (r.column("h").to_numpy() & even,)):
        h, doc = rows.column("h").to_numpy(), rows.column("doc").to_numpy()
        if not len(h):
            continue
        first = np.flatnonzero(np.append(True, (h[1:] & even) != (h[:-1] & even)))
        sure = np.repeat(np.maximum.reduceat(h & SURE_ANCHOR, first), np.diff(np.append(first, len(h)))) > 0
        kept = several | sure
        yield _batch(h=h[kept] & even, dh=mixed(doc[kept].view(np.uint64)).view(np.int64))


def merged(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of each doc made one."""
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order].astype(np.int64), b[order].astype(np.int64)
    fresh = np.ones(len(doc), bool)
    fresh[1:] = doc[1:] != doc[:-1]
    base = (np.cumsum(fresh) - 1) << 32  # keeps docs apart in one running maximum
    reach = np.maximum.accumulate(base + b)
    opens = fresh.copy()
    opens[1:] |= (base + a)[1:] > reach[:-1]
    at = np.flatnonzero(opens)
    ends = np.append(at[1:], len(doc)) - 1 if len(at) else at
    return doc[at], a[at], (reach - base)[ends]


def _shared_spans(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc, a, b) of sorted spans that two docs share, merged as far as they are at hand."""
        parts, held = [], 0

        def flush() -> pa.RecordBatch:
            doc, a, b = merged(*(np.concatenate(x) for x in zip(*parts)))
            return _batch(doc=doc, a=a.astype(np.int32), b=b.astype(np.int32))

        for rows, several in _groups_of_several(batches, lambda r: (r.column("h").to_numpy(), r.column("tail").to_numpy() >> 32)):
            doc, tail, more = (rows.column(c).to_numpy() for c in ("doc", "tail", "more"))
            sure = (tail & SURE_SPAN) != 0
            kept = several | sure
            start = tail & (SURE_SPAN - 1)
            end = np.where(sure, tail >> 32, start + more + length)
            parts.append((doc[kept], start[kept], end[kept]))
            held += int(kept.sum())
            if held >= ROWS_AT_ONCE:
                yield flush()
                parts, held = [], 0
        if held:
            yield flush()

    return run


def _candidate_spans(length: int, known: Broadcast):
    """Spans around shared anchors; `known` holds the filters of shared anchors and of the docs that have one."""
    width = length - PERIOD + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers, (anchors, owners) = (WindowHash(0), WindowHash(1)), known.value

        def flush(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            h1, h2, d, p = (np.concatenate(x) for x in zip(*parts))
            order, shared, first = _met((h1, h2), d)
            sure = np.sort(order[shared])
            # Of the first row of a key, its places; those that overlap or touch are one stretch.
            at = order[first]
            at = at[np.lexsort((p[at], h2[at], h1[at]))]
            far = np.ones(len(at), bool)
            far[1:] = (h1[at][1:] != h1[at][:-1]) | (h2[at][1:] != h2[at][:-1]) | (p[at][1:] > p[at][:-1] + length)
            begins = np.flatnonzero(far)
            reach = np.zeros(len(h1), np.int64)
            reach[at[begins]] = p[at[np.append(begins[1:], len(at)) - 1]] - p[at[begins]] if len(at) else 0
            first = np.sort(at[begins])
            # Sure spans, merged to runs of adjacent starts.
            sd, sp = d[sure], p[sure]
            opens = np.ones(len(sd), bool)
            opens[1:] = (sd[1:] != sd[:-1]) | (sp[1:] > sp[:-1] + length)
            lo = np.flatnonzero(opens)
            hi = np.append(lo[1:], len(sd)) - 1 if len(sd) else lo
            key = np.concatenate([h1[first], mixed(sd[lo].view(np.uint64))]).view(np.int64)
            found = (h2[first] & np.uint64(0xFFFFFFFF00000000)).view(np.int64) | p[first]
            tail = np.concatenate([found, ((sp[hi] + length) << 32) | SURE_SPAN | sp[lo]])
            more = np.concatenate([reach[first], np.zeros(len(lo), np.int64)]).astype(np.int32)
            return _batch(h=key, doc=np.concatenate([d[first], sd[lo]]), tail=tail, more=more)

        parts, held = [], 0
        for batch in batches:
            ids = batch.column("_doc").to_numpy()
            for k in np.flatnonzero(owners.has(mixed(ids.view(np.uint64)))).tolist():
                doc, points = int(ids[k]), code_points(batch.column("_text")[k].as_py())
                n = len(points)
                starts = anchor_starts(n, width)
                found = starts[anchors.has((hashers[0].at(points, starts, width).view(np.int64) & ~SURE_ANCHOR).view(np.uint64))]
                if not len(found):
                    continue
                marks = np.zeros(n + 2, np.int32)
                np.add.at(marks, np.maximum(found - (length - width), 0), 1)
                np.add.at(marks, np.minimum(found, n - length) + 1, -1)
                spans = np.flatnonzero(np.cumsum(marks)[: n - length + 1] > 0)
                if len(spans):
                    parts.append((hashers[0].at(points, spans, length), hashers[1].at(points, spans, length), np.full(len(spans), doc, np.int64), spans))
                    held += len(spans)
                if held >= ROWS_AT_ONCE:
                    yield flush(parts)
                    parts, held = [], 0
        if held:
            yield flush(parts)

    return run


def _runs(spans: DataFrame) -> DataFrame:
    """Merges overlapping or touching spans (doc, a, b) of each row to maximal runs."""
    by_start = Window.partitionBy("doc").orderBy("a", "b")
    opened = spans.withColumn("_reach", F.max("b").over(by_start.rowsBetween(Window.unboundedPreceding, -1)))
    numbered = opened.withColumn("_run", F.sum(F.when(F.col("_reach") >= F.col("a"), 0).otherwise(1)).over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc", "_run").agg(F.min("a").alias("start_pos"), F.max("b").alias("end_pos")).drop("_run")


def shared_runs(df: DataFrame, key: str, text: str, length: int = 200) -> DataFrame:
    """Maximal runs of shared positions: key, start_pos, end_pos (exclusive, in code points).

    A position is shared when a span of at least `length` code points around it
    stands, character for character, in the text of a row with another key.
    `key` is an integral column; rows of one key count as one row, and rows with
    a null key, null texts and texts under `length` share nothing. Repeats inside one
    text don't count. `length` must be at least twice the period of the cover.
    Equality is that of 96-bit hashes. Other columns are left out; a key named
    like an output is passed on as `<key>_key`.
    """
    if length < 2 * PERIOD:
        raise ValueError(f"length must be at least {2 * PERIOD}")
    name = f"{key}_key" if key in ("start_pos", "end_pos") else key
    rows = df.select(df[key].cast("long").alias("_doc"), df[text].alias("_text")).where((F.length("_text") >= length) & F.col("_doc").isNotNull())
    anchors = rows.mapInArrow(_anchors(length), ANCHORS).repartition(F.col("h").bitwiseAND(int(~SURE_ANCHOR))).sortWithinPartitions("h", "doc")
    met = cut_lineage(anchors.mapInArrow(_shared_anchors, "h long, dh long"))
    n = met.count()
    known = df.sparkSession.sparkContext.broadcast((filter_of(met, "h", n), filter_of(met, "dh", n)))
    spans = rows.mapInArrow(_candidate_spans(length, known), SPANS).repartition("h").sortWithinPartitions("h", F.shiftright("tail", 32), "doc")
    found = spans.mapInArrow(_shared_spans(length), "doc long, a int, b int")
    return _runs(found).select(F.col("doc").alias(name), "start_pos", "end_pos")
