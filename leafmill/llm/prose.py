"""Statistics of texts that tell prose from lists, tables and junk.

A line shows its statistics alone (`lines`): length, shares of figures, signs and
strange characters, ends of sentences, how it opens, gaps, members, repeats. A hidden Markov
model over them, trained by Viterbi passes over all texts, decides which lines are
prose, list, table or junk; a document's verdict is by the characters on lines of prose.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions.columns import keyed
from leafmill.llm.checkpoints import cut_lineage
from leafmill.llm.lines import AT_ONCE, WIDTHS, line_statistics
from leafmill.llm.markov import LineModel, packed, trained, unpacked

#: Words of a language that count as common: those in most of its texts, in two at least.
COMMON_WORDS = 300
#: Viterbi passes over all texts, and how many lines the start of the training weighs.
ROUNDS, WEIGHT = 2, 200.0

STATES = ("prose", "list", "table", "junk")
PROSE, LIST, TABLE, JUNK = range(4)
#: The hidden states, and the label of each: sentences, garbled sentences; items, running items; rows; signs, repetitions, encoded data.
HIDDEN = ("sentences", "garbled", "items", "register", "rows", "signs", "repeats", "data")
LABELS = np.array([PROSE, PROSE, LIST, LIST, TABLE, JUNK, JUNK, JUNK])

#: Where the training starts: rough weights of each statistic's values in each hidden state; statistics not named start even.
START = {
    "length": ((1, 2, 4, 6, 8, 10, 12, 14), (1, 2, 3, 4, 6, 8, 10, 14), (4, 8, 10, 8, 3, 1, 0.5, 0.3), (0.5, 1, 2, 3, 5, 8, 8, 10), (2, 6, 8, 10, 6, 3, 1, 1), (1, 3, 5, 6, 6, 4, 3, 2), (1, 2, 5, 6, 5, 3, 2, 1), (0.1, 0.1, 0.1, 0.3, 0.5, 2, 6, 14)),
    "figures": ((20, 6, 2, 1, 0.3), (6, 3, 3, 2, 2), (12, 1, 3, 2, 1), (20, 1, 0.5, 0.2, 0.1), (2, 1, 3, 6, 8), (5, 1, 2, 4, 4), (12, 1, 1, 0.5, 0.3), (1, 0.1, 0.1, 0.5, 14)),
    "signs": ((6, 10, 6, 1, 0.1, 0.05), (2, 3, 4, 5, 5, 3), (6, 3, 4, 5, 2, 0.3), (0.5, 2, 6, 12, 2, 0.1), (4, 2, 4, 6, 3, 2), (0.3, 0.3, 0.5, 1, 4, 14), (12, 2, 2, 1, 0.3, 0.1), (2, 4, 6, 3, 0.5, 0.1)),
    "strange": ((30, 3, 1, 0.1, 0.05), (0.3, 0.5, 2, 6, 12), (30, 2, 1, 0.3, 0.1), (30, 2, 0.5, 0.2, 0.1), (30, 2, 0.5, 0.3, 0.1), (30, 2, 1, 0.5, 0.1), (30, 2, 0.5, 0.2, 0.1), (30, 1, 0.2, 0.1, 0.1)),
    "sentence": ((8, 3, 5, 8), (8, 2, 1, 2), (14, 0.5, 0.5, 0.1), (14, 0.5, 0.2, 0.05), (14, 0.6, 0.3, 0.1), (12, 3, 0.3, 0.1), (14, 0.6, 0.3, 0.1), (14, 0.5, 0.3, 0.1)),
    "gaps": ((40, 1), (20, 1), (20, 1), (40, 1), (3, 5), (6, 2), (20, 1), (40, 1)),
    "members": ((30, 3, 1, 0.1), (30, 3, 1, 1), (30, 0.5, 0.5, 1), (0.5, 0.5, 2, 20), (20, 0.5, 0.5, 2), (30, 1, 1, 1), (30, 0.5, 0.5, 0.5), (30, 0.2, 0.1, 0.1)),
    "repeats": ((14, 3, 0.2, 0.05), (14, 2, 0.5, 0.2), (14, 2, 1, 0.3), (6, 6, 3, 0.2), (14, 2, 1, 0.5), (14, 2, 1, 1), (0.2, 1, 3, 12), (14, 0.3, 0.2, 0.2)),
    "longest": ((30, 3, 0.2, 0.05), (20, 3, 2, 2), (30, 1, 0.1, 0.05), (30, 2, 0.2, 0.1), (30, 1, 0.1, 0.1), (8, 4, 3, 4), (30, 1, 0.2, 0.1), (0.1, 0.2, 0.5, 14)),
}

_DENSE = re.compile("[฀-๿぀-ヿ㐀-鿿]")
_DENSE_PART = re.compile("[฀-๿぀-ヿ㐀-鿿]+")
_MARKS = "".join(chr(c) for c in range(0x300, 0x10000) if unicodedata.category(chr(c))[0] == "M")
_UNIT = re.compile(rf"[^\W\d_]+(?:[{_MARKS}]+[^\W\d_]*)*(?:[’'\-‐‑][^\W\d_]+(?:[{_MARKS}]+[^\W\d_]*)*)*")
# Scripts that texts of no known language are told apart by, as ranges of characters.
SCRIPTS = {"Latin": "A-Za-zÀ-ɏ", "Greek": "Ͱ-Ͽ", "Cyrillic": "Ѐ-ԯ", "Hebrew": "֐-׿", "Arabic": "؀-ۿ", "Devanagari": "ऀ-ॿ", "Thai": "฀-๿", "Kana": "぀-ヿ", "Han": "㐀-鿿", "Hangul": "가-힣"}
_SCRIPT_OF = np.full(0x10000, len(SCRIPTS), np.uint8)
for _k, _ranges in enumerate(SCRIPTS.values()):
    for _a, _b in zip(_ranges[::3], _ranges[2::3]):
        _SCRIPT_OF[ord(_a) : ord(_b) + 1] = _k


def first_model() -> LineModel:
    """Where the training starts."""
    n = len(HIDDEN)
    emit = [np.array(START.get(name, np.ones((n, width))), float) for name, width in WIDTHS.items()]
    move = np.full((n, n), 0.01) + np.eye(n) * 0.9
    move[0, 1] = move[1, 0] = 0.05
    start = np.array([0.6, 0.05, 0.08, 0.05, 0.1, 0.05, 0.05, 0.02])
    return LineModel(start / start.sum(), move * 0.95 / move.sum(1, keepdims=True), np.full(n, 0.05), [e / e.sum(1, keepdims=True) for e in emit])


def line_labels(text: str, model: LineModel) -> list[int]:
    """The label of each line of a text that isn't blank."""
    codes, _, lengths, _ = line_statistics([text])
    return LABELS[model.paths(codes, lengths)].tolist()


def word_statistics(counts: dict[str, np.ndarray], lines: np.ndarray) -> list[pa.Array]:
    """word_count, mean_word_length, symbol_ratio and end_punctuation_share of texts; all null but word_count where nothing is counted."""

    def ratio(above: np.ndarray, below: np.ndarray) -> pa.Array:
        return pa.array(above / np.maximum(below, 1), pa.float64(), mask=below == 0)

    return [pa.array(counts["words"]), ratio(counts["word_chars"], counts["words"]), ratio(counts["solid"] - counts["alnum"], counts["solid"]), ratio(counts["ends"], lines)]


def units(text: str) -> list[str]:
    """The words of a text in lower case, with their combining marks; of scripts without spaces the pairs of characters."""
    text = text.lower()
    found = []
    if _DENSE.search(text):
        for run in _DENSE_PART.findall(text):
            found += map(str.__add__, run, run[1:]) if len(run) > 1 else [run]
        text = _DENSE_PART.sub(" ", text)
    return found + _UNIT.findall(text)


def word_group(language: str | None, text: str) -> str:
    """What texts share their common words with this one: its language, or where that isn't known ('und' included) the script of most of its letters."""
    if language and language != "und":
        return language
    found = np.zeros(len(SCRIPTS) + 1, np.int64)
    for at in range(0, len(text), AT_ONCE):
        points = np.frombuffer(text[at : at + AT_ONCE].encode("utf-32-le", "surrogatepass"), "<u4")
        found += np.bincount(_SCRIPT_OF[np.minimum(points, len(_SCRIPT_OF) - 1)], minlength=len(found))
    counts = dict(zip(SCRIPTS, found.tolist()))
    if counts["Kana"] * 5 > counts["Han"]:
        counts["Kana"] += counts["Han"]
    return "script " + max(counts, key=counts.get)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter[str]] = {}

    def counted() -> Iterator[pa.RecordBatch]:
        for group, words in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([group] * len(words), pa.string()), pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], names=["group", "word", "n"])

    for batch in batches:
        for language, text in zip(batch.column("_language").to_pylist(), batch.column("_text").to_pylist()):
            counts.setdefault(word_group(language, text), Counter()).update(set(units(text)))
        if sum(map(len, counts.values())) > 300_000:
            yield from counted()
            counts.clear()
    yield from counted()


def common_words(df: DataFrame, text: str, language: str | None = None) -> dict[str, frozenset[str]]:
    """By word_group the COMMON_WORDS words that are in most of its texts, over all texts; of a tie the first by alphabet.

    What is collected is bounded by the number of languages; each task cuts its words to COMMON_WORDS
    a language before they meet.
    """
    texts = df.select((df[language] if language else F.lit(None)).cast("string").alias("_language"), df[text].alias("_text")).where(F.length("_text") > 0)
    counts = texts.mapInArrow(_words, "group string, word string, n long").groupBy("group", "word").agg(F.sum("n").alias("n")).where("n > 1")
    place = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("n"), "word"))
    found: dict[str, set[str]] = {}
    for r in counts.withColumn("_place", place).where(F.col("_place") <= COMMON_WORDS).collect():
        found.setdefault(r["group"], set()).add(r["word"])
    return {group: frozenset(words) for group, words in found.items()}


STATISTICS = [
    T.StructField("word_count", T.LongType()),
    T.StructField("mean_word_length", T.DoubleType()),
    T.StructField("symbol_ratio", T.DoubleType()),
    T.StructField("end_punctuation_share", T.DoubleType()),
    T.StructField("common_word_share", T.DoubleType()),
    *(T.StructField(f"{s}_share", T.DoubleType()) for s in STATES),
    T.StructField("verdict", T.StringType()),
]


def common_share(text: str | None, common: frozenset[str] | set[str]) -> float | None:
    """The share of a text's units that are common; null without units."""
    own = units(text) if text else ()
    return sum(map(common.__contains__, own)) / len(own) if own else None


def document_shares(codes: np.ndarray, solid: np.ndarray, lengths: np.ndarray, model: LineModel) -> np.ndarray:
    """The share of each label in the characters of each document (NaN without lines)."""
    labels = LABELS[model.paths(codes, lengths)]
    doc = np.repeat(np.arange(len(lengths)), lengths)
    weight = np.bincount(doc * len(STATES) + labels, solid, minlength=len(lengths) * len(STATES)).reshape(-1, len(STATES))
    total = weight.sum(1, keepdims=True)
    return np.divide(weight, total, out=np.full(weight.shape, np.nan), where=total > 0)


def text_statistics(df: DataFrame, keys: Sequence[str], text: str, language: str | None = None) -> DataFrame:
    """keys, the statistics and the verdict of every text.

    word_count; mean_word_length; symbol_ratio, the share of its characters other than blanks
    that are neither letters, marks nor digits; end_punctuation_share of its lines with text;
    common_word_share of its words (pairs of characters in scripts without spaces), the common ones being
    those of the column `language`, or of the text's script where there is none; prose_share, list_share, table_share and
    junk_share of its characters other than blanks, by the labels of their lines; verdict 'prose' where
    prose_share is above a half, else 'not prose'. In scripts without spaces each letter with its marks counts as
    a word. Null, empty and blank texts have word_count 0 and nulls, also for the verdict. The line
    model is trained on all texts. Repeated rows come
    out repeated; other columns are left out; a key named like an output is passed on as `<key>_key`.
    """
    rows, names = keyed(df, keys, [f.name for f in STATISTICS], _text=text, **({"_language": language} if language else {}))
    rows = rows.withColumn("_language", (F.col("_language") if language else F.lit(None)).cast("string"))
    common = common_words(df, text, language)
    kept = [*names, *(f.name for f in STATISTICS[:5])]
    measured = T.StructType([*(rows.schema[n] for n in names), *STATISTICS[:5], T.StructField("_codes", T.BinaryType()), T.StructField("_solid", T.BinaryType())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            shares = [common_share(t, common.get(word_group(lang, t), frozenset())) if t else None for lang, t in zip(batch.column("_language").to_pylist(), texts)]
            codes, solid, lengths, counts = line_statistics([t or "" for t in texts])
            ends = np.cumsum(lengths)
            packs = [packed(codes[e - n : e]) for e, n in zip(ends, lengths)]
            sizes = [packed(solid[e - n : e].astype("<u4").view(np.uint8)) for e, n in zip(ends, lengths)]
            made = (pa.array(shares, pa.float64()), pa.array(packs, pa.binary()), pa.array(sizes, pa.binary()))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *word_statistics(counts, lengths), *made], names=measured.names)

    lines = cut_lineage(rows.mapInArrow(measure, measured))
    model = trained(first_model(), lines, "_codes", ROUNDS, WEIGHT)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, lengths = unpacked(batch.column("_codes").to_pylist(), len(WIDTHS))
            sizes, _ = unpacked(batch.column("_solid").to_pylist(), 4)
            shares = document_shares(codes, sizes.reshape(-1).view("<u4"), lengths, model)
            full = lengths > 0
            parts = [pa.array(s, pa.float64(), mask=~full) for s in shares.T]
            verdict = pa.array(np.where(shares[:, PROSE] > 0.5, "prose", "not prose"), pa.string(), mask=~full)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *parts, verdict], names=[*names, *(f.name for f in STATISTICS)])

    return lines.mapInArrow(label, T.StructType([*(rows.schema[n] for n in names), *STATISTICS]))
