"""Noise of scanned pages: running lines and page numbers, cut words, misread characters.

A hidden Markov model labels the lines of a page as running head, body, break or
running foot. A line shows layout statistics alone: how often its like stands at the ends of
the document's other pages, how long it is beside the page's others, what share of it could be digits, how
it opens, ends and goes on. Which zone it is in is up to the path: a page runs from head
over body to foot. The model is trained by Viterbi passes over all scanned documents. Body lines are then
joined to paragraphs. Misread words are found among the corpus's distinct words: one that
turns into a word on many more pages when the scanner's usual confusions are undone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.checkpoints import cut_lineage
from leafmill.llm.copies import small_side, with_copies
from leafmill.llm.markov import LineModel, packed, trained, unpacked

#: Viterbi passes over all scanned documents, and how many lines the start of the training weighs.
ROUNDS, WEIGHT = 2, 200.0
#: Pages that a word must be on to be an original, and how many times the pages of its misreading.
MIN_PAGES, TIMES = 3, 4
#: Rows of document ids or misread words up to which they are broadcast (small_side bounds their bytes); beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000

HEAD, BODY, BREAK, FOOT = range(4)
#: The hidden states, in the order in which a page runs through them, and the label of each.
HIDDEN = ("head", "gap in the head", "flow", "piece", "gap", "foot", "gap in the foot")
LABELS = np.array([HEAD, BREAK, BODY, BODY, BREAK, FOOT, BREAK])
#: The statistics of a line, and how many values each has.
WIDTHS = {"blank": 2, "alike": 4, "inner": 2, "length": 5, "words": 5, "digits": 5, "opens": 5, "ends": 3, "goes_on": 2, "ruled": 2, "page": 2, "capitals": 2}

# What a scanner takes for what.
AS_LETTERS = {"0": "oO", "1": "liI", "5": "sS", "6": "bG", "8": "B", "9": "g", "4": "A", "3": "E", "7": "T", "2": "zZ", "+": "t", "|": "lIi", "$": "sS", "(": "cC", "!": "liI"}
AS_OTHER_LETTERS = {"0": "оОοΟ", "1": "іІιΙ", "3": "зЗ", "4": "ч", "6": "б", "8": "ВΒ"}
WHOLE_PARTS = (("rn", "m"), ("ri", "n"), ("cl", "d"), ("ii", "u"), ("li", "h"), ("vv", "w"), ("c", "e"), ("I", "l"), ("tl", "d"), ("lc", "k"))
AS_DIGITS = str.maketrans("lIi|OoSsBbZzgq", "11110055868299")
# Words behind a hyphen that hangs ("pre- and post-dose").
HANGING = {"and", "or", "und", "oder", "bzw", "et", "ou", "y", "o", "e", "u", "sowie", "и", "или", "to", "bis", "nor"}
CUT_MARKS = "-­¬‐‑"

#: Scripts whose words a scanner's confusions are known for.
_LETTERS = "A-Za-z\u00c0-\u024f\u0370-\u03ff\u0400-\u052f"
_PLAIN = re.compile(rf"[{_LETTERS}0-9+|]*[{_LETTERS}0-9][{_LETTERS}0-9+|]*")
# The signs of AS_LETTERS belong to a word where a letter follows, '$' also at the end of one in lower case.
_TOKEN = re.compile(rf"(?:[$(!](?=[{_LETTERS}]))?{_PLAIN.pattern}(?:(?:[$(!](?=[{_LETTERS}])|(?<=[a-zß-ÿа-я])\$(?!\d))[{_LETTERS}0-9+|]*)*")
_SIGNS = frozenset("$(!")
# Words that stand before a page's number.
_PAGE = re.compile(r"\W*(?:page|p\.|pag\.|seite|s\.|página|pág\.|стр\.|страница|หน้า|पृष्ठ|第|頁|ページ|页)\s*\S{1,4}\b", re.I)
_DIGITS = re.compile(r"(?<![^\W\d_])[lIOSB|]*\d[\dlIOSB|]*(?![^\W\d_])")
_RULED = re.compile(r"\s\|\s| · |\s{2,}\S*\d\S*$|^\S*\d\S*\s{2,}|^\S+ [–—-] \S+")
_ENDS = re.compile(r"[.!?。！？．।;,、，…:]['\"”’»」』)\]]*$")
_FOLD = str.maketrans("0156+|89li", "olsbtlbgll")


def line_key(line: str) -> str:
    """What stays of a running line from page to page: numbers stand for one another, and so do characters often misread."""
    line = _DIGITS.sub("#", line.strip())
    line = re.sub(r"(?<!\w)[ivxlcdm]{1,12}(?!\w)$", "#", line)
    return re.sub(r"\s+", " ", line.lower().translate(_FOLD)).replace("rn", "m").replace("cl", "d").replace("c", "e")


def observations(pages: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(codes of every line, blank ones included; lines of each page)."""
    split = [[line.strip() for line in (p or "").split("\n")] for p in pages]
    texts = [[i for i, line in enumerate(lines) if line] for lines in split]
    edge, keys = Counter(), []
    for lines, at in zip(split, texts):
        own = {i: line_key(lines[i]) for i in (*at[:3], *at[-2:])}
        keys.append(own)
        edge.update(set(own.values()))
    # Only lines as long as one that recurs can be its like.
    sizes = [len(lines[i]) for lines, own in zip(split, keys) for i, key in own.items() if edge[key] > 1]
    low, high = min(sizes, default=1) - 2, max(sizes, default=0) + 2
    inner = {line_key(lines[i]) for lines, at in zip(split, texts) for i in at[3:-2] if low <= len(lines[i]) <= high}
    several, made = sum(map(bool, texts)) > 1, []
    for lines, at, own in zip(split, texts, keys):
        width = float(np.median([len(lines[i]) for i in at])) if at else 1.0
        for i, text in enumerate(lines):
            if not text:
                made.append((1, *[0] * (len(WIDTHS) - 1)))
                continue
            key, n = own.get(i), len(text)
            others = edge[key] - 1 if key is not None else 0
            solid = text.replace(" ", "")
            digits = sum(map(_DIGIT_LIKE.__contains__, solid)) / len(solid)
            share, words, first = n / width, text.count(" ") + 1, text[0]
            ahead = lines[i + 1][:1] if i + 1 < len(lines) else ""
            made.append(
                (
                    0,
                    3 if not several else min(others, 2),
                    key in inner,
                    0 if share < 0.2 else 1 if share < 0.45 else 2 if share < 0.75 else 3 if share < 0.95 else 4,
                    0 if words == 1 else 1 if words == 2 else 2 if words < 5 else 3 if words < 9 else 4,
                    0 if not digits else 1 if digits < 0.25 else 2 if digits < 0.5 else 3 if digits < 1 else 4,
                    0 if first.islower() else 1 if first.isalpha() and not _NUMBERED.match(text) else 4 if _NUMBERED.match(text) else 2 if first.isdigit() else 3,
                    1 if _ENDS.search(text, max(0, n - 4)) else 2 if text[-1] in CUT_MARKS and text[-2:-1].isalpha() else 0,
                    ahead.islower(),
                    _RULED.search(text) is not None,
                    n <= 40 and _PAGE.match(text) is not None,
                    text.isupper(),
                )
            )
    return np.array(made, np.uint8).reshape(-1, len(WIDTHS)), np.array([len(lines) for lines in split], np.int64)


_NUMBERED = re.compile(r"\d+(?:\.\d+)*\.? +[^\W\d]|第\s*\d+\s*[章节節条款項]")
_DIGIT_LIKE = frozenset("0123456789lIOSB|-–—/.")

#: Where the training starts: rough weights of each statistic's values in each hidden state (of the gaps only that they are blank); statistics not named start even.
START = {
    "alike": ((2, 3, 8, 5), (30, 2, 1, 12), (20, 3, 1, 8), (2, 3, 8, 5)),
    "inner": ((30, 1), (30, 1), (10, 1), (30, 1)),
    "length": ((4, 8, 5, 1, 1), (1, 2, 2, 5, 12), (5, 6, 4, 2, 1), (10, 6, 2, 1, 1)),
    "words": ((1, 2, 5, 3, 1), (1, 1, 2, 5, 12), (2, 3, 5, 3, 1), (8, 4, 3, 1, 0.5)),
    "digits": ((4, 3, 2, 2, 4), (8, 6, 0.5, 0.1, 0.05), (5, 3, 3, 2, 0.5), (1, 1, 1, 4, 10)),
    "opens": ((2, 12, 4, 4, 0.5), (10, 10, 1, 2, 0.5), (2, 8, 2, 2, 8), (2, 8, 8, 6, 0.5)),
    "ends": ((40, 1, 0.5), (6, 6, 3), (10, 3, 0.5), (40, 1, 1)),
    "ruled": ((3, 2), (20, 1), (6, 2), (3, 2)),
    "page": ((12, 1), (300, 1), (200, 1), (6, 3)),
}


def first_model() -> LineModel:
    """Where the training starts: a page runs through head, body and foot, each with its gaps, in this order."""
    solid, emit = [0, 2, 3, 5], []
    for name, width in WIDTHS.items():
        table = np.ones((len(HIDDEN), width))
        if name == "blank":
            table[:] = [1e-7, 1.0]
            table[solid] = [1.0, 1e-7]
        elif name in START:
            table[:] = [1.0] + [1e-3] * (width - 1)
            table[solid] = np.array(START[name], float)
        emit.append(table / table.sum(1, keepdims=True))
    move = np.array(
        [
            [0.15, 0.25, 0.5, 0.1, 1e-6, 1e-3, 1e-6],
            [0.05, 0.1, 0.65, 0.2, 1e-6, 1e-3, 1e-6],
            [1e-9, 1e-9, 0.75, 0.08, 0.08, 0.04, 0.01],
            [1e-9, 1e-9, 0.3, 0.45, 0.15, 0.04, 0.01],
            [1e-9, 1e-9, 0.55, 0.3, 0.05, 0.1, 1e-3],
            [1e-9, 1e-9, 1e-9, 1e-9, 1e-9, 0.1, 0.1],
            [1e-9, 1e-9, 1e-9, 1e-9, 1e-9, 0.6, 0.2],
        ]
    )
    stop = np.array([0.02, 0.02, 0.04, 0.04, 0.02, 0.8, 0.2])
    both = move.sum(1) + stop
    start = np.array([0.4, 0.03, 0.4, 0.12, 0.02, 0.02, 1e-3])
    return LineModel(start / start.sum(), move / both[:, None], stop / both, emit)


def line_labels(pages: Sequence[str | None], model: LineModel, observed: tuple[np.ndarray, np.ndarray] | None = None) -> list[list[int]]:
    """A label for each line of each page."""
    codes, lengths = observed or observations(pages)
    labels, at, made = LABELS[model.paths(codes, lengths)].tolist(), 0, []
    for n in lengths.tolist():
        made.append(labels[at : at + n])
        at += n
    return made


def broken_lines(pages: Sequence[str | None], labels: list[list[int]]) -> list[tuple[int, int, int, int]]:
    """(page, line, next page, next line) of body lines whose last word goes on in the next body line, all from 0."""
    body, gap = [], False
    for p, (text, states) in enumerate(zip(pages, labels)):
        for i, line in enumerate((text or "").split("\n")):
            if states[i] == BODY:
                body.append((p, i, line.strip(), gap))
                gap = False
            elif states[i] == BREAK and body and body[-1][0] == p:
                gap = True
    found = []
    for (p, i, line, _), (q, j, after, parted) in zip(body, body[1:]):
        if len(line) < 2 or line[-1] not in CUT_MARKS or not line[-2].isalpha() or (parted and p == q):
            continue
        word = re.match(r"[^\W_]+|[+|$!]?[^\W_]+", after)
        if not word or (line[-1] in "-‐‑" and word.group().lower() in HANGING):
            continue
        head = after[:1]
        if head.islower() or (head in "0123456789+|$!" and after[1:2].islower()) or (head.isupper() and line[-2].isupper() and word.group().isupper() and len(word.group()) > 1):
            found.append((p, i, q, j))
    return found


def plain_parts(token: str) -> list[tuple[int, str]]:
    """(offset, part) of what a token with signs is if they are no letters; none of a token without them."""
    return [] if _SIGNS.isdisjoint(token) else [(m.start(), m.group()) for m in _PLAIN.finditer(token)]


def body_tokens(pages: Sequence[str | None], labels: list[list[int]], broken: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, str, int, int, int]]:
    """(page, line, token, next page, next line, cut) of the tokens of body lines; of a cut word the whole, with the length of its first part (else -1)."""
    goes_on = {(p, i): (q, j) for p, i, q, j in broken}
    taken: dict[tuple[int, int], int] = {}
    for p, (text, states) in enumerate(zip(pages, labels)):
        for i, line in enumerate((text or "").split("\n")):
            if states[i] != BODY:
                continue
            line = line.strip()
            after = goes_on.get((p, i))
            if after:
                line = line[:-1]
            tokens = list(_TOKEN.finditer(line, taken.pop((p, i), 0)))
            if after and tokens and tokens[-1].end() == len(line):
                rest = _TOKEN.match((pages[after[0]] or "").split("\n")[after[1]].strip())
                part = tokens.pop().group()
                if rest:
                    taken[after] = rest.end()
                    yield p, i, part + rest.group(), *after, len(part)
                    for at, plain in plain_parts(part + rest.group()):
                        if at >= len(part):
                            yield *after, plain, *after, -1
                        else:
                            yield p, i, plain, *after, len(part) - at
            for m in tokens:
                for word in (m.group(), *(plain for _, plain in plain_parts(m.group()))):
                    if len(word) > 1:
                        yield p, i, word, p, i, -1


#: Signs in a word up to which each way of undoing them is tried; beyond, words of one sign fold are looked up.
TRIED_SIGNS = 3
_FOLD_GROUPS = ("o0оο", "l1i!|іι", "s5$", "b6g89бв", "a4ч", "e3з", "t7+", "z2", "c(")
_FOLDED = ("".join(_FOLD_GROUPS), "".join(g[0] * len(g) for g in _FOLD_GROUPS))
_SIGN_FOLD = str.maketrans(*_FOLDED)
#: What marks a sign fold among words.
_FOLD_MARK = "\0"


def _as_letters(sign: str, other: bool) -> str:
    return (AS_OTHER_LETTERS.get(sign, "") if other else "") + AS_LETTERS[sign]


def readings(word: str) -> list[tuple[str, int, bool]]:
    """(what the word may have been, where it first differs, whether its shape alone proves it) by undoing confusions; -1 where the word is one behind a bracket or an exclamation mark.

    Of a word with more than TRIED_SIGNS signs the one reading is its sign fold, behind _FOLD_MARK.
    """
    found: dict[str, int] = {}
    odd = [i for i, c in enumerate(word) if c in AS_LETTERS]
    proven = ""
    if any(c.isalpha() for c in word) and 0 < len(odd) < len(word):
        if len(odd) > TRIED_SIGNS:
            return [(_FOLD_MARK + word.lower().translate(_SIGN_FOLD), odd[0], False)]
        other = any("\u0370" <= c <= "\u052f" for c in word)
        for choice in product(*(_as_letters(word[i], other) for i in odd)):
            made = list(word)
            for i, c in zip(odd, choice):
                made[i] = c
            found.setdefault("".join(made), odd[0])
        if len(odd) == 1 and _WORD_SHAPE.fullmatch(word):
            proven = next(iter(found))
    if word.isalpha() and len(word) > 3:
        found[word] = len(word)
    if len(word) > 3:
        for _ in range(1 + (len(word) > 6)):  # a second confusion at another place of a long word
            for made, first in list(found.items()):
                for old, new in WHOLE_PARTS:
                    at = made.find(old)
                    while at >= 0:
                        found.setdefault(made[:at] + new + made[at + len(old) :], min(at, first))
                        at = made.find(old, at + 1)
    number = _NUMBER_SHAPE.fullmatch(word)
    if number and not number.group(1).isdigit():
        made = number.group(1).translate(AS_DIGITS) + (number.group(2) or "")
        found.setdefault(made, next((i for i, (a, b) in enumerate(zip(word, made)) if a != b), 0))
    found.pop(word, None)
    if word[0] in "(!" and word[1:].isalpha():
        found[word[1:]] = -1
    return [(made, at, made == proven) for made, at in found.items()]


#: A word of lower-case letters, with or without a capital, in which one sign of AS_LETTERS stands.
_WORD_SHAPE = re.compile("(?=.{6,16}$)(?:[A-ZÀ-Þ]?[a-zß-ÿ]*[a-zß-ÿ]{2}[015689+|][a-zß-ÿ]*|[A-ZÀ-Þ]?[015689+|][a-zß-ÿ]{4,})")
_NUMBER_SHAPE = re.compile(r"((?=[lIOoSBZ|]*\d)[\dlIOoSBZ|]+)(ml|mg|kg|g|mm|h)?")
_DECIMAL = re.compile(r"(?<![^\W\d_])(?=[lIOSB|]*\d|[lIOSB|\d]+[.,．]\d)(?=[\d.,．]*[lIOSB|])[\dlIOSB|]+[.,．][\dlIOSB|]+(?![^\W\d_]{2})")


_JOIN = re.compile(f"(?<=[^\\W\\d_])[{CUT_MARKS}]\\n(?=[a-zà-ÿ])")
WORDS_AT_ONCE = 300_000


def page_words(page: str | None) -> set[str]:
    """The distinct words of a page as they are counted."""
    words = set(_TOKEN.findall(_JOIN.sub("", page or "")))
    words.update([plain for w in words if not _SIGNS.isdisjoint(w) for _, plain in plain_parts(w)])
    return {w for w in words if len(w) > 1}


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the pages' words; each of several copies of a page weighs its part of one."""
    words: Counter[str] = Counter()

    def counted() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.float64())], names=["word", "n"])

    for batch in batches:
        for page, copies in zip(batch.column("_page").to_pylist(), batch.column("_copies").to_pylist()):
            if copies is None:
                words.update(page_words(page))
            else:
                for word in page_words(page):
                    words[word] += 1 / copies
        if len(words) > WORDS_AT_ONCE:
            yield counted()
            words.clear()
    if words:
        yield counted()


def _read_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(w, n, *reading) for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()) for reading in readings(w)]
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.bool_())], names=["word", "n", "reading", "at", "proven"])


def misread_words(docs: DataFrame, pages: str) -> DataFrame:
    """word, original, at of the corpus's words that are misreadings, from the counts of all pages of all documents; equal pages count once.

    `at` is where the word first differs. Of several originals the one on most
    pages is taken. A number needs no other page to prove it, but must not be
    rarer as it stands than as it would have been. '(' or '!' before a word of
    its own ('(old') is a sign, not a letter.
    """
    texts = with_copies(docs.select(F.explode(docs[pages]).alias("_page")).where(F.length("_page") > 0), "_page")
    # The parts of a page's copies add up to one.
    counts = cut_lineage(texts.mapInArrow(_count_words, "word string, n double").groupBy("word").agg(F.round(F.sum("n")).cast("long").alias("n")))
    found = counts.mapInArrow(_read_words, "word string, n long, reading string, at int, proven boolean")
    known = counts.select(F.col("word").alias("reading"), F.col("word").alias("original"), F.col("n").alias("n_original"))
    folds = known.where(F.length("original") > TRIED_SIGNS).where(~F.col("original").rlike(f"[{re.escape(''.join(AS_LETTERS))}]"))
    known = known.unionByName(folds.withColumn("reading", F.concat(F.lit(_FOLD_MARK), F.translate(F.lower("original"), *_FOLDED))))
    digits = F.col("original").rlike("^[0-9]+(ml|mg|kg|g|mm|h)?$")
    n = F.coalesce("n_original", F.lit(0))
    met = found.join(known, "reading", "left").withColumn("original", F.coalesce("original", "reading"))
    kept = met.where(F.when(digits, n >= F.col("n") - 1).when(F.col("at") < 0, n >= MIN_PAGES).otherwise(F.col("proven") | ((n >= MIN_PAGES) & (n >= TIMES * F.col("n")))))
    best = F.max_by(F.struct("original", "at"), F.struct(F.col("at") < 0, n, F.col("original"))).alias("best")
    return kept.groupBy("word").agg(best).where("best.at >= 0").select("word", "best.original", "best.at")


LINES = T.StructType([T.StructField("doc", T.LongType()), *(T.StructField(c, T.IntegerType()) for c in ("page", "line")), T.StructField("noise", T.StringType()), T.StructField("word", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("next_page", "next_line", "cut"))])


def _observed(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str | None], tuple[np.ndarray, np.ndarray]]]:
    """(doc, pages, observations) of the rows of `observed_documents`."""
    for doc, pages, codes, lines in zip(*(batch.column(c).to_pylist() for c in ("_doc", "_pages", "_codes", "_lines"))):
        yield doc, pages or [], (unpacked([codes], len(WIDTHS))[0], np.array(lines, np.int64))


def _scan_lines(model: LineModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, pages, observed in _observed(batch):
                labels = line_labels(pages, model, observed)
                rows += [(doc, p + 1, i + 1, "furniture", None, None, None, None) for p, states in enumerate(labels) for i, s in enumerate(states) if s in (HEAD, FOOT)]
                broken = broken_lines(pages, labels)
                rows += [(doc, p + 1, i + 1, "broken_word", None, None, None, None) for p, i, _, _ in broken]
                rows += [(doc, p + 1, i + 1, "misread", None, None, None, None) for p, (text, states) in enumerate(zip(pages, labels)) for i, line in enumerate((text or "").split("\n")) if states[i] == BODY and _DECIMAL.search(line)]
                rows += [(doc, p + 1, i + 1, None, w, q + 1, j + 1, cut) for p, i, w, q, j, cut in set(body_tokens(pages, labels, broken))]
            cols = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=LINES.names)

    return run


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [observations(texts or ()) for texts in batch.column("_pages").to_pylist()]
        codes, lines = pa.array([packed(c) for c, _ in made], pa.binary()), pa.array([n.tolist() for _, n in made], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("_doc"), batch.column("_pages"), codes, lines], names=["_doc", "_pages", "_codes", "_lines"])


def observed_documents(docs: DataFrame, doc: str, pages: str, scanned: DataFrame) -> DataFrame:
    """_doc, _pages, the packed codes of their lines and how many lines each page has, of the documents that `scanned` names."""
    ids = cut_lineage(scanned.select(scanned[doc].cast("long").alias("_doc")).where("_doc IS NOT NULL").distinct())
    chosen = docs.select(docs[doc].cast("long").alias("_doc"), docs[pages].alias("_pages"))
    chosen = chosen.join(small_side(ids, [], BROADCAST_ROWS), "_doc", "left_semi")
    return cut_lineage(chosen.mapInArrow(_observe, "_doc long, _pages array<string>, _codes binary, _lines array<int>"))


def scan_noise(docs: DataFrame, doc: str, pages: str, scanned: DataFrame) -> DataFrame:
    """doc, page, line (from 1) and noise of the lines of scanned documents.

    `scanned` names the documents by its column `doc`; word counts come from all of
    `docs`. noise is furniture, broken_word or misread; a line has a row for each
    that holds. Null page arrays and null pages have no lines. Repeated documents come out once.
    """
    chosen = observed_documents(docs, doc, pages, scanned)
    lines = chosen.mapInArrow(_scan_lines(trained(first_model(), chosen, "_codes", ROUNDS, WEIGHT, "_lines")), LINES)
    words = cut_lineage(misread_words(docs, pages))
    # One pass over the lines: labels go through the join as they are, tokens are kept where they meet a misreading.
    joined = lines.join(small_side(words, ["word", "original"], BROADCAST_ROWS), "word", "left").where("noise IS NOT NULL OR at IS NOT NULL")
    later = F.coalesce((F.col("cut") >= 0) & (F.col("at") >= F.col("cut")), F.lit(False))
    place = lambda c: F.when(later, F.col(f"next_{c}")).otherwise(F.col(c)).alias(c)
    return joined.select("doc", place("page"), place("line"), F.coalesce("noise", F.lit("misread")).alias("noise")).distinct()


def continuous_text(docs: DataFrame, doc: str, pages: str, scanned: DataFrame) -> DataFrame:
    """doc, paragraph_no (from 1) and text of scanned documents: body lines alone, cut words joined, misread words put right.

    A blank line ends a paragraph, a page end does not; a document without body lines has no row.
    """
    chosen = observed_documents(docs, doc, pages, scanned).dropDuplicates(["_doc"])
    model = trained(first_model(), chosen, "_codes", ROUNDS, WEIGHT, "_lines")
    words = cut_lineage(misread_words(docs, pages))
    tokens = chosen.mapInArrow(_scan_lines(model), LINES).where("word IS NOT NULL").select("doc", "word").distinct()
    fixes = tokens.join(small_side(words, ["word", "original"], BROADCAST_ROWS), "word").groupBy(F.col("doc").alias("_doc")).agg(F.map_from_entries(F.collect_list(F.struct("word", "original"))).alias("_fixes"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for (key, text, observed), fixed in zip(_observed(batch), batch.column("_fixes").to_pylist()):
                rows += [(key, k + 1, t) for k, t in enumerate(paragraphs(text, model, dict(fixed or ()), observed))]
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.string()))], names=["doc", "paragraph_no", "text"])

    return chosen.join(fixes, "_doc", "left").mapInArrow(assemble, "doc long, paragraph_no int, text string")


def paragraphs(pages: Sequence[str | None], model: LineModel, originals: dict[str, str], observed: tuple[np.ndarray, np.ndarray] | None = None) -> list[str]:
    """The paragraphs of a document, repaired."""
    labels = line_labels(pages, model, observed)
    broken = {(p, i) for p, i, _, _ in broken_lines(pages, labels)}
    made, line_open, last = [], False, None
    for p, (text, states) in enumerate(zip(pages, labels)):
        for i, line in enumerate((text or "").split("\n")):
            if states[i] == BREAK and last == p:
                line_open = False
            if states[i] != BODY:
                continue
            line = line.strip()
            if line_open and made:
                dense = re.search("[\u3040-\u30ff\u3400-\u9fff\u0e00-\u0e7f]$", made[-1]) and re.match("[\u3040-\u30ff\u3400-\u9fff\u0e00-\u0e7f、。，．]", line)
                made[-1] += line if made[-1].endswith("\0") or dense else " " + line
                made[-1] = made[-1].replace("\0", "")
            else:
                made.append(line)
            if (p, i) in broken:
                made[-1] = made[-1][:-1] + "\0"
            line_open, last = True, p
    plain = lambda m: originals.get(m.group(), m.group())
    return [_TOKEN.sub(lambda m: originals.get(m.group()) or _PLAIN.sub(plain, m.group()), t.replace("\0", "")) for t in made]
