"""Text that went through a wrong decoding, found and put right by the garbled forms of clean words.

A first pass over the pages counts the corpus's units that hold other than ASCII characters: words, their
runs of such characters, in scripts without spaces pairs of characters. The garbled forms of
every clean unit under every chain of encodings are a table. A second pass cuts the pages' own tokens -
words, runs, and windows as long as the forms of pairs - and those that a bounded filter of the
table lets pass are hash-joined with it. What stands on fewer page texts than its original is
garbled, and the original its word. Lost characters (U+FFFD) and printed codes prove themselves.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.checkpoints import cut_lineage
from leafmill.llm.copies import small_side, with_copies
from leafmill.llm.filters import Filter, filter_of
from leafmill.llm.shared_spans import WindowHash, code_points

#: Verified tokens up to which they are broadcast to the pages (small_side bounds their bytes); beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000
#: Different page texts that a word must be on: its form is on one at least, and must be on fewer.
MIN_TEXTS = 2
#: Characters of pages that are worked on together.
AT_ONCE = 1_000_000


def _sloppy(name: str) -> tuple[dict[int, int], str]:
    """A single-byte charset as (code point to byte, characters by byte), undefined bytes as C1 controls."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return {ord(c): b for b, c in enumerate(chars)}, "".join(chars)


# Single-byte charsets that text is wrongly read in, and the chains of (written in, read in).
SINGLE = {n: _sloppy(n) for n in ("latin-1", "cp1252", "cp437", "cp850", "mac_roman", "cp1251", "koi8-r", "cp874", "iso8859-2", "cp1250", "iso8859-15", "cp1253", "cp1254", "cp866")}
UTF8_READ_AS = ("latin-1", "cp1252", "cp437", "cp850", "mac_roman", "cp1251", "koi8-r", "cp1250", "cp1253", "cp866", "iso8859-15")
TWICE_READ_AS = ("latin-1", "cp1252")
UTF8_READ_AS_WIDE = ("gbk", "cp932", "big5", "cp949")
WIDE_READ_AS = (("cp932", "latin-1"), ("cp932", "cp1252"), ("euc_jp", "latin-1"), ("euc_jp", "cp1252"), ("gbk", "latin-1"), ("gbk", "cp1252"), ("big5", "latin-1"), ("big5", "cp1252"), ("cp874", "latin-1"), ("cp874", "cp1252"))
WIDE_READ_AS_WIDE = (("euc_jp", "cp932"), ("cp932", "euc_jp"), ("gbk", "big5"), ("big5", "gbk"), ("gbk", "cp932"), ("euc_jp", "gbk"), ("cp932", "gbk"))
NARROW_READ_AS = (
    ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp1251", "latin-1"), ("cp1251", "cp1252"), ("koi8-r", "latin-1"), ("koi8-r", "cp1252"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1251", "mac_roman"),
    ("cp1252", "cp1251"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp437"), ("cp437", "cp1252"), ("cp1252", "cp850"), ("cp850", "cp1252"), ("cp1252", "iso8859-2"), ("cp1252", "cp1253"), ("cp1252", "koi8-r"), ("cp1252", "cp1250"),
)
#: Every chain: the steps of (written in, read in), in turn.
CHAINS: list[tuple[tuple[str, str], ...]] = [
    *((("utf-8", n),) for n in (*UTF8_READ_AS, *UTF8_READ_AS_WIDE)),
    *((("utf-8", a), ("utf-8", b)) for a in TWICE_READ_AS for b in TWICE_READ_AS),
    *((step,) for step in (*WIDE_READ_AS, *WIDE_READ_AS_WIDE, *NARROW_READ_AS)),
]

_UTF8_RUN = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2})+")
#: Scripts whose words aren't spaced apart, or are long: their unit is the pair of characters.
DENSE = "฀-๿々-ヿ㐀-鿿가-힣"
_DENSE_RUN = re.compile(f"[{DENSE}　-〄＀-＠]+")
_WORD = re.compile("[A-Za-z]*[^\x00-\x7f][A-Za-z\x80-\U0010ffff]*")
_RUN = re.compile("[^\x00-\x7f]+")
_ANY_HIGH = re.compile("[" + re.escape("".join(sorted({c for n in UTF8_READ_AS for c in SINGLE[n][1][128:]}))) + "]{2,}")
_LATIN_HIGH = re.compile("[" + re.escape("".join(sorted({c for n in ("latin-1", "cp1252") for c in SINGLE[n][1][128:]}))) + "]{4,}")
_WIDE_CHARS = re.compile("[\u3100-\u312f\uff61-\uff9f\u3400-\u9fff\uac00-\ud7a3]")
_WIDE_RUN = re.compile("[\u3000-\u30ff\u3100-\u312f\u2500-\u266f\u0391-\u0451\u3400-\u9fff\uac00-\ud7a3\ue000-\ufaff\uff01-\uffef\u2010-\u2312\xa2-\xf7A-Za-z0-9 .,%()/-]{2,}")
# What every text of these languages is full of.
_HIRAGANA = re.compile("[\u3041-\u3096]")
_COMMON_HAN = re.compile("[的了在是和不有的，。]")
_SJIS_SIGNS = re.compile("[\x81-\x83‚ƒ]")
_SJIS = {n: re.compile("(?:[%s][%s]){3,}" % tuple("".join(re.escape(SINGLE[n][1][b]) for b in bs) for bs in ([*range(0x81, 0xA0), *range(0xE0, 0xFD)], [*range(0x40, 0x7F), *range(0x80, 0xFD)]))) for n in ("latin-1", "cp1252")}
_UTF8_STEPS = {("utf-8", n) for n in UTF8_READ_AS}
_CODES = re.compile(r"(?:\\x[0-9a-fA-F]{2})+|(?:\\u[0-9a-fA-F]{4})+|(?:\\U[0-9a-fA-F]{8})+")
_LOST = "�"


def _to_bytes(text: str, name: str) -> bytes | None:
    try:
        return codecs.charmap_encode(text, "strict", SINGLE[name][0])[0]
    except UnicodeEncodeError:
        return None


def _read(raw: bytes, name: str) -> str:
    return codecs.charmap_decode(raw, "strict", SINGLE[name][1])[0] if name in SINGLE else raw.decode(name, "replace")


def garble(word: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """What the word becomes under the chain; None where it can't be written or stays as it is."""
    made = word
    for source, target in chain:
        raw = made.encode("utf-8", "replace") if source == "utf-8" else _written(made, source)
        if raw is None:
            return None
        made = _read(raw, target)
    return None if made == word or made.isascii() else made


def _written(word: str, name: str) -> bytes | None:
    if name in SINGLE:
        return _to_bytes(word, name)
    try:
        return word.encode(name)
    except UnicodeEncodeError:
        return None


def printed_codes(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, original) of runs of printed byte or character codes that stand for other than ASCII characters."""
    for m in _CODES.finditer(text) if "\\" in text else ():
        token = m.group()
        kind = token[1]
        if kind == "x":
            raw = bytes.fromhex(token.replace("\\x", ""))
            try:
                made = raw.decode()
            except UnicodeDecodeError:
                made = raw.decode("cp1252", "replace")
        else:
            points = [int(p, 16) for p in token.split(f"\\{kind}")[1:]]
            made = "".join(chr(p) if p < 0x110000 else _LOST for p in points).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        if not made.isascii():
            yield m.start(), m.end(), made


def page_words(text: str) -> set[str]:
    """The distinct units of a page that hold other than ASCII characters: words, their runs of such characters, pairs in dense scripts."""
    units: set[str] = set()
    for run in _DENSE_RUN.findall(text):
        units.update(map(str.__add__, run, run[1:]))
    for word in _WORD.findall(text):
        if not _DENSE_RUN.search(word):
            units.add(word)
            units.update(_RUN.findall(word))
    return units


def _put_right(raw: bytes, name: str, first: str | None) -> tuple[str, int]:
    """Bytes read as `name` with their UTF-8 runs decoded, twice if they had been read as `first` before, and how many such runs."""
    out, at, n = [], 0, 0
    for m in _UTF8_RUN.finditer(raw):
        made = m.group().decode("utf-8", "replace")
        if first:
            inner = _to_bytes(made, first)
            if inner is None:
                continue
            made, k = _put_right(inner, first, None)
            if not k:
                continue
        out += [_read(raw[at : m.start()], name), made]
        at, n = m.end(), n + 1
    return "".join(out) + _read(raw[at:], name), n


def _normal_case(word: str) -> bool:
    letters = "".join(filter(str.isalpha, word))
    return bool(letters) and (letters.islower() or letters.isupper() or letters[1:].islower() or letters.istitle())


@lru_cache(200_000)
def _utf8_readings(run: str) -> tuple[tuple[tuple[tuple[str, str], ...], str], ...]:
    """(chain, original) of a run that holds UTF-8 read in a single-byte charset."""
    found = []
    for name in UTF8_READ_AS:
        raw = _to_bytes(run, name)
        if raw is None or not _UTF8_RUN.search(raw):
            continue
        for first in (None, *TWICE_READ_AS) if name in TWICE_READ_AS else (None,):
            made, n = _put_right(raw, name, first)
            if n:
                found.append(((*((("utf-8", first),) if first else ()), ("utf-8", name)), made))
    return tuple(found)


def _readable(made: str, source: str) -> bool:
    """Whether a stretch could be text of a wide charset's language: enough hiragana, or enough of the commonest signs of Chinese."""
    own = _HIRAGANA if source in ("cp932", "euc_jp") else _COMMON_HAN
    return _LOST not in made and len(own.findall(made)) * 8 >= len(made)


def stretches(text: str) -> Iterator[tuple[int, int, str, tuple[tuple[str, str], ...]]]:
    """(start, end, original, chain) of every stretch that a chain could have made of another text."""
    for m in _ANY_HIGH.finditer(text):
        for chain, made in _utf8_readings(m.group()):
            yield m.start(), m.end(), made, chain
    for m in _LATIN_HIGH.finditer(text):
        for source, name in WIDE_READ_AS:
            if source != "cp932" and (raw := _to_bytes(m.group(), name)):
                yield m.start(), m.end(), _read(raw, source), ((source, name),)
    if _SJIS_SIGNS.search(text):
        for name, pattern in _SJIS.items():
            for m in pattern.finditer(text):
                yield m.start(), m.end(), _read(_to_bytes(m.group(), name) or b"", "cp932"), (("cp932", name),)
    for m in _WIDE_RUN.finditer(text) if _WIDE_CHARS.search(text) else ():
        run = m.group()
        if run.isascii():
            continue
        for name in UTF8_READ_AS_WIDE:
            raw = run.encode(name, "ignore")
            if any(len(part) >= 6 for part in _UTF8_RUN.findall(raw)):
                yield m.start(), m.end(), raw.decode("utf-8", "replace"), (("utf-8", name),)
        for source, name in WIDE_READ_AS_WIDE:
            raw = run.encode(name, "ignore")
            if len(raw) > len(run) and _readable(made := raw.decode(source, "ignore"), source):
                yield m.start(), m.end(), made, ((source, name),)


def restored(text: str, known: set[tuple[str, str]]) -> tuple[str, int]:
    """The text with its verified tokens put back, and the number of places: first whole words and runs, then stretches of dense scripts of which a third of the pairs is verified, then other tokens, the longest first."""
    originals = {original for _, original in known}
    whole, count = dict(sorted(known)), 0

    def put(m: re.Match[str]) -> str:
        nonlocal count
        count += m.group() in whole
        return whole.get(m.group(), m.group())

    text = _RUN.sub(put, _WORD.sub(put, text)) if whole else text
    n, best = count, {}
    for start, end, made, chain in stretches(text) if originals else ():
        pairs = {p for run in _DENSE_RUN.findall(made) for p in map(str.__add__, run, run[1:])}
        score = len(pairs & originals)
        if score * 3 >= len(pairs) > 0 and score > best.get(start, (0,))[0]:
            best[start] = (score, end, made)
    out, at = [], 0
    for start, (_, end, made) in sorted(best.items()):
        if start >= at:
            out += [text[at:start], made]
            at, n = end, n + 1
    text = "".join(out) + text[at:]
    for form, original in sorted(known, key=lambda f: (-len(f[0]), f)):
        if form in text:
            n += text.count(form)
            text = text.replace(form, original)
    codes = list(printed_codes(text))
    for a, b, made in reversed(codes):
        text = text[:a] + made + text[b:]
    return text, n + len(codes)


WORDS_AT_ONCE = 300_000


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(original, texts) of the pages' units, in parts; each of several copies of a page weighs its part of one."""
    words: Counter[str] = Counter()

    def counted() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.float64())], names=["original", "texts"])

    for batch in batches:
        for text, copies in zip(batch.column("_text").to_pylist(), batch.column("_copies").to_pylist()):
            if text.isascii():
                continue
            units = page_words(text.encode("utf-8", "replace").decode())
            if copies is None:
                words.update(units)
            else:
                for unit in units:
                    words[unit] += 1 / copies
        if len(words) > WORDS_AT_ONCE:
            yield counted()
            words.clear()
    if words:
        yield counted()


WORD, RUN, PAIR = range(3)
_UTF8_CHAINS = [k for k, chain in enumerate(CHAINS) if chain[0][0] == "utf-8"]
_NARROW_CHAINS = [k for k, chain in enumerate(CHAINS) if chain[0] in NARROW_READ_AS]
_PAIR_CHAINS = [k for k, chain in enumerate(CHAINS) if chain[0] not in NARROW_READ_AS]
_ONE_DENSE_PAIR = re.compile(f"[{DENSE}]{{2}}")


def chains_of(unit: str) -> list[tuple[int, int]]:
    """(kind of token, chain) under which the forms of a unit are looked for: those of words everywhere, of runs within a word under UTF-8, of pairs within dense stretches."""
    if _ONE_DENSE_PAIR.fullmatch(unit) or _DENSE_RUN.fullmatch(unit):
        return [(PAIR, k) for k in _PAIR_CHAINS] if len(unit) == 2 else []
    if _RUN.fullmatch(unit) and len(unit) == 1:
        return [(RUN, k) for k in _UTF8_CHAINS]
    found = [(WORD, k) for k in (*_UTF8_CHAINS, *_NARROW_CHAINS)]
    return found + [(RUN, k) for k in _UTF8_CHAINS] if _RUN.fullmatch(unit) else found


#: Bytes that a unit's characters must have for their being UTF-8 not to be chance.
EVIDENT_BYTES = 6


def is_clean(unit: str) -> bool:
    """Whether a unit isn't, as a whole, UTF-8 that was read in a single-byte charset; of shorter ones the count of texts decides."""
    high = "".join(_RUN.findall(unit))
    for name in UTF8_READ_AS if len(high) >= EVIDENT_BYTES else ():
        raw = _to_bytes(high, name)
        if raw is not None and _UTF8_RUN.fullmatch(raw):
            return False
    return True


FORMS = T.StructType([T.StructField("form", T.StringType()), T.StructField("h", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("chain", T.IntegerType()), T.StructField("original", T.StringType()), T.StructField("texts", T.DoubleType())])


def hashes_of(strings: list[str], hasher: WindowHash, kinds: np.ndarray) -> np.ndarray:
    """64-bit hashes of strings, pairs apart from words and runs."""
    points, sizes = code_points("".join(strings)), np.array([len(s) for s in strings], np.int64)
    return hasher.at(points, np.cumsum(sizes) - sizes, sizes) ^ (kinds == PAIR).astype(np.uint64)


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every clean unit under every chain that its tokens are looked for by; a form that is its unit's under several chains has a row for each."""
    hasher = WindowHash(0)
    for batch in batches:
        forms, kinds, chains, at = [], [], [], []
        for i, word in enumerate(batch.column("original").to_pylist()):
            made: dict[int, str | None] = {}
            for kind, k in chains_of(word) if is_clean(word) else ():
                if k not in made:
                    made[k] = garble(word, CHAINS[k])
                form = made[k]
                if form and _LOST not in form and (kind == PAIR or _WORD.fullmatch(form)):
                    forms.append(form)
                    kinds.append(kind)
                    chains.append(k)
                    at.append(i)
        rows, kind = pa.array(at, pa.int64()), np.array(kinds, np.int32)
        hashed = hashes_of(forms, hasher, kind).view(np.int64) if forms else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(forms, pa.string()), pa.array(hashed), pa.array(kind), pa.array(chains, pa.int32()), batch.column("original").take(rows), batch.column("texts").take(rows)], names=FORMS.names)


TOKENS = T.StructType([T.StructField("doc", T.LongType()), T.StructField("page", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("form", T.StringType()), T.StructField("weight", T.DoubleType())])


def _windows(points: np.ndarray, hasher: WindowHash, known: Filter, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(starts, length) of the windows that may be forms of pairs; short ones count only where they overlap each other."""
    near = lengths[np.minimum(points, len(lengths) - 1)]
    for length in range(1, 32):
        starts = np.flatnonzero((near >> np.uint32(length)) & 1)
        starts = starts[starts + length <= len(points)]
        if not len(starts):
            continue
        starts = starts[known.has(hasher.at(points, starts, length) ^ np.uint64(1))]
        if length < EVIDENT and len(starts):
            close = np.diff(starts) < length
            starts = starts[np.append(close, False) | np.append(False, close)]
        if len(starts):
            yield starts, length


def _tokens(known: Broadcast, lengths: np.ndarray):
    """The pages' own tokens that the filter of forms lets pass, and (doc, page) of pages that prove themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, forms = WindowHash(0), known.value

        def looked_up(pages: list[tuple[int, int, str, float]]) -> pa.RecordBatch:
            whole = "\n".join(text for _, _, text, _ in pages)
            begins = np.cumsum([0] + [len(text) + 1 for _, _, text, _ in pages])[:-1]
            points, at, ends, kinds = code_points(whole), [], [], []
            for kind, pattern in ((WORD, _WORD), (RUN, _RUN)):
                places = [m.span() for m in pattern.finditer(whole)]
                if places:
                    a, b = np.array(places).T
                    passed = forms.has(hasher.at(points, a, b - a))
                    at.append(a[passed])
                    ends.append(b[passed])
                    kinds.append(np.full(int(passed.sum()), kind))
            for starts, length in _windows(points, hasher, forms, lengths):
                at.append(starts)
                ends.append(starts + length)
                kinds.append(np.full(len(starts), PAIR))
            a, b, kind = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, ends, kinds))
            page = np.searchsorted(begins, a, "right") - 1
            cols = list(zip(*((pages[p][0], pages[p][1], i - o, k, whole[i:j], pages[p][3]) for p, i, j, k, o in zip(page.tolist(), a.tolist(), b.tolist(), kind.tolist(), begins[page].tolist())))) or [()] * 6
            return rows_of(cols)

        def rows_of(cols: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64()))], names=TOKENS.names)

        held, size = [], 0
        for batch in batches:
            sure = []
            for doc, page, text, copies in zip(*(batch.column(n).to_pylist() for n in ("_doc", "_page", "_text", "_copies"))):
                if _LOST in text or any(True for _ in printed_codes(text)):
                    sure.append((doc, page, None, None, None, None))
                if not text.isascii():
                    held.append((doc, page, text.encode("utf-8", "replace").decode(), 1.0 / (copies or 1)))
                    size += len(text)
                if size >= AT_ONCE:
                    yield looked_up(held)
                    held, size = [], 0
            if sure:
                yield rows_of(list(zip(*sure)))
        if held:
            yield looked_up(held)

    return run


#: Length of a window from which on it proves a pair alone; of shorter ones, three characters and more must follow on each other, of pairs of characters four.
EVIDENT = 5


def garbled_tokens(df: DataFrame, doc: str, page: str, text: str, min_texts: int = MIN_TEXTS) -> DataFrame:
    """Verified garbled places: doc, page (as long and int), form, original.

    A row for each distinct token of a page that is a garbled form of a word
    standing on `min_texts` different page texts or more, and on more of them than the form itself,
    so that copies of one page can't outvote other pages; a row with null form and original for a page with lost characters or printed codes.
    Null and empty texts give no row. Vocabulary, forms and tokens are tables of
    the cluster; a filter of bounded size goes to every task, and verified tokens are broadcast up to BROADCAST_ROWS. Rows of one page are one page.
    """
    pages = df.select(df[doc].cast("long").alias("_doc"), df[page].cast("int").alias("_page"), df[text].alias("_text")).where(F.length("_text") > 0)
    pages = with_copies(pages, "_text")
    units = pages.mapInArrow(_count_units, "original string, texts double").groupBy("original").agg(F.round(F.sum("texts")).alias("texts"))
    forms = cut_lineage(units.where(F.col("texts") >= min_texts).mapInArrow(_forms, FORMS))
    # At most a row for each character: the lengths, as bits, of the forms of pairs that begin with it.
    pairs = forms.where(f"kind = {PAIR} AND length(form) < 32").groupBy(F.ascii("form").alias("c")).agg(F.expr("bit_or(shiftleft(1L, length(form)))").alias("bits"))
    lengths = np.zeros(0x110000, np.uint32)
    for row in pairs.collect():
        lengths[row["c"]] = row["bits"]
    known = df.sparkSession.sparkContext.broadcast(filter_of(forms, "h", forms.count()))
    tokens = cut_lineage(pages.mapInArrow(_tokens(known, lengths), TOKENS))
    cut = tokens.where("form IS NOT NULL")
    # The distinct tokens, merged in each task first, meet the table; then the verified ones go back to their places.
    distinct = cut.groupBy("doc", "page", "kind", "form").agg(F.max("weight").alias("weight")).groupBy("kind", "form").agg(F.round(F.sum("weight")).alias("texts_form"))
    verified = distinct.join(forms.select("form", "kind", "chain", "original", "texts"), ["kind", "form"]).where("texts > texts_form")
    narrow = F.col("chain").isin(_NARROW_CHAINS)
    normal = F.regexp_replace("original", r"[^\p{L}]", "").rlike(r"^(?:\p{Ll}+|\p{Lu}+|.\p{Ll}+)$")
    verified = verified.where(~narrow | ((F.length("form") > 1) & normal))
    # A word or run has one original, that on most texts; a pair may be another's in each chain.
    best = F.max_by(F.struct("chain", "original"), F.struct("texts", "original")).alias("best")
    words = verified.where(f"kind <> {PAIR}").groupBy("kind", "form").agg(best).select("kind", "form", "best.chain", "best.original")
    verified = cut_lineage(words.unionByName(verified.where(f"kind = {PAIR}").select("kind", "form", "chain", "original").distinct()))
    met = cut.join(small_side(verified, ["form", "original"], BROADCAST_ROWS), ["kind", "form"])
    alone = met.where(f"kind <> {PAIR} OR length(form) >= {EVIDENT}")
    # Short windows: where enough of one chain overlap, the chain is proven for its page, and all its windows count.
    stretch = Window.partitionBy("doc", "page", "chain").orderBy("at")
    short = met.where(f"kind = {PAIR} AND length(form) < {EVIDENT}").withColumn("_far", F.when(F.col("at") - F.lag("at").over(stretch) < F.length("form"), 0).otherwise(1))
    short = short.withColumn("_island", F.sum("_far").over(stretch.rowsBetween(Window.unboundedPreceding, 0)))
    least = F.when(F.length("form") > 2, 2).otherwise(3)
    short = short.withColumn("_proven", F.count("*").over(Window.partitionBy("doc", "page", "chain", "_island")) >= least)
    short = short.withColumn("_proven", F.max("_proven").over(Window.partitionBy("doc", "page", "chain"))).where("_proven")
    hits = alone.select("doc", "page", "form", "original").unionByName(short.select("doc", "page", "form", "original")).distinct()
    sure = tokens.where("form IS NULL").select("doc", "page", "form", F.lit(None).cast("string").alias("original")).distinct()
    return hits.unionByName(sure)


def put_right(df: DataFrame, doc: str, page: str, text: str, min_texts: int = MIN_TEXTS) -> DataFrame:
    """Every page in its original characters, as far as they are known: doc, page, text, n_restored.

    n_restored counts the places put back. Lost characters stay as they are. Pages of a null text keep it.
    """
    tokens = garbled_tokens(df, doc, page, text, min_texts).where("form IS NOT NULL")
    fixes = tokens.groupBy(F.col("doc").alias("_doc"), F.col("page").alias("_page")).agg(F.collect_list(F.struct("form", "original")).alias("_fixes"))
    pages = df.select(df[doc].cast("long").alias("_doc"), df[page].cast("int").alias("_page"), df[text].alias("_text"))

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = ({(f["form"], f["original"]) for f in fixes or ()} for fixes in batch.column("_fixes").to_pylist())
            made = [(t, 0) if t is None else restored(t, k) for t, k in zip(batch.column("_text").to_pylist(), known)]
            texts, counts = [t for t, _ in made], [n for _, n in made]
            yield pa.RecordBatch.from_arrays([batch.column("_doc"), batch.column("_page"), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=["doc", "page", "text", "n_restored"])

    return pages.join(fixes, ["_doc", "_page"], "left").mapInArrow(restore, "doc long, page int, text string, n_restored long")
