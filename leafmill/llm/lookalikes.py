"""Texts that look the same brought to the same characters.

The vocabulary is held in a trie that a weighted edit automaton walks over a text. Replacing a
character by one drawn alike, by its other width or by another kind of blank, and leaving
out an ignorable, weigh nothing; what is drawn nearly alike weighs NEAR, any other
edit EDIT. The walk keeps the least weight of every node it can be in and drops what weighs more
than the bound. Edits that weigh nothing are done for the whole text beforehand, character by character; what
is left of the text is its class image.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from leafmill.functions.columns import keyed

# Letters drawn like a Latin letter, by script.
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ", "ABEZHIKMNOPTYXocj"))
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТХҮԚԜаеорсухѕіјһԛԝԁ", "ABESIJKMHOPCTXYQWaeopcyxsijhqwd"))
ARMENIAN_AND_OTHER = dict(zip("ՕՍօսԱΙӀꓐꓑꓒꓓᎪᎬᎻᎫᏦᎷᏢᎡᎢᏴᏃ", "OUouUIIBPdDAEHJKMPRTBZ"))
# Ideographs and hiragana drawn like a katakana.
IDEOGRAPHS = dict(zip("力夕口二卜工八へ", "カタロニトエハヘ"))
LATIN = GREEK | CYRILLIC | ARMENIAN_AND_OTHER
DRAWN_ALIKE = LATIN | IDEOGRAPHS
# Letters, digits and parts of words drawn nearly alike, within a script too.
NEAR_GROUPS = ("Il1|", "O0", "S5", "Z2", "B8")
NEAR_PARTS = (("rn", "m"), ("cl", "d"), ("vv", "w"), ("VV", "W"))
#: The weights of what is nearly alike and of any other edit.
NEAR, EDIT = 0.5, 1.0
# Other characters of one look.
HYPHENS = "‐‑﹣"
IGNORABLE = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩︀︁︂︃︄︅︆︇︈︉︊︋︌︍︎️﻿"
BLANKS = "               　"

_WIDTH = {c: unicodedata.normalize("NFKC", chr(c)) for c in [*range(0xFF01, 0xFFBF), *range(0xFFE0, 0xFFE7)] if unicodedata.category(chr(c)) != "Cn"}
_WIDTH |= {0xFF9E: "\u3099", 0xFF9F: "\u309a"}
#: Roman numerals, drawn as the letters they consist of.
_WIDTH |= {c: unicodedata.normalize("NFKC", chr(c)) for c in range(0x2160, 0x2180)}
#: Radicals, drawn as the ideographs they are named after.
_WIDTH |= {c: unicodedata.normalize("NFKC", chr(c)) for c in range(0x2E80, 0x2FD6) if unicodedata.category(chr(c)) != "Cn"}
#: One character to its class, for decomposed text.
CLASSES: dict[int, str | None] = {
    **{ord(c): ord(d) for c, d in DRAWN_ALIKE.items()},
    **{c: unicodedata.normalize("NFD", to) for c, to in _WIDTH.items()},
    **dict.fromkeys(map(ord, HYPHENS), "-"),
    **dict.fromkeys(map(ord, BLANKS), " "),
    **dict.fromkeys(map(ord, IGNORABLE)),
}
#: Width forms, blanks and hyphens alone: what normalizes a character whatever stands around it.
PLAIN = {c: to for c, to in CLASSES.items() if chr(c) not in DRAWN_ALIKE and chr(c) not in "\u200c\u200d"}
_EDGES = " \t\n\r\f\v" + BLANKS + IGNORABLE
_WORD = re.compile(r"[^\W\d_]+")
#: Joiners do their work between letters of the scripts that join, and in emoji.
_JOINS = "؀-ۿऀ-෿☀-➿️\U0001f000-\U0001faff"
_JOINERS = re.compile(f"(?<![{_JOINS}])[‌‍]|[‌‍](?![{_JOINS}])")


def class_image(text: str) -> str:
    """The text's classes; texts look the same if their images are the same."""
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(CLASSES))


def _alike_kind(c: str) -> bool:
    """Letters and digits that would make a neighbouring term part of a longer word."""
    return c.isalnum() and not ("\u3040" <= c <= "\u30ff" or "\u3400" <= c <= "\u9fff" or "\u0e00" <= c <= "\u0e7f")


_NEAR = {c: [d for d in group if d != c] for group in NEAR_GROUPS for c in group}


def _lower(waiting: dict[int, dict[int, float]], end: int, node: int, weight: float, bound: float) -> None:
    if weight <= bound:
        nodes = waiting.setdefault(end, {})
        if weight < nodes.get(node, bound + 1):
            nodes[node] = weight


class TermTrie:
    """The canonical terms, found in texts by look: nodes with their children by character, and the image that ends in a node."""

    def __init__(self, terms: Sequence[tuple[int, str]]) -> None:
        self.ids: dict[str, list[tuple[int, str]]] = {}
        for term_id, term in terms:
            self.ids.setdefault(class_image(term).strip(), []).append((term_id, term))
        self.ids.pop("", None)
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, str] = {}
        for image in self.ids:
            node = 0
            for c in image:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                node = self.children[node][c]
            self.ends[node] = image
        # Where a term can begin: at one of the first characters, with one of the second behind it.
        pairs: dict[str, str] = {}
        for c, node in self.children[0].items():
            pairs.setdefault("" if node in self.ends else "".join(sorted(self.children[node])), []).append(c)
        ways = [f"[{re.escape(''.join(cs))}]" + (f"(?=[{re.escape(then)}])" if then else "") for then, cs in pairs.items()]
        self.begins = re.compile("|".join(ways)) if ways else None

    def walk(self, image: str, at: int, bound: float = 0.0) -> Iterator[tuple[int, str, float]]:
        """(end, image of the term, weight) of the terms that stand from `at` on, the least weight of each end."""
        if bound <= 0:
            node = 0
            for end in range(at, len(image)):
                node = self.children[node].get(image[end])
                if node is None:
                    return
                if node in self.ends:
                    yield end + 1, self.ends[node], 0.0
            return
        waiting: dict[int, dict[int, float]] = {at: {0: 0.0}}
        for end in range(at, len(image) + 1):
            active = self._inserted(waiting.pop(end, {}), bound)
            if not active and not waiting:
                return
            for node, weight in active.items():
                if node in self.ends and end > at:
                    yield end, self.ends[node], weight
                if end == len(image):
                    continue
                c, children = image[end], self.children[node]
                for d, child in children.items():
                    step = 0.0 if d == c else NEAR if d in _NEAR.get(c, ()) else EDIT
                    _lower(waiting, end + 1, child, weight + step, bound)
                _lower(waiting, end + 1, node, weight + EDIT, bound)
                for part, whole in NEAR_PARTS:
                    if whole in children and image.startswith(part, end):
                        _lower(waiting, end + len(part), children[whole], weight + NEAR, bound)
                    if c == whole and part[0] in children and part[1] in self.children[children[part[0]]]:
                        _lower(waiting, end + 1, self.children[children[part[0]]][part[1]], weight + NEAR, bound)

    def _inserted(self, active: dict[int, float], bound: float) -> dict[int, float]:
        """The nodes reached by characters that a term has more, as well."""
        todo = list(active.items())
        while todo:
            node, weight = todo.pop()
            for child in self.children[node].values() if weight + EDIT <= bound else ():
                if weight + EDIT < active.get(child, bound + 1):
                    active[child] = weight + EDIT
                    todo.append((child, weight + EDIT))
        return active

    def whole(self, text: str, bound: float = 0.0) -> list[tuple[int, str]]:
        """Terms that the text as a whole looks like."""
        image = class_image(text).strip()
        return [entry for end, term, _ in self.walk(image, 0, bound) if end == len(image) for entry in self.ids[term]]

    def _starts(self, image: str, bound: float) -> Iterator[int]:
        if bound <= 0:
            yield from (m.start() for m in self.begins.finditer(image)) if self.begins else ()
        else:
            yield from (i for i, c in enumerate(image) if not c.isspace() and not (i and _alike_kind(c) and _alike_kind(image[i - 1])))

    def spans(self, text: str, bound: float = 0.0) -> Iterator[tuple[int, int, str]]:
        """(start, end, image) of each place of the text that looks like a term, edge ignorables and odd blanks taken in; at each place the least weight first, of these the longest."""
        image = class_image(text)
        hits = []
        for a in self._starts(image, bound):
            if a and _alike_kind(image[a]) and _alike_kind(image[a - 1]):
                continue
            for b, word, weight in self.walk(image, a, bound):
                if b < len(image) and ((_alike_kind(word[-1]) and _alike_kind(image[b])) or unicodedata.combining(image[b])):
                    continue
                hits.append((a, weight, -b, word))
        if not hits:
            return
        # Where in the text each place of the image comes from; marks follow their letter.
        origin: list[int] = []
        for i, c in enumerate(text):
            origin += [i] * len(class_image(c))
        if len(origin) != len(image):
            raise AssertionError("an image is made character by character")
        origin.append(len(text))
        hits.sort()
        free = 0
        for a, _, b, word in hits:
            if a < free:
                continue
            free = -b
            start, end = origin[a], origin[-b - 1] + 1
            while start and text[start - 1] in IGNORABLE + BLANKS:
                start -= 1
            while end < len(text) and text[end] in IGNORABLE + BLANKS:
                end += 1
            yield start, end, word

    def varied(self, text: str, bound: float = 0.0) -> set[int]:
        """Ids of the terms that the text holds in other characters."""
        found = set()
        for start, end, image in self.spans(text, bound):
            found.update(term_id for term_id, term in self.ids[image] if text[start:end] != term)
        return found

    def normalized(self, text: str) -> str:
        """The text in its one form: terms in their spelling, other words in one script, the rest by table."""
        out, at = [], 0
        for start, end, image in self.spans(text):
            place = text[start:end]
            lead = " " if start and place[0] in BLANKS else ""
            tail = " " if end < len(text) and place[-1] in BLANKS and text[end] != " " else ""
            out += [plain_form(text[at:start]), lead, self.ids[image][0][1], tail]
            at = end
        out.append(plain_form(text[at:]))
        return unicodedata.normalize("NFC", "".join(out))


def _script(c: str) -> str:
    if c in GREEK or "\u0370" <= c <= "\u03ff":
        return "greek"
    if c in CYRILLIC or "\u0400" <= c <= "\u052f":
        return "cyrillic"
    return "latin" if c.isascii() or c <= "\u024f" else "other"


_BACK = {"greek": {d: c for c, d in GREEK.items()}, "cyrillic": {d: c for c, d in CYRILLIC.items()}}


def _one_script(word: re.Match[str]) -> str:
    """A word of several scripts in the one that most of its own letters, which have no twin, are of; Latin on a tie."""
    letters = word.group()
    if letters.isascii():
        return letters
    scripts = {_script(c) for c in letters}
    if len(scripts & {"latin", "greek", "cyrillic"}) < 2:
        return letters
    own = [_script(c) for c in letters if c not in DRAWN_ALIKE and (not c.isascii() or c not in _BACK["cyrillic"])]
    main = max(("latin", "cyrillic", "greek"), key=own.count)
    back = _BACK.get(main, {})
    return "".join(back.get(LATIN.get(c, c), c) if main != "latin" else LATIN.get(c, c) for c in letters)


def plain_form(text: str) -> str:
    """Width forms, blanks, ignorables and composition by table; words of mixed scripts in one."""
    if text.isascii():
        return text
    return _WORD.sub(_one_script, unicodedata.normalize("NFC", _JOINERS.sub("", text).translate(PLAIN)))


#: Terms up to which a vocabulary is shipped to every worker.
MAX_TERMS = 1_000_000


def _terms(terms: DataFrame, term_id: str, term: str) -> list[tuple[int, str]]:
    rows = terms.select(term_id, term).where(terms[term].isNotNull() & terms[term_id].isNotNull()).distinct().limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"a vocabulary of over {MAX_TERMS} terms is not a glossary")
    return sorted((r[0], r[1]) for r in rows)


_tries: dict[int, TermTrie] = {}


def _trie(terms: list[tuple[int, str]]) -> TermTrie:
    key = hash(tuple(terms))
    if key not in _tries:
        _tries.clear()
        _tries[key] = TermTrie(terms)
    return _tries[key]


def lookalike_terms(df: DataFrame, keys: Sequence[str], text: str, terms: DataFrame, term_id: str = "term_id", term: str = "term", whole: bool = True, bound: float = 0.0) -> DataFrame:
    """keys and term_id of every text that looks like a term in other characters.

    With `whole` the text as a whole has to look like the term, else any place
    of it that isn't part of a longer word. `bound` is what the edits may weigh: 0 lets those pass that can't be
    seen, more finds near terms too. Null and empty texts find nothing;
    repeated rows come out repeated. Terms of one look are all found. The
    vocabulary is a bounded table (MAX_TERMS). Other columns are left out; a key
    named term_id is passed on as `term_id_key`.
    """
    rows, names = keyed(df, keys, ["term_id"], _text=text)
    held = _terms(terms, term_id, term)
    schema = T.StructType([*(rows.schema[n] for n in names), T.StructField("term_id", T.LongType(), False)])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(held)
        for batch in batches:
            at, ids = [], []
            for i, t in enumerate(batch.column(batch.schema.get_field_index("_text")).to_pylist()):
                if t:
                    found = {k for k, term in trie.whole(t, bound) if t != term} if whole else trie.varied(t, bound)
                    at += [i] * len(found)
                    ids += found
            rows_at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)).take(rows_at) for n in names), pa.array(ids, pa.int64())], names=[*names, "term_id"])

    return rows.mapInArrow(find, schema)


def consistent_text(df: DataFrame, keys: Sequence[str], text: str, terms: DataFrame, term_id: str = "term_id", term: str = "term") -> DataFrame:
    """keys and `text` in one form, in which what looks like a term equals it (of terms of one look, that of the least id).

    A null text stays null. Blanks at both ends of a text are dropped. Repeated
    rows come out repeated; other columns are left out; a key named `text` is
    passed on as `text_key`.
    """
    rows, names = keyed(df, keys, ["text"], _text=text)
    held = _terms(terms, term_id, term)
    schema = T.StructType([*(rows.schema[n] for n in names), T.StructField("text", T.StringType())])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(held)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("_text")).to_pylist()
            made = pa.array([t if t is None else trie.normalized(t.strip(_EDGES)) for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), made], names=[*names, "text"])

    return rows.mapInArrow(rewrite, schema)
