"""Statistics of the lines of texts, for whole batches of texts at once."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

#: Kinds of characters.
NEWLINE, BLANK, TAB, LOWER, UPPER, OTHER, DENSE, MARK, DIGIT, END, COMMA, COLON, CLOSER, BULLET, SIGN, ODD = range(16)
KINDS = 16
#: Characters whose lines are worked on together.
AT_ONCE = 1_000_000
_TOP = 0x20000

# What ends a sentence, parts its members, closes a quotation, and opens an item.
ENDS = ".!?…。！？．।॥؟"
COMMAS = ",;、，；،"
CLOSERS = "\"'”’»“)]」』）】›"
BULLETS = "•‣▪◦●○■□◆·・∙*–—-"


#: What may stand behind the mark that a line ends in, three at most.
BEHIND_END = "\"'”’»“)]」』）】›[0123456789¹²³†‡*※"
#: What joins the parts of a word.
JOINERS = "’'-‐‑"
#: Classes of characters in words: none, letter, letter of a script without spaces, mark, number, joiner, blank.
NONE, LETTER, ALONE, ACCENT, NUMBER, JOINER, SPACE = range(7)


def _word_classes() -> np.ndarray:
    by_category = {"L": LETTER, "M": ACCENT, "N": NUMBER, "Z": SPACE}
    classes = np.array([by_category.get(unicodedata.category(chr(c))[0], NONE) for c in range(_TOP)], np.uint8)
    for a, b in ALONE_RANGES:
        classes[a : b + 1] = ALONE
    for chars, kind in ((JOINERS, JOINER), ("\t\n\v\f\r\x85", SPACE)):
        classes[[ord(c) for c in chars]] = kind
    return classes


# The letters of Thai, the kana and the ideographs.
ALONE_RANGES = ((0x0E01, 0x0E30), (0x0E32, 0x0E33), (0x0E40, 0x0E46), (0x3005, 0x3006), (0x3041, 0x3096), (0x309D, 0x309F), (0x30A1, 0x30FA), (0x30FC, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF))


def _kinds() -> np.ndarray:
    by_category = {"Ll": LOWER, "Lu": UPPER, "Lt": UPPER, "Lm": OTHER, "Lo": OTHER, "Mn": MARK, "Mc": MARK, "Me": MARK, "Nd": DIGIT, "Zs": BLANK, "Zl": BLANK, "Zp": BLANK}
    kinds = np.array([by_category.get(unicodedata.category(chr(c)), SIGN if c < 128 else ODD) for c in range(_TOP)], np.uint8)
    for a, b in ((0x0E00, 0x0E80), (0x3040, 0x3100), (0x3400, 0xA000)):
        part = kinds[a:b]
        part[part == OTHER] = DENSE
    for chars, kind in ((ENDS, END), (COMMAS, COMMA), (":：=", COLON), (CLOSERS, CLOSER), (BULLETS, BULLET), ("\t", TAB), ("\v\f\r\x85", BLANK), ("\n", NEWLINE)):
        kinds[[ord(c) for c in chars]] = kind
    kinds[[ord(c) for c in "“‘«„‹（「『【([{"]] = CLOSER
    return kinds


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    behind = np.zeros(_TOP, bool)
    behind[[ord(c) for c in BEHIND_END]] = True
    return _kinds(), _word_classes(), behind


def _looked_up(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind, word class and whether it may stand behind an end, of each code point; those of the further planes are ideographs, as words letters."""
    kinds, classes, behind = _tables()
    near = np.minimum(points, _TOP - 1)
    kind, word = kinds[near], classes[near]
    if (far := points >= _TOP).any():
        kind[far], word[far] = DENSE, LETTER
    return kind, word, behind[near]


def _words(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start, and which characters they hold."""
    at = np.arange(len(word))
    base = word[np.maximum.accumulate(np.where(word != ACCENT, at, 0))]  # a mark belongs to what it stands on
    spaced = base == LETTER
    joined = np.zeros(len(word), bool)
    joined[1:-1] = (word[1:-1] == JOINER) & spaced[:-2] & (word[2:] == LETTER)
    goes_on = spaced | joined
    starts = word == ALONE
    starts[0] |= word[0] == LETTER
    starts[1:] |= (word[1:] == LETTER) & ~goes_on[:-1]
    return starts, goes_on | (base == ALONE)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bins(values: np.ndarray, edges: Sequence[float]) -> np.ndarray:
    return np.searchsorted(np.asarray(edges), values, "right")


#: The statistics of a line, and how many values each has.
WIDTHS = {"length": 8, "figures": 5, "signs": 6, "strange": 5, "sentence": 4, "first": 6, "gaps": 2, "members": 4, "repeats": 4, "opened": 2, "colon": 2, "longest": 4, "flows": 2}


def _measure(text: str) -> tuple[np.ndarray, ...]:
    """(codes, solid characters, ends in a mark, begins in lower case, words, their characters, letters and numbers) of the lines of a text that ends in a line feed."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind, word, behind = _looked_up(points)
    is_line = kind == NEWLINE
    line = np.cumsum(is_line) - is_line
    n = int(is_line.sum())
    count = np.bincount(line * KINDS + kind, minlength=n * KINDS).reshape(n, KINDS)
    solid = count[:, LOWER:].sum(1)
    inside = kind > TAB
    before = np.empty(len(kind), kind.dtype)
    before[0], before[1:] = NEWLINE, kind[:-1]
    after = np.append(kind[1:], NEWLINE).astype(kind.dtype)
    starts = np.flatnonzero(inside & (before <= TAB))
    stops = np.flatnonzero(inside & (after <= TAB)) + 1
    owner, sizes = line[starts], stops - starts
    tokens = np.bincount(owner, minlength=n)
    figure = np.zeros(len(starts), bool)
    token = np.cumsum(inside & (before <= TAB)) - 1
    figure[token[kind == DIGIT]] = True
    figures = np.bincount(owner, figure, minlength=n)
    # A token's hash from its characters and their places, to tell repeated ones.
    hashed = np.zeros(0, np.uint64)
    if len(starts):
        place = np.arange(len(points)) - starts[np.maximum(token, 0)]
        parts = np.where(inside, _mixed(points.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(21))), np.uint64(0))
        hashed = np.add.reduceat(parts, starts)
    order = np.lexsort((hashed, owner))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashed[order][1:] != hashed[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][fresh], minlength=n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, owner, sizes)
    # Ends of sentences: a mark behind two letters (in scripts without spaces behind one), before a blank, a closing sign or nothing.
    letter = (kind >= LOWER) & (kind <= MARK)
    two = np.zeros(len(kind), bool)
    two[2:] = letter[1:-1] & letter[:-2]
    closed = np.zeros(len(kind), bool)
    closed[3:] = (kind[2:-1] == CLOSER) & letter[1:-2] & letter[:-3]
    wide = points >= 0x0900
    end = (kind == END) & (((two | closed) & ((after <= TAB) | (after == CLOSER) | (after == DIGIT))) | (wide & (before >= LOWER)))
    ends = np.bincount(line[end], minlength=n)
    full = np.flatnonzero(tokens > 0)
    first = np.searchsorted(owner, full, "left")
    last_stop = stops[np.searchsorted(owner, full, "right") - 1]
    at_end = np.zeros(n, bool)
    tail = last_stop - 1
    for _ in range(4):
        at_end[full] |= kind[tail] == END
        tail = np.where(behind[tail], np.maximum(tail - 1, starts[first]), tail)
    inner = ends - (at_end & (ends > 0))
    sentence = np.where(inner > 0, 3, np.where(ends > 0, 2, at_end))
    opening = np.full(n, 5)
    opening[full] = np.array([5, 5, 5, 0, 1, 1, 4, 5, 2, 5, 5, 5, 5, 3, 5, 5])[kind[starts[first]]]
    # Columns: a wide gap, a tab or a rule inside the line, or a sign many times over.
    gap = np.zeros(len(kind), bool)
    gap[1:] = (kind[1:] == BLANK) & (kind[:-1] == BLANK)
    run = np.zeros(len(kind), bool)
    run[4:] = (points[4:] == points[3:-1]) & (points[3:-1] == points[2:-2]) & (points[2:-2] == points[1:-3]) & (kind[4:] >= END)
    lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
    lo[full], hi[full] = starts[first], last_stop
    at = np.arange(len(kind))
    columns = (gap | (kind == TAB) | run | ((points == 0x7C) & (before == BLANK))) & (at > lo[np.minimum(line, n - 1)]) & (at < hi[np.minimum(line, n - 1)])
    gaps = np.bincount(line[columns], minlength=n) > 0
    # Strange neighbours: high characters below the East Asian blocks next to one of another block, or two of Latin-1; odd signs; printed codes.
    block = np.where((points >= 0x80) & (points < 0x2E80) & ((points < 0x2010) | (points > 0x203F)) & (kind != DENSE), points >> 7, 0)
    pair = (block[1:] > 0) & (block[:-1] > 0) & ((block[1:] != block[:-1]) | (block[1:] == 1))
    strange = kind == ODD
    strange[1:] |= pair
    strange[:-1] |= pair
    code = np.flatnonzero((points[:-1] == 0x5C) & ((points[1:] == 0x75) | (points[1:] == 0x78)))
    odd = np.bincount(line[strange], minlength=n) + np.bincount(line[code], np.where(points[code + 1] == 0x75, 6, 4), minlength=n)
    some, many = np.maximum(solid, 1), np.maximum(tokens, 1)
    units = np.maximum(tokens, count[:, DENSE] // 3)
    codes = np.zeros((n, len(WIDTHS)), np.uint8)
    signs = count[:, END:ODD].sum(1)
    for k, values in enumerate(
        (
            _bins(solid + count[:, DENSE], (4, 10, 20, 36, 52, 70, 100)),
            _bins(figures / many, (1e-9, 0.15, 0.34, 0.6)),
            _bins(signs / some, (1e-9, 0.03, 0.08, 0.2, 0.4)),
            _bins(odd / some, (1e-9, 0.06, 0.2, 0.5)),
            sentence,
            opening,
            gaps,
            np.where(count[:, COMMA] < 3, 0, 3 - _bins(units / (count[:, COMMA] + 1), (2.5, 4))),
            _bins(1 - distinct / many, (1e-9, 0.25, 0.5)),
            np.zeros(n),
            count[:, COLON] > 0,
            _bins(np.where(count[:, DENSE] + odd > 0, 0, longest), (16, 25, 40)),
            np.zeros(n),
        )
    ):
        codes[:, k] = values
    begun, held = _words(word)
    counted = (np.bincount(line[mask], minlength=n) for mask in (begun, held, (word >= LETTER) & (word <= NUMBER)))
    return codes, solid, at_end, opening == 0, *counted


def line_statistics(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """(codes of the lines that aren't blank, their characters other than blanks, such lines of each text, counts of each text).

    The counts are words, word_chars, solid (characters other than blanks), alnum (letters, marks
    and numbers) and ends (lines that end in a mark).
    """
    whole = "\n".join(texts) + "\n" if texts else ""
    parts, at = [], 0
    while at < len(whole):
        cut = at + AT_ONCE
        end = len(whole) if cut >= len(whole) else (whole.rfind("\n", at, cut) + 1 or whole.find("\n", cut) + 1)
        parts.append(_measure(whole[at:end]))
        at = end
    if not parts:
        nothing = np.zeros(0, np.int64)
        return np.zeros((0, len(WIDTHS)), np.uint8), nothing, nothing, dict.fromkeys(("words", "word_chars", "solid", "alnum", "ends"), nothing)
    codes, solid, marked, low, *counted = (np.concatenate(p) for p in zip(*parts))
    lines = np.array([t.count("\n") + 1 for t in texts])
    text = np.repeat(np.arange(len(texts)), lines)
    full = solid > 0
    names = list(WIDTHS)
    top = np.zeros(len(solid), bool)
    top[np.cumsum(lines) - lines] = True
    codes[:, names.index("opened")] = top | ~np.append(True, full[:-1])
    codes[:, names.index("flows")] = ~top & np.append(False, full[:-1] & ~marked[:-1]) & low
    counts = {name: np.bincount(text, c, minlength=len(texts)).astype(np.int64) for name, c in zip(("words", "word_chars", "alnum", "solid", "ends"), (*counted, solid, marked))}
    return codes[full], solid[full], np.bincount(text[full], minlength=len(texts)), counts
