import random
import unicodedata

import pytest

from leafmill.llm.lookalikes import NEAR_GROUPS, NEAR_PARTS, TermTrie, consistent_text, lookalike_terms, plain_form

TERMS = [(1, "Élixir Bápo n° 5"), (2, "Capsorin.45 H/Oral"), (3, "カタロミド水和物 5mg"), (4, "Парсан Зорский"), (5, "Élixir Bápo n° 55"), (6, "Xylol 5 mg")]
TRIE = TermTrie(TERMS)


@pytest.mark.parametrize(
    "text, ids",
    [
        ("Élixir Bápo n° 5", {1}),
        (unicodedata.normalize("NFD", "Élixir Bápo n° 5"), {1}),
        ("​Élixir　Bá\xadpo n°\xa0５ ", {1}),
        ("Сарѕοrіn.45 Η/Оral", {2}),
        ("Ｃａｐｓｏｒｉｎ．４５ Ｈ／Ｏｒａｌ", {2}),
        ("力夕口ﾐﾄﾞ水和物 5mg", {3}),
        ("Пaрcан Зорский", {4}),
        ("Ⅹylol ５ mg", {6}),
        ("Elixir Bapo n° 5", set()),
        ("élixir Bápo n° 5", set()),
        ("Élixir Bápo n° ⁵", set()),
        ("Élixir Báp n° 5", set()),
        ("Парсан Зорскии", set()),
        ("", set()),
    ],
)
def test_whole(text, ids):
    assert {k for k, _ in TRIE.whole(text)} == ids


def test_places_in_texts():
    assert TRIE.varied("The list names Сapsorin.45 H/Oral without detail.") == {2}
    assert TRIE.varied("The list names Capsorin.45 H/Oral without detail.") == set()
    assert TRIE.varied("対象は「カタ口ミド水和物 5mg」とする") == {3}
    assert TRIE.varied("x Élixir Bápo n° 5５ y") == {5}
    assert TRIE.varied("xСapsorin.45 H/Oral") == set()


@pytest.mark.parametrize("text, least, ids", [("Xy1ol 5 mg", 0.5, {6}), ("Xylol S mg", 0.5, {6}), ("Xyol 5 mg", 1.0, {6}), ("Xyloll 5 mg", 1.0, {6}), ("Xydol 5 rng", 1.5, {6}), ("Elixir Bápo n° 5", 1.0, {1}), ("Zzz", 3.0, set())])
def test_near_terms_by_weight(text, least, ids):
    assert {k for k, _ in TRIE.whole(text, least)} == ids and {k for k, _ in TRIE.whole(text, least - 0.25)} == set()
    assert TRIE.varied(f"the {text} was", least) == ids and TRIE.varied(f"the {text} was", least - 0.25) == set()


def test_weights_equal_a_slow_distance():
    rng = random.Random(11)

    def slow(text, term):
        grid = {(0, 0): 0.0}
        for i in range(len(text) + 1):
            for j in range(len(term) + 1):
                if i or j:
                    ways = [grid[i - 1, j] + 1] if i else []
                    ways += [grid[i, j - 1] + 1] if j else []
                    if i and j:
                        near = any(text[i - 1] in g and term[j - 1] in g for g in NEAR_GROUPS)
                        ways.append(grid[i - 1, j - 1] + (0 if text[i - 1] == term[j - 1] else 0.5 if near else 1))
                    for part, whole in NEAR_PARTS:
                        ways += [grid[i - 2, j - 1] + 0.5] if i > 1 and j and text[i - 2 : i] == part and term[j - 1] == whole else []
                        ways += [grid[i - 1, j - 2] + 0.5] if j > 1 and i and term[j - 2 : j] == part and text[i - 1] == whole else []
                    grid[i, j] = min(ways)
        return grid[len(text), len(term)]

    words = ["".join(rng.choice("lI1rnmcd0O") for _ in range(rng.randint(2, 5))) for _ in range(60)]
    trie = TermTrie(list(enumerate(words[:20])))
    for text in words:
        for bound in (0.5, 1.0, 2.0):
            assert {k for k, _ in trie.whole(text, bound)} == {k for k, w in enumerate(words[:20]) if slow(text, w) <= bound}


def test_one_form():
    assert TRIE.normalized("a Сapsorin.45\xa0H/Oral, Ｂ　ｃ") == "a Capsorin.45 H/Oral, B c"
    assert plain_form("соpy of Москвa é") == "copy of Москва é"
    assert plain_form("क्‍ष 👩‍⚕") == "क्‍ष 👩‍⚕"


def test_rows(spark):
    terms = spark.createDataFrame(TERMS, "term_id long, term string")
    rows = [(1, None), (2, ""), (3, "Сapsorin.45 H/Oral"), (3, "Сapsorin.45 H/Oral"), (4, "Capsorin.45 H/Oral ")]
    df = spark.createDataFrame(rows, "term_id int, text string")
    got = sorted(map(tuple, lookalike_terms(df, ["term_id"], "text", terms).collect()))
    assert got == [(3, 2), (3, 2), (4, 2)]
    texts = {(r.term_id, r.text) for r in consistent_text(df, ["term_id"], "text", terms).collect()}
    assert texts == {(1, None), (2, ""), (3, "Capsorin.45 H/Oral"), (4, "Capsorin.45 H/Oral")}
    assert lookalike_terms(df.limit(0), ["term_id"], "text", terms, whole=False).collect() == []
    assert lookalike_terms(df, ["term_id"], "text", terms.limit(0)).collect() == []
