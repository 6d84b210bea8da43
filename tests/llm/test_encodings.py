import pytest

from leafmill.llm import encodings
from leafmill.llm.encodings import CHAINS, chains_of, garble, garbled_tokens, is_clean, page_words, printed_codes, put_right

CLEAN = "Der Prüfplan für Café-au-lait – “vor” 5 µg. Таблица доз по протокол. 最初の週に承認の日付を比較した。 推荐剂量的稳定性试验。 ยืนยันหัวข้อของคอลัมน์ दवा की खुराक"
#: Words of every script, each amid ASCII text as one page.
SAMPLES = ("Prüfplan", "Таблица", "最初の週に承認の日付を比較した", "推荐剂量的稳定性试验", "ยืนยันหัวข้อของคอลัมน์", "खुराक")
NUMBERS = ("one", "two", "three", "four")


def clean_pages(first=1):
    return [(first, n, f"{CLEAN} {word}") for n, word in enumerate(NUMBERS)]


def test_every_chain_is_found(spark):
    """Each chain that leaves what it garbles readable finds a word of each script that it can write."""
    rows, wanted = clean_pages(), {}
    for c, chain in enumerate(CHAINS):
        for s, sample in enumerate(SAMPLES):
            form = garble(sample, chain)
            if form and "�" not in form and any(k == c for _, k in chains_of(sample if s in (0, 1, 5) else sample[:2])):
                rows.append((100 + c, s, f"so {form} es {c} {s}"))
                wanted[100 + c, s] = chain
    found = {(r.doc, r.page) for r in garbled_tokens(spark.createDataFrame(rows, "doc long, page int, text string"), "doc", "page", "text").collect()}
    assert {wanted[w] for w in wanted} >= set(CHAINS) - {c for c in CHAINS if all(v != c for v in wanted.values())}
    missed = {(wanted[w], SAMPLES[w[1]]) for w in wanted if w not in found}
    assert len(missed) <= len(wanted) * 0.02, missed
    assert not {f for f in found if f[0] < 100}


def test_units():
    assert is_clean("Prüfplan") and is_clean("Таблица") and is_clean("протоколу")
    assert not is_clean("".join(map(chr, "Таблица".encode())))
    long = "ü" + "a" * 60
    assert long in page_words(f"x {long} y") and "承認" in page_words("承認の")
    assert {kind for kind, _ in chains_of("承認")} == {encodings.PAIR} and chains_of("承") == []


def test_printed_codes():
    assert [m[2] for m in printed_codes("4 \\xc2\\xb0C \\u2013 x \\x41 \\ud83e\\uddea")] == ["°", "–", "🧪"]


DECOYS = "The letter “Ã” and the sign “â” open the index. The mark ¿ is printed before Ñandú. Les sigles ÉÀÇ et ŒÆ. Groups of ½ × ¾ mg and «§ 4»."


@pytest.mark.parametrize("limit", [500_000, -1])
def test_pages(spark, monkeypatch, limit):
    monkeypatch.setattr(encodings, "BROADCAST_ROWS", limit)
    rows = [*clean_pages(), (2, 1, DECOYS), (2, 2, None), (2, 3, "")]
    rows += [(3, 1, "so " + garble("für", (("utf-8", "cp1252"),)) + " es"), (3, 2, "a � b"), (3, 3, "2 \\xc2\\xb0C"), (3, 4, garble("Таблица", (("koi8-r", "cp1251"),))), (3, 5, garble("承認の日付", (("utf-8", "mac_roman"),)))]
    rows += [(3, 6, garble("Таблица доз", (("utf-8", "gbk"),)))]
    df = spark.createDataFrame(rows + rows[:2], "doc long, page int, text string")
    hits = garbled_tokens(df, "doc", "page", "text")
    assert {(r.doc, r.page) for r in hits.collect()} == {(3, p) for p in range(1, 7)}
    fixed = {(r.doc, r.page): r.text for r in put_right(df, "doc", "page", "text").collect()}
    assert fixed[3, 1] == "so für es" and fixed[3, 3] == "2 °C" and fixed[3, 4] == "Таблица" and fixed[3, 5] == "承認の日付" and fixed[3, 6] == "Таблица доз"
    assert fixed[1, 1] == clean_pages()[1][2] and fixed[2, 1] == DECOYS and fixed[2, 2] is None and fixed[2, 3] == ""
    assert garbled_tokens(df.limit(0), "doc", "page", "text").collect() == []


def test_copies_of_a_garbled_page_have_one_vote(spark):
    clean = [f"{w} für Größe und Таблица по протоколу" for w in ("eins", "zwei", "drei")]
    hot = garble("für Größe", (("utf-8", "cp1252"),)) + " " + garble("Таблица по протоколу", (("koi8-r", "cp1251"),))
    rows = [(1, n, t) for n, t in enumerate(clean)] + [(n, 1, hot) for n in range(10, 60)]
    df = spark.createDataFrame(rows, "doc long, page int, text string")
    assert {r.doc for r in garbled_tokens(df, "doc", "page", "text").collect()} == set(range(10, 60))
    fixed = {r.doc: r.text for r in put_right(df, "doc", "page", "text").collect() if r.doc > 1}
    assert set(fixed.values()) == {"für Größe Таблица по протоколу"}
