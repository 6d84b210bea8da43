import os

import numpy as np
import pytest

from leafmill.llm import queries
from leafmill.llm.lines import WIDTHS, line_statistics
from leafmill.llm.markov import LineModel, packed, trained, unpacked
from leafmill.llm.prose import LABELS, LIST, PROSE as IN_PROSE, TABLE as IN_TABLE, common_words, document_shares, first_model, line_labels, text_statistics, units, word_group

PROSE = "The reader opens the first page of the book. It is a long\nstory about a river, and it goes on for many pages until\nthe end.\n\n"
TABLE = "vial   12   34   56\nlabel   3   40   501\nbatch   44   9   8\n" * 3


def shown(line, name):
    return int(line_statistics([line])[0][0][list(WIDTHS).index(name)])


def test_statistics_of_lines():
    assert shown("The reader waits. It is late", "sentence") == 3 and shown("the end of the book.", "sentence") == 2 and shown("carton, 182", "sentence") == 0
    assert shown("なぜ資料が不足したか？ 次の", "sentence") == 3 and shown("poudre   314   57", "gaps") == 1 and shown("poudre 314 57", "gaps") == 0
    assert shown("vial, powder, margin, capsule, outline,", "members") == 3 and shown("batch batch batch Nadel", "repeats") == 3
    assert shown("ã\x81¯8â„ƒã\x81§ä¿\x9då\xad˜", "strange") == 4 and shown("Таблица доз – été", "strange") == 0
    assert shown("%^ ,[@$}<\\> *[\\#//>~+%==?;?-{~-", "signs") == 5 and shown("qLiInrltA/32USHU0qgnwgZq7VdbkZnoPED4FWZ7c", "longest") == 3


def test_words_of_every_script():
    counts = line_statistics(["don’t go, café", "承認の日付を比較した。次の週", "ยืนยันที่", "दवा की खुराक", "x-ray 12 --", "", " \n"])[3]
    assert counts["words"].tolist() == [3, 13, 5, 3, 1, 0, 0]
    assert counts["word_chars"].tolist() == [11, 13, 9, 10, 5, 0, 0] and counts["solid"].tolist() == [12, 14, 9, 10, 9, 0, 0]
    assert line_statistics([])[0].shape == (0, len(WIDTHS))


def test_paths_equal_slow_ones():
    rng = np.random.default_rng(5)
    model = LineModel(*(rng.random(s) for s in (3, (3, 3), 3)), [rng.random((3, 4)), rng.random((3, 2))])
    lengths = np.array([4, 0, 1, 6, 2])
    codes = np.stack([rng.integers(0, 4, 13), rng.integers(0, 2, 13)], 1)
    slow, at = [], 0
    for n in lengths:
        best = max(np.ndindex(*[3] * n), key=lambda p: model.start[p[0]] + model.stop[p[-1]] + sum(model.move[a, b] for a, b in zip(p, p[1:])) + model.emissions(codes[at : at + n])[range(n), p].sum()) if n else ()
        slow += best
        at += n
    assert model.paths(codes, lengths).tolist() == slow
    counts = model.counts(codes, lengths)
    assert counts.sum() == 4 + 9 + 4 + 2 * 13
    again, sizes = unpacked([packed(codes[:4]), packed(codes[4:4]), packed(codes[4:])], 2)
    assert (again == codes).all() and sizes.tolist() == [4, 0, 9]


def test_path_decides_lines():
    """A short line amid sentences is prose, the same line amid items is an item; alone its statistics decide."""
    assert set(line_labels(PROSE * 2 + "Filter\n" + PROSE, first_model())) == {IN_PROSE}
    items = line_labels("• carton\n• vial;\nFilter\n• label\n• batch\n", first_model())
    assert set(items) == {LIST} and set(line_labels(TABLE, first_model())) == {IN_TABLE}


HELD_OUT = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(HELD_OUT), reason="no test tables")
def test_training_and_path_decide(spark):
    """Trained on the even documents, measured on the odd ones: the start alone takes documents of wrapped and foreign prose for lists,
    and without the path over a twenty-fifth of the lines get another label."""
    df = spark.read.parquet(f"{HELD_OUT}/extraction_results.parquet").where("raw_text IS NOT NULL").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.raw_text for r in df.select("doc_id", "raw_text").collect()}
    even, odd = ([t for d, t in sorted(texts.items()) if d % 2 == k] for k in (0, 1))
    codes, _, lengths, _ = line_statistics(even)
    rows = [(packed(codes[e - n : e]),) for e, n in zip(np.cumsum(lengths), lengths)]
    model = trained(first_model(), spark.createDataFrame(rows, "c binary"), "c", 2, 200.0)
    codes, solid, lengths, _ = line_statistics(odd)
    verdicts = {name: document_shares(codes, solid, lengths, m)[:, IN_PROSE] > 0.5 for name, m in (("start", first_model()), ("trained", model))}
    assert (verdicts["start"] & ~verdicts["trained"]).sum() <= 2 and (verdicts["trained"] & ~verdicts["start"]).sum() >= 1
    changed = (LABELS[model.paths(codes, lengths)] != LABELS[model.without_path(codes)]).mean()
    assert changed > 0.04


def test_rows(spark):
    df = spark.createDataFrame([(1, PROSE * 3), (2, TABLE), (2, TABLE), (3, None), (4, "")], "verdict int, text string")
    rows = text_statistics(df, ["verdict"], "text").collect()
    assert sorted((r.verdict_key, r.verdict or "") for r in rows) == [(1, "prose"), (2, "not prose"), (2, "not prose"), (3, ""), (4, "")]
    assert text_statistics(df.limit(0), ["verdict"], "text").collect() == []


def test_common_words_of_every_language(spark):
    russian = ["Таблица доз и протокол фармакологического исследования.", "Протокол и таблица фармакологического исследования."]
    japanese, hindi = ["最初の週に承認の日付を比較した。", "承認の日付は次の週に。"], ["दवा की खुराक और तालिका", "तालिका और दवा की"]
    english = [f"The word{chr(97 + i % 26)}{chr(97 + i // 26)} of the cross-references is here." for i in range(400)]
    rows = [(t, lang) for texts, lang in ((english * 3, "en"), (russian, "ru"), (japanese, None), (hindi, "und")) for t in texts]
    df = spark.createDataFrame(rows, "text string, lang string")
    common = common_words(df, "text", "lang")
    assert {"и", "таблица", "фармакологического"} <= common["ru"] and "cross-references" in common["en"] and "承認" in common["script Kana"] and "तालिका" in common["script Devanagari"]
    shares = {r.text: r.common_word_share for r in text_statistics(df, ["text"], "text", language="lang").collect()}
    assert min(shares[t] for t in (*russian, *japanese, *hindi)) > 0.3
    assert units("Ab 12 ไทย x") == ["ไท", "ทย", "ab", "x"] and word_group("und", "承認") == "script Han"


def test_script_of_the_whole_text(spark):
    """A long opening in another script doesn't decide: neither the group, nor whose common words a text is held against."""
    opening, body = "The reader opens the first page of the book. " * 60, "Таблица доз и протокол исследования. "
    assert len(opening) > 2000 and word_group(None, opening + body * 100) == "script Cyrillic" and word_group(None, opening + body) == "script Latin"
    assert word_group("und", "a" * 1_000_001 + "я" * 1_000_002) == "script Cyrillic" and word_group(None, "") == word_group(None, "12 \ud800 𠀀") == "script Latin"
    df = spark.createDataFrame([(1, opening + body * 100, None), (2, body, None)], "id int, text string, lang string")
    assert common_words(df, "text", "lang") == {"script Cyrillic": {"таблица", "доз", "и", "протокол", "исследования"}}
    shares = {r.id: r.common_word_share for r in text_statistics(df, ["id"], "text", language="lang").collect()}
    assert shares == {1: 500 / (500 + 9 * 60), 2: 1.0}


def test_found_takes_the_full_statistics(spark, monkeypatch, tmp_path):
    spark.createDataFrame([(1, TABLE, "en"), (2, TABLE, "en"), (3, PROSE * 3, "en")], "doc_id long, raw_text string, lang string").write.parquet(f"{tmp_path}/extraction_results.parquet")
    made = []
    monkeypatch.setattr(queries, "text_statistics", lambda *args, **named: made.append(text_statistics(*args, **named)) or made[0])
    assert {r.doc_id for r in queries.p2_found(spark, str(tmp_path)).collect()} == {1, 2}
    assert all(r.common_word_share > 0 for r in made[0].where("doc_id < 3").collect())
