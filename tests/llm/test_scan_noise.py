import os

import numpy as np
import pytest

from leafmill.llm.copies import one_of_each, with_copies
from leafmill.llm.markov import trained, unpacked
from leafmill.llm import scan_noise as module
from leafmill.llm.scan_noise import BODY, FOOT, HEAD, body_tokens, broken_lines, first_model, line_labels, misread_words, paragraphs, readings, scan_noise, continuous_text

BODY_1 = "The package insert for the medicine lists the storage condi-\ntions of the product and the pre- and\npost-dose values, and the rep0rt describes the follow-\nup of every visit."
PAGES = [
    f"NAME – LABEL\n{BODY_1}\n\nA further paragraph of the same length as the lines above that goes on and re¬\n- 12 -",
    "NAME – LABEL\n\nturns on the following page with more words of the same kind in it.\nThe end of the page is near now, as all of the readers know.\n- l3 -",
    "NAM3 – LABEL\nThe third page has the report again, and nothing but the report on it.\nAnother line of the third page that ends here and now.\n- 14 -",
]


def test_labels_and_cuts():
    labels = line_labels(PAGES, first_model())
    assert labels[0][0] == HEAD and labels[0][-1] == FOOT and labels[1][0] == HEAD and labels[1][-1] == FOOT and labels[2][-1] == FOOT
    assert labels[0][1:5] == [BODY] * 4
    assert broken_lines(PAGES, labels) == [(0, 1, 0, 2), (0, 3, 0, 4), (0, 6, 1, 2)]


def test_readings():
    assert {"report"} <= {r[0] for r in readings("rep0rt")}
    assert "questions" in {r[0] for r in readings("qiiestioris")}
    assert "312" in {r[0] for r in readings("3l2")}
    assert readings("312") == []


def test_path_decides_zones():
    """A number ends a page as its foot and stands in a table as a row, whatever it shows by itself."""
    table = "The table of the doses is given here in full length.\nvial   12\n44\nlabel   3\nThe last row of the table stands above this line here."
    labels = line_labels([table, table + "\n44"], first_model())
    assert labels[0] == [BODY] * 5 and labels[1] == [BODY] * 5 + [FOOT]
    codes, _ = module.observations([table])
    assert module.LABELS[first_model().without_path(codes)][2] == FOOT


def test_no_caps(spark):
    """Long words, words with many signs and Cyrillic words are put right."""
    long = "Pharmakokinetikuntersuchungsberichte"
    clean = [f"{n}: Die {long} und die таблица sowie statistically relevant." for n in ("eins", "zwei", "drei", "vier", "funf")]
    scan = ["Die " + long.replace("o", "0") + " und die та6лица sowie 5ta7i5tica1ly und so weiter bis zum\nEnde der Seite, auf der alles steht, was zu lesen war und ist\nund die letzte Zeile der Seite steht hier, wie es sein muss."]
    df = spark.createDataFrame([(n, [p]) for n, p in enumerate(clean)] + [(9, scan)], "doc long, pages array<string>")
    words = {r.word: r.original for r in misread_words(df, "pages").collect()}
    assert words[long.replace("o", "0")] == long and words["та6лица"] == "таблица" and words["5ta7i5tica1ly"] == "statistically"


def test_shuffled_branches_agree(spark, monkeypatch):
    df = spark.createDataFrame([(1, PAGES), (5, ["the report", "a report", "report"])], "doc long, pages array<string>")
    ids = spark.createDataFrame([(1,)], "doc long")
    got = [sorted(map(tuple, scan_noise(df, "doc", "pages", ids).collect()))]
    monkeypatch.setattr(module, "BROADCAST_ROWS", -1)
    got.append(sorted(map(tuple, scan_noise(df, "doc", "pages", ids).collect())))
    assert got[0] == got[1] and got[0]


def test_rows(spark):
    docs = [(1, PAGES), (1, PAGES), (2, [BODY_1.replace("rep0rt", "report")] * 4), (3, None), (4, [None, ""]), (5, ["the report", "a report", "report"])]
    df = spark.createDataFrame(docs, "page long, pages array<string>")
    ids = spark.createDataFrame([(1,), (1,), (3,), (4,), (None,)], "page long")
    got = {tuple(r) for r in scan_noise(df, "page", "pages", ids).collect()}
    assert {g for g in got if g[3] == "broken_word"} == {(1, 1, 2, "broken_word"), (1, 1, 4, "broken_word"), (1, 1, 7, "broken_word")}
    assert (1, 1, 4, "misread") in got and (1, 1, 1, "furniture") in got and (1, 2, 5, "furniture") in got
    assert scan_noise(df, "page", "pages", ids.limit(0)).collect() == []
    text = [r.text for r in continuous_text(df, "page", "pages", ids).orderBy("paragraph_no").collect()]
    assert "storage conditions of the product" in text[0] and "the report describes the followup" in text[0]
    assert "goes on and returns on the following page" in " ".join(text)
    assert paragraphs([], first_model(), {}) == []


def test_signs_for_letters(spark):
    clean = [f"Number {n} has the Seiten and the doctor with ill patients, and the old ones care for it here." for n in ("one", "two", "three", "four", "five")]
    scan = ["The $eiten of the do(tor are full of i!l patients that read on and on until the\nend of the page (old ones) where all of the (rep0rt) is for the do$\nand the last line of the page stands here as it has to be."]
    df = spark.createDataFrame([(n, [p]) for n, p in enumerate(clean)] + [(9, scan)], "doc long, pages array<string>")
    ids = spark.createDataFrame([(9,)], "doc long")
    words = {r.word: r.original for r in misread_words(df, "pages").collect()}
    assert {w: words.get(w) for w in ("$eiten", "do(tor", "i!l", "(old")} == {"$eiten": "Seiten", "do(tor": "doctor", "i!l": "ill", "(old": None}
    assert words["rep0rt"] == "report"
    assert (9, 1, 1, "misread") in {tuple(r) for r in scan_noise(df, "doc", "pages", ids).collect()}
    text = " ".join(r.text for r in continuous_text(df, "doc", "pages", ids).collect())
    assert "The Seiten of the doctor are full of ill" in text and "(old ones)" in text and "(report)" in text
    assert [t[2:] for t in body_tokens(["the (condi-\ntions"], [[BODY, BODY]], [(0, 0, 0, 1)])] == [("(conditions", 0, 1, 6), ("conditions", 0, 1, 5), ("the", 0, 0, -1)]


def test_copies_of_a_scan_count_once(spark):
    clean = [f"Text {n} has the questions of the patients." for n in ("one", "two", "three", "four")]
    scan = ["The qiiestioris of the report are read here on and on until the\nend of the page where all of it is for the reader of the whole\nand the last line of the page stands here as it has to be."]
    df = spark.createDataFrame([(n, [p]) for n, p in enumerate(clean)] + [(n, scan) for n in range(10, 60)], "doc long, pages array<string>")
    got = scan_noise(df, "doc", "pages", df.where("doc >= 10").select("doc")).where("noise = 'misread' AND line = 1")
    assert got.count() == 50
    texts = df.selectExpr("doc", "pages[0] AS text")
    copies = {r.doc: r._copies for at_once in (0, 1, 9) for r in with_copies(texts, "text", at_once).collect()}
    assert len(copies) == 54 and copies[0] is None and copies[10] == 50


def test_one_of_each(spark):
    df = spark.createDataFrame([(n % 40, str(n % 40)) for n in range(60)], "k int, t string").repartition(4)
    for at_once in (0, 100):
        assert sorted(map(tuple, one_of_each(df, ["k"], at_once).collect())) == [(k, str(k)) for k in range(40)]


TABLES = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_training_and_path_decide(spark):
    """Of the lines that the trained path takes for running lines, over one in fifty is another to the start's path, and to each line's best emission."""
    ids = spark.read.parquet(f"{TABLES}/page_analysis.parquet").where("is_scanned").select("doc_id").distinct()
    docs = module.observed_documents(spark.read.parquet(f"{TABLES}/extraction_results.parquet").dropDuplicates(["doc_id"]), "doc_id", "pages", ids)
    model = trained(first_model(), docs, "_codes", 2, 200.0, "_lines")
    codes, _ = unpacked([r._codes for r in docs.collect()], len(module.WIDTHS))
    lengths = np.array([n for r in docs.collect() for n in r._lines])
    furniture = lambda states: np.isin(module.LABELS[states], (HEAD, FOOT))
    path, start, alone = furniture(model.paths(codes, lengths)), furniture(first_model().paths(codes, lengths)), furniture(model.without_path(codes))
    assert (path != start).sum() > path.sum() / 50 and (path != alone).sum() > path.sum() / 50
    assert (path & start).sum() > 0.9 * path.sum()
