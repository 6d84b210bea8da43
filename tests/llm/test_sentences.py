import pytest

from leafmill.llm.sentences import sentences

CASES = {
    "Dr. Zoboski noted 2.5 mg, i.e. little. The end.": ["Dr. Zoboski noted 2.5 mg, i.e. little.", "The end."],
    "J. K. Ropadal et al. compared A vs. Bo.† Next one": ["J. K. Ropadal et al. compared A vs. Bo.†", "Next one"],
    "5. Heading\n\nA wrap\nhere. See x_1.pdf on docs.example.invalid now.": ["5. Heading", "A wrap\nhere.", "See x_1.pdf on docs.example.invalid now."],
    '"Is it so?" asked Bo, but no. He wrote: “it is.” The end': ['"Is it so?" asked Bo, but no.', "He wrote: “it is.”", "The end"],
    "It lists ... and then ends. (Bo; cf. p. 52.)\nNext.": ["It lists ... and then ends.", "(Bo; cf. p. 52.)", "Next."],
    "Am 5. Januar war es z. B. so usw. Die Liste.": ["Am 5. Januar war es z. B. so usw.", "Die Liste."],
    "« Est-ce vrai ? » demande Bo. Oui ! Non.": ["« Est-ce vrai ? » demande Bo.", "Oui !", "Non."],
    "В 2087 г. второй, т. е. журнал и т. д. Таблица.": ["В 2087 г. второй, т. е. журнал и т. д.", "Таблица."],
    "担当者は「確認した。」と述べた（図6．9を参照）。「省略した。」次の文……そして続く。[2]終": ["担当者は「確認した。」と述べた（図6．9を参照）。", "「省略した。」", "次の文……そして続く。[2]", "終"],
    "审阅者写道：“解释了计划。”“完整吗？”审阅者问，更正了结果。": ["审阅者写道：“解释了计划。”", "“完整吗？”审阅者问，更正了结果。"],
    "ในบทที่ 26 ตาราง Rijo ระบุอาการ ผู้ตรวจทาน": ["ในบทที่ 26 ตาราง Rijo ระบุอาการ", "ผู้ตรวจทาน"],
    "It was St. Mary of the U.S. Navy, e.g. Smith Jr., etc. and more. Prof. и акад. Ivan left.": ["It was St. Mary of the U.S. Navy, e.g. Smith Jr., etc. and more.", "Prof. и акад. Ivan left."],
    "डॉ. सेल ने कहा। अगला वाक्य।": ["डॉ. सेल ने कहा।", "अगला वाक्य।"],
    "the consent form.In section 8.7, .": ["the consent form.", "In section 8.7, ."],
}


@pytest.mark.parametrize("text", CASES)
def test_units(spark, text):
    rows = sentences(spark.createDataFrame([(1, text)], "id int, t string"), ["id"], "t").orderBy("sentence_no").collect()
    assert [r.sentence for r in rows] == CASES[text]
    assert all(text[r.start_pos : r.end_pos] == r.sentence for r in rows)
    assert [r.sentence_no for r in rows] == list(range(1, len(rows) + 1))


def test_all_text_is_held(spark):
    text = "".join(CASES) * 150
    rows = sentences(spark.createDataFrame([(1, text)], "id int, t string"), ["id"], "t").orderBy("sentence_no").collect()
    at = 0
    for r in rows:
        assert text[at : r.start_pos].strip(" \n\t　") == ""
        at = r.end_pos
    assert text[at:].strip() == ""


def test_edges(spark):
    df = spark.createDataFrame([(None, "A b."), (1, None), (2, ""), (3, " \n "), (4, "Same."), (4, "Same.")], "sentence int, t string")
    rows = sentences(df, ["sentence"], "t").collect()
    assert sorted((r.sentence_key or 0, r.sentence) for r in rows) == [(0, "A b."), (4, "Same."), (4, "Same.")]
    assert sentences(df.limit(0), ["sentence"], "t").count() == 0
