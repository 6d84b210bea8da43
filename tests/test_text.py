"""Goldens of text repair, issues, quality, chunking, formatting and footnotes."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import chunking as C
from leafmill.operators import footnotes as N
from leafmill.operators import formatting as M
from leafmill.operators import reports as R
from leafmill.operators import tables as T
from leafmill.operators import textops as X


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'double'}" for n, v in zip(names, values))).select(column(*map(F.col, names)).alias("x")).first().x


@pytest.mark.parametrize("text, made", [("あ い う", "あい う"), ("薬 は", "薬は"), ("第1章 序論", "第 1 章序論"), ("「 薬 」", "「薬」"), ("用量10mg投与 。", "用量 10mg 投与。"), ("漢字\n仮名", "漢字\n仮名")])
def test_spacing(spark, text, made):
    assert one(spark, X.fix_spacing, text) == made


def test_punctuation(spark):
    assert one(spark, X.fix_punctuation, "あ。。。い、、う....え・・・") == "あ。い、う…え…"


def test_join_lines(spark):
    lines = ["薬は", "有効、", "である", "第1章"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "d int, n int, line string")
    assert [r.line for r in X.join_lines(df, ["d"], "n", "line").orderBy("n").collect()] == ["薬は有効、", "である", "第1章"]


ISSUE_TEXT = "The pat1ent rece1ved the medicat ion at 3pm.\nThe concentrat ion of the so1ution was 5%.\nThis    has   excess    spaces."


def test_issues(spark):
    df = spark.createDataFrame([(1, ISSUE_TEXT), (2, None), (3, "")], "d int, text string")
    found = X.issue_spans(df, ["d"], "text").withColumn("confidence", X.issue_confidence(F.col("issue_type"), F.col("original_text")))
    kept = X.resolve_overlaps(found, ["d"]).withColumn("corrected", X.correction(F.col("issue_type"), F.col("original_text")))
    assert [(r.position, r.original_text, r.corrected) for r in kept.orderBy("position").collect()] == [(4, "pat1ent", "patient"), (12, "rece1ved", "received"), (71, "so1ution", "soiution"), (92, "    ", "  "), (99, "   ", "  "), (108, "    ", "  ")]
    done = {r.d: (r.corrected_text, r.n_corrections) for r in X.apply_corrections(df, kept, ["d"], "text").collect()}
    assert done[1] == (ISSUE_TEXT.replace("pat1ent", "patient").replace("rece1ved", "received").replace("so1ution", "soiution").replace("    ", "  ").replace("   ", "  "), 6)
    assert done[2] == (None, 0) and done[3] == ("", 0)


def test_quality(spark):
    lines = ["This is page text of 33 characters", "With 4.2 as its section nr", "and a line of 20 chr", "twenty seven characters now", "and twenty two of them"]
    text = "\n".join(lines)
    df = spark.createDataFrame([(1, text, 1), (2, None, None)], "d int, text string, p int")
    rows = {r.d: r for r in X.quality_dimensions(df, "text", "p").withColumn("overall", X.quality_overall()).withColumn("c", X.quality_confidence()).withColumn("g", X.grade(F.round("overall", 6))).collect()}
    r = rows[1]
    assert (r.completeness, r.structure, r.accuracy, r.footnotes, r.readability) == (50, 100, 100, 80, 100)
    assert r.overall == pytest.approx(82.0) and r.g == "Good" and r.c == pytest.approx(0.616)
    assert rows[2].completeness == 50


def test_encoding(spark):
    assert one(spark, X.encoding_errors, "a� \\x41 \\u00e9") == 3
    assert one(spark, X.drop_encoding_errors, "a�b \\x41\\x42!") == "ab AB!"


def test_chunks_by_characters(spark):
    pages = spark.createDataFrame([(1, i, f"Page {i} content. " * 100) for i in range(1, 6)], "d int, page int, text string")
    got = [(r.chunk_id, r.page_start, r.page_end, r.char_count) for r in C.packed(pages, ["d"], "page", "text", 5000, 1000).orderBy("chunk_id").collect()]
    assert got == [(0, 1, 3, 4804), (1, 4, 5, 3202)]
    empty = spark.createDataFrame([(1, 1, None), (1, 2, "")], "d int, page int, text string")
    assert [(r.page_start, r.page_end) for r in C.packed(empty, ["d"], "page", "text", 10, 1).collect()] == [(1, 2)]


def test_reassembly(spark):
    chunks = spark.createDataFrame([(1, 0, "abc", ""), (1, 1, "bcd", "bc"), (1, 2, "zz", "cd")], "d int, chunk_id int, content string, overlap_start_text string")
    r = C.reassembled(chunks, ["d"]).first()
    assert (r.full_text, r.duplicates_removed) == ("abc\n\nd\n\nzz", 1)


def test_page_markers(spark):
    marker = "----------------------- PAGE 1 START -----------------------"
    assert one(spark, lambda p: M.page_marker(p.cast("int")), 1.0) == marker
    page = one(spark, lambda p, t: M.marked_page(p.cast("int"), t), 1.0, "one\ntwo")
    assert one(spark, M.pages_of, page) == ["one\ntwo"]
    assert one(spark, M.without_markers, page) == "one\ntwo"


def test_wrapping(spark):
    lines = one(spark, lambda t: M.wrapped(t, 10), "aaa bbb ccc ddddddddddddd e")
    assert lines == ["aaa bbb", "ccc", "ddddddddddddd", "e"]


def test_reply(spark):
    assert one(spark, M.parsed_reply, 'x {"corrected": "b", "confidence": 0.8} y', "a").asDict() == {"corrected": "b", "confidence": 0.8}
    assert one(spark, M.parsed_reply, "nothing", "a").asDict() == {"corrected": "a", "confidence": 0.5}


def test_footnotes(spark):
    lines = spark.createDataFrame([(1, 1, 0, "lead"), (1, 1, 1, "*1: alpha"), (1, 1, 2, "beta"), (1, 1, 3, "※1 gamma")], "doc_id long, page int, n int, t string")
    spans = N.definition_spans(lines, ["doc_id", "page"], "n", "t").orderBy("definition_no").collect()
    assert [(r.marker, r.text) for r in spans] == [("*1", "alpha beta"), ("※1", "gamma")]
    marks = spark.createDataFrame([(1, 1, 1, "*1"), (1, 1, 2, "※"), (1, 1, 3, "*1")], "doc_id long, page int, ix int, marker string")
    defs = spark.createDataFrame([(1, 1, 10, "＊1", "alpha"), (1, 1, 11, "※", "gamma")], "doc_id long, page int, id int, marker string, text string")
    found = N.matches(marks, defs, "ix", "id")
    assert sorted((r.mark_id, r.definition_id) for r in found.collect()) == [(1, 10), (2, 11)]
    report = N.completeness(marks, defs, found).first()
    assert (report.n_matches, round(report.match_rate, 1), report.status, report.unmatched) == (2, 66.7, "POOR", "")


def test_batch_issues(spark):
    rows = [(1, "a", False, 90.0, 1.0), (2, "b", True, 59.0, 1.0), (3, "c", True, 60.0, 0.4), (4, "d", True, 60.0, 0.5), (5, "e", True, float("nan"), 0.9)]
    df = spark.createDataFrame(rows, "doc_id int, filename string, success boolean, quality_score double, confidence double")
    assert {(r.doc_id, r.issue, r.severity) for r in R.batch_issues(df).collect()} == {(1, "failed", "high"), (2, "low_quality", "high"), (3, "low_confidence", "medium")}


def test_consensus(spark):
    df = spark.createDataFrame([(1, "a", "abcd"), (1, "b", "bcde"), (1, "c", None), (2, "a", "x")], "d int, engine string, text string")
    pairs = {(r.engine_a, r.engine_b): r.similarity for r in R.consensus_pairs(df, ["d"]).collect()}
    assert pairs[("a", "b")] == pytest.approx(0.75) and pairs[("a", "c")] == 0
    got = {r.d: (r.base_engine, r.consensus_score) for r in R.consensus(R.consensus_pairs(df, ["d"]), df, ["d"]).collect()}
    assert got[2] == ("a", 1.0) and got[1][0] == "a"


def test_boxes_and_kinds(spark):
    assert [one(spark, T.box_kind, t) for t in ("注意 x", "注 x", "例 x", "plain")] == ["warning", "note", "example", "generic"]


def test_greedy_tables(spark):
    box = lambda i, x, c: (1, 1, i, x, 0.0, x + 10, 10.0, c)
    df = spark.createDataFrame([box(0, 0.0, 0.9), box(1, 10.0, 0.95), box(2, 21.0, 0.5), box(3, 25.0, 0.5)], "doc_id int, page int, table_ix int, x0 double, top double, x1 double, bottom double, confidence double")
    assert sorted(r.table_ix for r in T.keep_surest(df).collect()) == [1, 2]


def test_merged_methods(spark):
    rows = [(1, 1, "lines", 0, 0.0, 0.0, 10.0, 10.0, 0.8), (1, 1, "text", 0, 1.0, 0.0, 11.0, 10.0, 0.7), (1, 1, "text", 1, 6.0, 0.0, 16.0, 10.0, 0.6), (1, 1, "lines", 1, 0.0, 0.0, 9.0, 10.0, 0.5)]
    df = spark.createDataFrame(rows, "doc_id int, page int, method string, table_ix int, x0 double, top double, x1 double, bottom double, confidence double")
    got = sorted((r.method, r.table_ix, round(r.confidence, 6)) for r in T.merge_methods(df).collect())
    assert got == [("lines", 0, 0.9), ("text", 1, 0.6)]


def test_context_pieces(spark):
    text = ("word " * 30 + "end. ") * 12 + "\n\n" + "x" * 900
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "d int, text string")
    rows = C.context_pieces(df, ["d"], "text", 400, 50).orderBy("d", "piece_no").collect()
    spans = [(r.start_pos, r.end_pos) for r in rows if r.d == 1]
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b - a <= 400 for a, b in spans) and all(c < b and c > a for (a, b), (c, _) in zip(spans, spans[1:]))
    assert [(r.d, r.start_pos, r.end_pos) for r in rows if r.d != 1] == [(2, 0, 0)]


def test_processed_with_context(spark):
    chunks = spark.createDataFrame([(1, 0, "abc"), (1, 1, "def")], "d int, chunk_id int, content string")
    assert [r.content for r in C.processed(chunks, ["d"], lambda c, before: F.concat(before, F.lit(">"), c), 2).orderBy("chunk_id").collect()] == [">abc", "bc>def"]


def test_settings():
    from leafmill.settings import PROFILES, Settings

    assert PROFILES["optimized"].column_gap == 40
    with pytest.raises(ValueError):
        Settings(overlap=6000)
    with pytest.raises(ValueError):
        Settings(bottom_margin=0.6)


def test_consensus_of_whole_texts(spark):
    from leafmill.plans import report_queries

    engines = [(1, "raw", "one two\nthree"), (1, "flat", "one two three"), (1, "chunks", "one two three"), (2, "raw", "alone")]
    made = spark.createDataFrame(engines, "doc_id long, engine string, text string")
    kept, report_queries.engines = report_queries.engines, lambda spark, d: made
    try:
        got = {r.doc_id: (r.base_engine, r.consensus_score) for r in report_queries.consensus_texts(spark, "").collect()}
    finally:
        report_queries.engines = kept
    assert got == {1: ("chunks", round((1 + 12 / 13 + 12 / 13) / 3, 6)), 2: ("raw", 1.0)}


def test_consensus_of_tables_that_are_split_by_document(spark, tmp_path):
    """Joins of the engines' union failed where tables are exchanged and not broadcast: partitions of other numbers were zipped."""
    from leafmill.plans import report_queries

    texts = {i: f"Page {i}\nof the whole\ntext {i * i}" for i in range(40)}
    spark.createDataFrame([(i, f"{i}.pdf", t, None) for i, t in texts.items()], "doc_id long, filename string, raw_text string, loaded_at timestamp").write.parquet(str(tmp_path / "extraction_results.parquet"))
    spark.createDataFrame([(i, 1, t, None) for i, t in texts.items() if i % 2], "doc_id long, chunk_id int, content string, overlap_start_text string").write.parquet(str(tmp_path / "chunks.parquet"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted((r.doc_id, r.base_engine, r.consensus_score) for r in report_queries.consensus_texts(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    ratio = {i: difflib.SequenceMatcher(None, t.replace("\n", " "), t).ratio() for i, t in texts.items()}
    back = {i: difflib.SequenceMatcher(None, t, t.replace("\n", " ")).ratio() for i, t in texts.items()}
    assert got == [(i, "chunks", round((ratio[i] + back[i] + 1) / 3, 6)) if i % 2 else (i, "flat", round(ratio[i], 6)) for i in texts]


def test_similarity_is_that_of_the_library(monkeypatch):
    from leafmill.functions import similarity

    monkeypatch.setattr(similarity, "SHORT", 0)
    rnd = random.Random(3)
    for n in range(600):
        letters = rnd.choice(["ab", "abc \n", "etaoin shrdlu\nXYZ0123", "日本語中文字漢仮名 。\n", "ab\U0001f600\ud800 "])
        a = b = "".join(rnd.choices(letters, [rnd.random() ** 3 + 0.001 for _ in letters], k=rnd.choice([1, 60, 199, 200, 201, 500])))
        for _ in range(rnd.choice([0, 1, 3, 12])):
            i, j = rnd.randint(0, len(b)), rnd.randint(0, 40)
            b = b[:i] + rnd.choice(["", "\n", "\n\n", " ", b[:j], b[i : i + 30]]) + b[i + rnd.choice([0, 1, 2, j]) :]
        b = b.replace("\n", " ") if n % 3 else b
        for x, y in ((a, b), (b, a)) if b else ():
            assert similarity.ratio(x, y) == difflib.SequenceMatcher(None, x, y).ratio(), (x, y)
    words = [f"{rnd.choice(['Alpha', 'beta', 'gamma'])}{chr(rnd.randint(0x4E00, 0x51FF))}" for _ in range(20_000)]
    long, lines = " ".join(words), "\n".join(words)
    assert similarity.ratio(long, lines) == 2 * (len(long) - len(words) + 1) / (2 * len(long)), "quadratic, this takes minutes"
