"""Small pages with known columns, lines, bands, spacing, scripts and filters."""

import pytest

from leafmill.operators import layout as L

SCHEMA = "doc_id long, page int, word_ix int, text string, x0 double, top double, x1 double, bottom double, fontname string, size double, height double"


def page(spark, *words, size=10.0):
    rows = [(1, 1, i, *w, None, size if len(w) == 5 else None, None) if len(w) == 5 else (1, 1, i, *w[:5], None, w[5], None) for i, w in enumerate(words)]
    return spark.createDataFrame(rows, SCHEMA)


def sizes(spark, width=600.0, height=800.0):
    return spark.createDataFrame([(1, 1, width, height)], "doc_id long, page int, width double, page_height double")


def test_columns(spark):
    got = lambda x: [r.column_no for r in L.columns(page(spark, ("A", 10.0, 0.0, 50.0, 10.0), ("B", 60.0, 0.0, 100.0, 10.0), ("C", x, 0.0, x + 49, 10.0))).orderBy("word_ix").collect()]
    assert got(151.0) == [0, 0, 1] and got(150.0) == [0, 0, 0]


def test_lines_and_bands(spark):
    words = page(spark, *((str(i), 10.0, t, 20.0, t + 9) for i, t in enumerate((100.0, 114.0, 128.0, 143.0))))
    lined = L.lines(L.columns(words))
    assert [r.line_no for r in lined.orderBy("word_ix").collect()] == [0, 0, 0, 1]
    assert [r.word_ixs for r in L.bands(words).orderBy("band_no").collect()] == [[0, 1], [2, 3]]


@pytest.mark.parametrize("a, b, gap, text", [("Hello", "World", 4.0, "Hello World"), ("Hello", "World", 3.0, "HelloWorld"), ("漢", "字", 8.0, "漢字"), ("漢", "字", 11.0, "漢 字"), ("end", ".", 9.0, "end.")])
def test_spacing(spark, a, b, gap, text):
    words = page(spark, (a, 10.0, 0.0, 50.0, 10.0), (b, 50.0 + gap, 0.0, 90.0, 10.0))
    lined = L.lines(L.columns(words))
    assert [r.line_text for r in L.line_texts(lined).collect()] == [text]
    assert [r.page_text for r in L.page_texts(L.line_texts(lined)).collect()] == [text]


def test_attached_scripts(spark):
    body = [("word", 200.0 + 30 * i, 100.0, 220.0 + 30 * i, 110.0, 10.0) for i in range(6)]
    raised = page(spark, ("x", 10.0, 100.0, 20.0, 110.0, 10.0), ("2", 21.0, 99.0, 24.0, 104.0, 5.0), *body)
    lowered = page(spark, ("H", 10.0, 100.0, 20.0, 110.0, 10.0), ("2", 21.0, 106.0, 24.0, 111.0, 5.0), ("z", 40.0, 100.0, 44.0, 105.0, 5.0), *body)
    first = lambda df: [r.text for r in L.attach_scripts(df).orderBy("item_no").collect()]
    assert first(raised)[:2] == ["x²", "word"]
    assert first(lowered)[:3] == ["H₂", "z", "word"]


def test_filter(spark):
    words = [("1.2", 10.0, 10.0, 30.0, 20.0), ("Title", 50.0, 10.0, 90.0, 20.0), ("7", 295.0, 780.0, 305.0, 790.0), ("※1", 20.0, 760.0, 40.0, 770.0), ("body", 100.0, 400.0, 140.0, 410.0)]
    none = spark.createDataFrame([], "doc_id long, zone string, zone_text string, n_pages long")
    rules = lambda df: {r.text: (r.rule, r.keep) for r in L.metadata_filter(df, sizes(spark), none).collect()}
    got = rules(page(spark, *words))
    assert got == {"1.2": ("section", True), "Title": ("top_margin", False), "7": ("lonely_number", False), "※1": ("footnote", True), "body": ("body", True)}
    near = rules(page(spark, *words, ("x", 315.0, 780.0, 325.0, 790.0)))
    assert near["7"] == ("body", True)


def test_near_ignores_exact_copies(spark):
    w = page(spark, ("7", 10.0, 10.0, 20.0, 20.0), ("7", 10.0, 10.0, 20.0, 20.0))
    assert L.near_words(w, w).collect() == []


def test_table_edge_is_inside(spark):
    tables = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 100.0)], "doc_id long, page int, x0 double, top double, x1 double, bottom double")
    w = page(spark, ("edge", 90.0, 95.0, 110.0, 105.0), ("out", 91.0, 95.0, 111.0, 105.0))
    assert [r.text for r in L.outside_tables(w, tables).collect()] == ["out"]


def test_overlap_is_strict(spark):
    half = page(spark, ("a", 0.0, 0.0, 10.0, 10.0), ("b", 5.0, 0.0, 15.0, 10.0))
    more = page(spark, ("a", 0.0, 0.0, 10.0, 10.0), ("b", 4.0, 0.0, 14.0, 10.0))
    assert L.overlap_pairs(half).count() == 0 and L.overlap_pairs(more).count() == 1


def test_repeating_headers(spark):
    def pages(n, same):
        return spark.createDataFrame([(1, p, 0, "Head" if p <= same else f"Other{p}", 10.0, 5.0, 40.0, 15.0, None, 10.0, None) for p in range(1, n + 1)], SCHEMA)

    def found(n, same):
        w = pages(n, same)
        s = w.select("doc_id", "page").distinct().selectExpr("doc_id", "page", "600D AS width", "800D AS page_height")
        return [r.zone_text for r in L.repeating_zones(L.zone_strings(w, s), w).collect()]

    assert found(5, 4) == ["Head"] and found(5, 3) == [] and found(2, 2) == []


def test_empty_pages(spark):
    w = page(spark, ("x", 0.0, 0.0, 1.0, 1.0)).limit(0)
    for df in (L.columns(w), L.bands(w), L.attach_scripts(w), L.trimmed_sizes(w), L.overlap_pairs(w), L.gap_regularity(w)):
        assert df.collect() == []


def test_formulas(spark):
    words = [("H", 10.0, 100.0, 16.0, 110.0, False), ("2", 17.0, 104.0, 20.0, 109.0, True), ("O", 21.0, 100.0, 27.0, 110.0, False), ("falls", 40.0, 100.0, 60.0, 110.0, False), ("C", 70.0, 100.0, 76.0, 110.0, False)]
    rows = [(1, 1, i, t, a, b, c, d, False, low) for i, (t, a, b, c, d, low) in enumerate(words)]
    df = spark.createDataFrame(rows, "doc_id long, page int, word_ix int, text string, x0 double, top double, x1 double, bottom double, is_superscript boolean, is_subscript boolean")
    same_line = df.selectExpr("*", "100.0D AS _t").drop("top").withColumnRenamed("_t", "top")
    assert [(r.word_ix, r.formula) for r in L.formulas(same_line).collect()] == [(0, "H₂O")]
