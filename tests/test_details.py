"""Operators without a statement against slow forms, and cases of the finer ones."""

import json
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from leafmill.functions.columns import starts_of
from leafmill.operators import chunking as C
from leafmill.operators import footnotes as N
from leafmill.operators import formatting as M
from leafmill.operators import layout as L
from leafmill.operators import reports as R
from leafmill.operators import tables as T
from leafmill.operators import textops as X
from leafmill.plans import extraction
from leafmill.settings import PROFILES, Settings
from leafmill.sources import decoders as D
from leafmill.sources import sinks as S

# The issue patterns in the notation of Python's regular expressions.
SIMPLE = [
    ("ocr_digit_in_word", r"[a-zA-Z]+[0-9]+[a-zA-Z]+"),
    ("ocr_letter_in_number", r"[0-9]+[a-zA-Z]+[0-9]+"),
    ("ocr_ambiguous_il1", r"\b[Il1][Il1]+\b"),
    ("ocr_ambiguous_o0", r"\b[O0][O0]+\b"),
    ("ocr_random_caps", r"[a-z][A-Z][a-z]"),
    ("ocr_rn_as_m", r"rn(?=[a-z])"),
    ("broken_suffix", r"\w+\s+(?:ing|ed|tion|ment|ness|ly)\b"),
    ("broken_prefix", r"\b(?:un|re|pre|dis)\s+\w+"),
    ("broken_hyphenated_break", r"\w+-\s*\n\s*\w+"),
    ("format_excess_spaces", r"\s{3,}"),
    ("format_duplicate_punct", r"[。、]{2,}"),
    ("format_excess_newlines", r"\n{4,}"),
]
PIECES = ["pat1ent ", "3l5 ", "Il1 ", "OO0 ", "naMe ", "burn ", "barn", "medica tion ", "walk ing\n", "re view ", "un\tdo ", "cut-\n ting ", "   ", "\n\n\n\n\n", "。。", "、 。", "カあカ", "あカあ", "ロー口二", "（ ）", "averyveryverylongword ", "vv cl rn ", "１一２", "{x} ", "é ed ", "ABcD ", "xYz "]


def texts(n=40):
    rng = random.Random(4)
    return [(k, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30)))) for k in range(n)] + [(900, None), (901, ""), (902, "Il1 OO " * 300)]


def simple_found(text):
    made = []
    for k, (name, p) in enumerate(SIMPLE):
        for m in re.finditer(p, text):
            sure = {"ocr_digit_in_word": 0.85, "ocr_ambiguous_il1": 0.75, "broken_suffix": 0.9, "broken_prefix": 0.85}.get(name, 0.8 if name.startswith("format") else 0.7)
            made.append((m.start(), k, name, m.group(), sure))
    return made


def greedy(found):
    kept = []
    for item in found:
        if kept and item[0] < kept[-1][0] + len(kept[-1][3]):
            if item[4] > kept[-1][4]:
                kept[-1] = item
        else:
            kept.append(item)
    return kept


def test_issues_equal_the_slow_scan(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "d int, text string").repartition(4)
    found = X.issue_spans(df, ["d"], "text").withColumn("confidence", X.issue_confidence(F.col("issue_type"), F.col("original_text")))
    got = {(r.d, r.position, r.pattern_no, r.original_text) for r in found.collect()}
    assert got == {(d, at, k, m) for d, t in rows for at, k, _, m, _ in simple_found(t or "")}
    around = {(r.d, r.position, r.pattern_no): (r.context_before, r.context_after) for r in found.collect()}
    assert all(around[d, at, k] == (t[max(0, at - 100) : at], t[at + len(m) : at + len(m) + 100]) for d, t in rows for at, k, _, m, _ in simple_found(t or ""))
    kept = X.resolve_overlaps(found, ["d"])
    assert {(r.d, r.position, r.issue_type) for r in kept.collect()} == {(d, i[0], i[2]) for d, t in rows for i in greedy(sorted(simple_found(t or "")))}
    fixed = kept.withColumn("corrected", F.upper("original_text"))
    done = {r.d: r.corrected_text for r in X.apply_corrections(df, fixed, ["d"], "text").collect()}
    for d, t in rows:
        want = t
        for at, _, _, m, sure in reversed(greedy(sorted(simple_found(t or "")))):
            if m.upper() != m and sure >= 0.7:
                want = want[:at] + m.upper() + want[at + len(m) :]
        assert done[d] == want


def test_enhanced_issues_equal_the_slow_scan(spark):
    rows = texts(25)
    word = lambda p: p.replace("(?<![\\p{L}\\p{N}_])", "(?<!\\w)").replace("(?![\\p{L}\\p{N}_])", "(?!\\w)").replace("[\\p{L}\\p{N}_]", "\\w").replace("[\\s\\p{Z}]", "\\s")
    want = set()
    for d, t in rows:
        for k, (name, p, base) in enumerate(X.ENHANCED_PATTERNS):
            for m in re.finditer(word(p), t or ""):
                near = t[max(0, m.start() - 50) : m.end() + 50]
                sure = base + 0.05 * bool(re.search("[一-龯ぁ-んァ-ヶa-zA-Z]", near)) - 0.1 * bool(re.search(r"[{}\[\]<>=/\\]", near)) - 0.1 * (len(m.group()) < 2) + 0.05 * (len(m.group()) > 5)
                if round(min(1.0, max(0.0, sure)), 6) >= 0.6:
                    want.add((d, m.start(), k, m.group(), round(min(1.0, max(0.0, sure)), 6)))
    got = X.enhanced_issues(spark.createDataFrame(rows, "d int, text string"), ["d"], "text")
    assert {(r.d, r.position, r.pattern_no, r.original_text, r.confidence) for r in got.collect()} == want
    kept = {(r.d, r.position, r.pattern_no) for r in X.resolve_overlaps(got, ["d"], surest_first=True).collect()}
    slow = {(d, i[0], i[1]) for d, _ in rows for i in greedy(sorted(((w[1], w[2], "", w[3], w[4]) for w in want if w[0] == d), key=lambda i: (i[0], -i[4], i[1])))}
    assert kept == slow


@pytest.mark.parametrize("text, made", [("medica  tion", ("medication", 0.8)), ("re view", ("review", 0.8)), ("a    b", ("a b", 0.9)), ("pat1e0nt", ("patieont", 0.7)), ("fine", ("fine", 0.5))])
def test_fallback(spark, text, made):
    r = spark.createDataFrame([(text,)], "t string").select(X.fallback_correction(F.col("t")).alias("c")).first().c
    assert (r.corrected, r.confidence) == made


def test_running_starts(spark):
    rng = random.Random(1)
    rows = [(k, [rng.randint(0, 9) for _ in range(n)]) for k, n in enumerate((0, 1, 2, 63, 64, 65, 128, 129, 1000))]
    got = {r.k: r.s for r in spark.createDataFrame(rows, "k int, x array<int>").select("k", starts_of(F.col("x")).alias("s")).collect()}
    assert all(got[k] == [sum(x[:i]) for i in range(len(x))] for k, x in rows)


def test_sections_equal_a_slow_packing(spark):
    rng = random.Random(8)
    lines = ["# head", "1. one", "2.1 two", "第3章 three", "一、four", "=====", "plain text of a line " * 3, "more", ""]
    rows = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 60)))) for k in range(20)] + [(99, None), (98, "no section")]
    pattern = re.compile("|".join([r"^#{1,6}\s+", r"^\d+\.\s+", r"^\d+\.\d+\s+", r"^第\d+[章条節項]", r"^[一二三四五六七八九十]+[、.]", r"^={3,}", r"^-{3,}"]), re.M)
    want = set()
    for k, t in rows:
        bounds = sorted({m.start() for m in pattern.finditer(t or "")})
        if not bounds:
            continue
        cuts, at, held = [0], 0, 0
        for b in bounds:
            if held + b - at > 300 and held >= 60:
                cuts.append(at)
                held = 0
            held, at = held + b - at, b
        want |= {(k, n, a, e, t[a:e]) for n, (a, e) in enumerate(zip(cuts, [*cuts[1:], len(t)]))}
    got = C.packed_by_sections(spark.createDataFrame(rows, "k int, t string"), ["k"], "t", 300, 60)
    assert set(map(tuple, got.collect())) == want


def test_repeated_blocks_and_reports(spark):
    block = "x" * 99 + "\n"
    df = spark.createDataFrame([(1, block * 6, 1, 50.0, 30.0, 1), (2, block * 6 + "[DOCUMENT FILENAME: a]", 8, 120.0, None, 0), (3, "y" * 100, 1, None, 100.0, 0)], "d int, t string, p int, c double, m double, n int")
    rows = {r.d: r for r in X.quality_dimensions(df, "t", "p", "c", "m", "n").collect()}
    assert (rows[1].completeness, rows[1].footnotes, rows[1].readability) == (50, 30, 85)
    assert (rows[2].completeness, rows[2].footnotes, rows[2].readability, rows[2].structure) == (100, 80, 90, 75)
    assert rows[3].readability == 100 and rows[3].completeness == 50


WORDS = "doc_id long, page int, word_ix int, text string, x0 double, top double, x1 double, bottom double, fontname string, size double, height double"


def word(ix, text, x0, top, page=1):
    return (1, page, ix, text, float(x0), float(top), float(x0 + 10), float(top + 10), None, 10.0, 10.0)


def test_footnote_words_and_lines(spark):
    rows = [word(0, "body", 0, 10), word(1, "*1", 0, 900), word(2, "short", 20, 903), word(3, "far", 0, 940), word(4, "参照", 0, 960), word(5, "averylongword", 0, 990), word(6, "12", 50, 850)]
    w = spark.createDataFrame(rows, WORDS)
    assert {(r.word_ix, r.rule) for r in L.footnote_content(w).collect()} == {(1, "marker"), (2, "beside_marker"), (4, "phrase"), (5, "long")}
    lines = N.footnote_lines(w, L.page_sizes(w)).orderBy("line_no").collect()
    assert [r.line_text for r in lines] == ["*1 short", "far", "参照", "averylongword", "12"]
    spans = N.definition_spans(N.footnote_lines(w, L.page_sizes(w)), L.PAGE, "line_no", "line_text").collect()
    assert [(r.marker, r.text) for r in spans] == [("*1", "short far 参照 averylongword 12")]
    assert L.footnote_content(w.limit(0)).collect() == [] and N.footnote_lines(w.limit(0), L.page_sizes(w)).collect() == []


def test_near_words_and_overlaps_equal_all_pairs(spark):
    rng = random.Random(3)
    rows = [(1, 1 + k % 2, k, "w" if k % 5 else "7", x := rng.uniform(-60, 300), y := rng.uniform(-60, 300), x + rng.uniform(0, 60), y + rng.uniform(0, 40), None, 10.0, 10.0) for k in range(120)]
    rows.append((1, 1, 500, "w", *rows[1][4:8], None, 10.0, 10.0))
    w = spark.createDataFrame(rows, WORDS)
    centre = lambda r: ((r[4] + r[6]) / 2, (r[5] + r[7]) / 2)
    near = {a[2] for a in rows if a[3] == "7" for b in rows if a[1] == b[1] and a[3:8] != b[3:8] and sum((p - q) ** 2 for p, q in zip(centre(a), centre(b))) ** 0.5 < 20}
    assert {r.word_ix for r in L.near_words(w.where("text = '7'"), w, 20.0).collect()} == near
    area = lambda r: (r[6] - r[4]) * (r[7] - r[5])
    pairs = set()
    for a in rows:
        for b in rows:
            wide, high = min(a[6], b[6]) - max(a[4], b[4]), min(a[7], b[7]) - max(a[5], b[5])
            if a[1] == b[1] and a[2] < b[2] and wide > 0 and high > 0 and min(area(a), area(b)) > 0 and wide * high > 0.5 * min(area(a), area(b)):
                pairs.add((a[2], b[2]))
    got = [(r.word_a, r.word_b) for r in L.overlap_pairs(w).collect()]
    assert set(got) == pairs and len(got) == len(pairs) and pairs


def test_places_kinds_and_rotation(spark):
    w = spark.createDataFrame([word(0, "a", 0, 10), word(1, "a", 0.01, 10.01), word(2, "b", 0, 10)], WORDS)
    assert {r.word_ix for r in L.without_repeated_places(w).collect()} == {0, 2}
    pages = spark.createDataFrame([(1, 1, False, 5, 90), (1, 2, True, 0, None), (1, 3, False, 7, 0), (1, 4, False, None, 0)], "doc_id long, page_number int, is_scanned boolean, char_count int, rotation_angle int")
    assert {(r.page, r.kind, r.placeholder) for r in L.page_kinds(w, pages).collect()} == {(1, "text", None), (2, "scanned", "[SCANNED PAGE 2 - OCR REQUIRED]"), (3, "error", "[EXTRACTION ERROR: Page 3]"), (4, "blank", "")}
    assert {r.rotated for r in L.tagged_rotation(w, pages).collect()} == {90}


def test_settings_decide_the_plan(spark):
    rows = [word(0, "HEAD", 0, 0), word(1, "text", 0, 500), word(2, "12", 0, 600), word(3, "12", 0, 995)]
    w = spark.createDataFrame(rows, WORDS)
    text = lambda s: extraction.page_texts(w, s).first().page_text.split()
    assert text(PROFILES["bare"]) == ["HEAD", "text", "12", "12"] and text(PROFILES["legacy"]) == ["text"]
    assert "HEAD" not in text(PROFILES["default"]) and "text" in text(PROFILES["default"])
    assert extraction.page_texts(w, Settings(column_gap=5.0, remove_headers=False)).count() == 1


def test_formatted_parts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    rows = F.array(F.array(F.lit("ab"), F.lit("c")), F.array(F.lit("1"), F.lit("2")))
    assert one(M.formatted_table(rows, F.lit("T"))) == "\n[TABLE: T]\nab | c\n------\n1 | 2\n[TABLE END]\n"
    assert one(M.formatted_table(F.array().cast("array<array<string>>"), F.lit("T"))) == ""
    assert one(M.with_quality_mark(F.lit("abc"), "uncertain", F.lit(1))) == "a[UNCERTAIN]bc" and one(M.with_quality_mark(F.lit("abc"), "nothing")) == "abc"
    assert one(M.byte_size(F.lit(1536))) == "1.5 KB" and one(M.byte_size(F.lit(12))) == "12 B" and one(M.percent(F.lit(0.1234))) == "12.3%"
    assert one(M.document_footer(F.lit(2), F.lit(1234), F.lit(None).cast("int"), F.lit(1.5))).split("\n")[4:7] == ["Total Pages: 2", "Total Words: 1,234", "Extraction Time: 1.50s"]
    assert one(T.method_marked_table(rows, F.lit("t"), F.lit("lines"), F.lit(0.95))) == "[TABLE: 2x2 | lines | 95%]\nt\n[TABLE END]"


def test_recovery(spark):
    errors = spark.createDataFrame([(1, 1, "scanned_page", "high"), (1, 2, "rotated_page", "medium"), (2, 1, "overlapping_text", "low")], "doc_id long, page_number int, error_type string, severity string")
    got = {r.doc_id: r for r in R.recovery_report(errors, spark.createDataFrame([(1, 2)], "doc_id long, page int")).collect()}
    assert (got[1].recovered, got[1].recovery_rate) == (1, 0.5) and got[1].recommendations.split("\n")[0] == "Some pages may have incomplete extraction"
    assert got[2].recommendations == "Review overlapping text - may need manual cleanup"


def test_page_dumps(spark, tmp_path):
    page = {"path": "a", "page": 1, "rotation": 90, "raw_text": "raw", "words": [{"text": "w", "x0": 1.0, "top": 2.0, "x1": 3.0, "bottom": 4.0}], "chars": [{"text": "w"}], "rects": [{"x0": 0.0, "top": 0.0, "x1": 60.0, "bottom": 30.0}], "tables": [{"method": "relaxed", "x0": 0.0, "top": 0.0, "x1": 9.0, "bottom": 9.0, "rows": [["a"]]}]}
    bare = {"path": "a", "page": 2, "rotation": 0, "raw_text": "raw", "words": [], "chars": [], "rects": [], "tables": []}
    (tmp_path / "p.json").write_text(json.dumps(page) + "\n" + json.dumps(bare) + "\n{broken\n")
    pages = D.page_dumps(spark, str(tmp_path))
    assert pages.count() == 2
    assert [r.text for r in D.dumped(pages, "words").collect()] == ["w"] and D.dumped(pages, "rects").count() == 1
    assert [r.confidence for r in D.dumped(pages, "tables").collect()] == [0.85]
    ladder = D.recovered(D.dump_ladder(pages), "simple_extraction", "char_extraction", "raw_extraction")
    assert {(r.page, r.recovery_method, r.page_text) for r in ladder.collect()} == {(1, "simple_extraction", "w"), (2, "raw_extraction", "raw")}


def test_text_tree(spark, tmp_path):
    df = spark.createDataFrame([("in/a.pdf", "one"), ("in/sub/b.pdf", None), (None, "x")], "path string, text string")
    S.write_text_tree(df, "path", "text", str(tmp_path))
    assert {str(p.relative_to(tmp_path)): p.read_text() for p in Path(tmp_path).rglob("*.txt")} == {"in/a.txt": "one", "in/sub/b.txt": ""}
    S.write_texts(df, "path", "text", str(tmp_path / "rows"), 2)
    assert {(r.path, r.text) for r in spark.read.json(str(tmp_path / "rows")).collect()} == {("in/a.pdf", "one"), ("in/sub/b.pdf", ""), (None, "x")}


def test_wide_and_long_tables(spark):
    cells = [(1, 1, 0, r, c, f"{r}.{c}", 0.9) for r in range(3) for c in range(70)]
    df = spark.createDataFrame(cells, "doc_id long, page int, table_ix int, row_no int, col_no int, text string, confidence double").withColumns({k: F.lit(0.0) for k in ("x0", "top", "x1", "bottom")})
    r = T.assemble(df).select("n_cols", T.to_tabs(F.col("rows")).alias("t"), T.is_valid_text_table(F.col("rows"), F.col("confidence")).alias("v")).first()
    assert r.n_cols == 70 and r.t.split("\n")[2].split("\t")[69] == "2.69" and r.v is False
