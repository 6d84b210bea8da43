"""Queries over positioned words and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import layout as L
from leafmill.sources.tables import read_table

WORDS_SQL = """w AS (SELECT DISTINCT ON (doc_id, page, word_ix) * FROM words WHERE trim(text) <> '')"""
SIZES_SQL = """z AS (SELECT doc_id, page, max(x1) AS width, max(bottom) AS page_height FROM w GROUP BY ALL)"""
JP = "[\\x{3040}-\\x{30FF}\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}]"
LINED_SQL = """
    c0 AS (SELECT *, CASE WHEN x0 - lag(x1) OVER o > 50 THEN 1 ELSE 0 END AS nc FROM w WINDOW o AS (PARTITION BY doc_id, page ORDER BY x0, word_ix)),
    c AS (SELECT *, sum(nc) OVER (PARTITION BY doc_id, page ORDER BY x0, word_ix ROWS UNBOUNDED PRECEDING)::BIGINT AS column_no FROM c0),
    l0 AS (SELECT *, CASE WHEN abs(top - lag(top) OVER o) >= 15 THEN 1 ELSE 0 END AS nl FROM c WINDOW o AS (PARTITION BY doc_id, page, column_no ORDER BY top, x0, word_ix)),
    l AS (SELECT *, sum(nl) OVER (PARTITION BY doc_id, page, column_no ORDER BY top, x0, word_ix ROWS UNBOUNDED PRECEDING)::BIGINT AS line_no FROM l0)"""
SPACED_SQL = f"""
    s0 AS (SELECT *, lag(text) OVER o AS pt, x0 - lag(x1) OVER o AS gap FROM l WINDOW o AS (PARTITION BY doc_id, page, column_no, line_no ORDER BY x0, word_ix)),
    s AS (SELECT *, CASE WHEN gap IS NULL OR gap < 2 THEN false
        WHEN regexp_matches(right(pt, 1), '{JP}') AND regexp_matches(left(text, 1), '{JP}') THEN gap > 10
        WHEN contains('{L.NO_SPACE_AFTER}', right(pt, 1)) OR contains('{L.NO_SPACE_BEFORE}', left(text, 1)) THEN false ELSE gap > 3 END AS sp FROM s0),
    t AS (SELECT doc_id, page, column_no, line_no, string_agg((CASE WHEN sp THEN ' ' ELSE '' END) || text, '' ORDER BY x0, word_ix) AS line_text FROM s GROUP BY ALL)"""


def words(spark: SparkSession, d: str) -> DataFrame:
    return L.clean_words(read_table(spark, d, "words"))


def lined(spark: SparkSession, d: str) -> DataFrame:
    return L.lines(L.columns(words(spark, d)))


def words_columns(spark: SparkSession, d: str) -> DataFrame:
    return L.columns(words(spark, d)).select(*L.WORD, "column_no")


def words_lines(spark: SparkSession, d: str) -> DataFrame:
    return lined(spark, d).select(*L.WORD, "column_no", "line_no")


def line_text(spark: SparkSession, d: str) -> DataFrame:
    return L.line_texts(lined(spark, d))


def page_text(spark: SparkSession, d: str) -> DataFrame:
    return L.page_texts(L.line_texts(lined(spark, d)))


def word_bands(spark: SparkSession, d: str) -> DataFrame:
    return L.bands(words(spark, d)).select(*L.PAGE, "band_no", "first_top", F.explode("word_ixs").alias("word_ix"))


def word_kinds(spark: SparkSession, d: str) -> DataFrame:
    return words(spark, d).groupBy(F.col("text").rlike(L.SECTION_NUMBER).alias("is_section"), F.col("text").rlike(L.FOOTNOTE_MARKER).alias("is_footnote"), F.col("text").rlike(L.JAPANESE).alias("is_japanese")).agg(F.count("*").alias("n_words"))


def zone_texts(spark: SparkSession, d: str) -> DataFrame:
    w = words(spark, d)
    return L.zone_strings(w, None)


def repeating_headers(spark: SparkSession, d: str) -> DataFrame:
    w = words(spark, d)
    return L.repeating_zones(L.zone_strings(w, None), w)


def nearby_words(spark: SparkSession, d: str) -> DataFrame:
    w = words(spark, d)
    return L.near_words(w.where(F.col("text").rlike(r"^\d+$")), w).select(*L.WORD)


def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    w = words(spark, d)
    return L.metadata_filter(w, None, L.repeating_zones(L.zone_strings(w, None), w)).select(*L.WORD, "rule", "keep")


def same_line_markers(spark: SparkSession, d: str) -> DataFrame:
    return L.same_line_markers(words(spark, d)).select(*L.WORD)


def table_boxes(spark: SparkSession, d: str) -> DataFrame:
    cells = read_table(spark, d, "table_cells")
    return cells.groupBy("doc_id", F.col("page_number").alias("page"), "table_ix").agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))


def words_outside_tables(spark: SparkSession, d: str) -> DataFrame:
    return L.outside_tables(words(spark, d), table_boxes(spark, d)).select(*L.WORD)


def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    return L.overlap_pairs(words(spark, d))


def overlap_pairs_slight(spark: SparkSession, d: str) -> DataFrame:
    """As overlap_pairs, from a tenth of the smaller box on."""
    return L.overlap_pairs(words(spark, d), 0.1)


def recurring_headers(spark: SparkSession, d: str) -> DataFrame:
    """As repeating_headers, from three pages in ten on."""
    w = words(spark, d)
    return L.repeating_zones(L.zone_strings(w, None), w, share=0.3)


def inventory_by_page(spark: SparkSession, d: str) -> DataFrame:
    w = words(spark, d)
    return L.inventory(w, None)


def size_distribution(spark: SparkSession, d: str) -> DataFrame:
    return L.size_distribution(words(spark, d))


def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    w = words(spark, d)
    results = read_table(spark, d, "extraction_results").dropDuplicates(["doc_id"]).select("doc_id", F.coalesce("word_count", F.lit(0)).alias("n_words"))
    return L.coverage(L.inventory(w, None), results)


def trimmed_font_size(spark: SparkSession, d: str) -> DataFrame:
    return L.trimmed_sizes(words(spark, d)).select(*L.PAGE, F.round("average_size", 6).alias("average_size"))


def mean_font_size(spark: SparkSession, d: str) -> DataFrame:
    return words(spark, d).groupBy(*L.PAGE).agg(F.round(F.avg(F.coalesce("size", "height", F.lit(10.0))), 6).alias("mean_size"))


def marked(spark: SparkSession, d: str) -> DataFrame:
    w = words(spark, d)
    return L.script_markup(L.scripts(w, L.trimmed_sizes(w)))


def word_scripts(spark: SparkSession, d: str) -> DataFrame:
    return marked(spark, d).select(*L.WORD, F.round("relative_size", 6).alias("relative_size"), F.round("baseline_offset", 6).alias("baseline_offset"), "is_superscript", "is_subscript", "preceding_text", "following_text", "markup")


def script_statistics(spark: SparkSession, d: str) -> DataFrame:
    n = F.count("*")
    return marked(spark, d).groupBy("doc_id").agg(n.alias("n_words"), F.count_if("is_superscript").alias("n_superscript"), F.count_if("is_subscript").alias("n_subscript"), F.round(100.0 * F.count_if("is_superscript") / n, 6).alias("superscript_percent"))


def attached_scripts(spark: SparkSession, d: str) -> DataFrame:
    return L.attach_scripts(words(spark, d))


def column_clusters(spark: SparkSession, d: str) -> DataFrame:
    return L.clusters(words(spark, d), L.PAGE, "x0", 5.0, 3).select(*L.PAGE, "cluster_no", F.round("mean", 6).alias("mean"), "n")


def gap_regularity(spark: SparkSession, d: str) -> DataFrame:
    return L.gap_regularity(words(spark, d)).select(*L.PAGE, "n_gaps", F.round("regularity", 6).alias("regularity"))


QUERIES = [
    words_columns, words_lines, line_text, page_text, word_bands, word_kinds, zone_texts, repeating_headers, nearby_words, metadata_filter, same_line_markers, words_outside_tables, overlap_pairs, overlap_pairs_slight, recurring_headers,
    inventory_by_page, size_distribution, coverage_report, trimmed_font_size, mean_font_size, word_scripts, script_statistics, attached_scripts, column_clusters, gap_regularity,
]

SECTION_RE2 = r"^(?:\d+\.\d+|\(\d+\)|[①-⑳]|\d+[)）]|第?\d+[章条項節款目]|\d+\.|[一二三四五六七八九十]+[、.])"
FOOTNOTE_RE2 = r"^(?:\*\d+|※\d+|注\d+|†|‡|\[\d+\]|\(\*?\d+\))"
ZONES_SQL = """zt AS (SELECT doc_id, page, zone, string_agg(text, ' ' ORDER BY word_ix) AS zone_text FROM (
        SELECT w.*, CASE WHEN top < 0.1 * page_height THEN 'top' WHEN top > (1 - 0.1) * page_height THEN 'bottom' END AS zone FROM w JOIN z USING (doc_id, page)) WHERE zone IS NOT NULL GROUP BY ALL)"""
REPEATED_SQL = """rz AS (SELECT c.* FROM (
        SELECT doc_id, zone, zone_text, count(*) AS n_pages FROM zs GROUP BY ALL) c JOIN (SELECT doc_id, zone, count(*) AS n FROM zs GROUP BY ALL) t USING (doc_id, zone) WHERE c.n_pages >= 0.8 * t.n)"""
SAMPLED_SQL = """zs AS (SELECT * FROM zt WHERE page <= 5 AND doc_id IN (SELECT doc_id FROM w GROUP BY doc_id HAVING count(DISTINCT page) >= 3))"""
NEAR = "sqrt(pow((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2, 2) + pow((a.top + a.bottom) / 2 - (b.top + b.bottom) / 2, 2)) < {}"
OTHER = "(a.text, a.x0, a.top, a.x1, a.bottom) IS DISTINCT FROM (b.text, b.x0, b.top, b.x1, b.bottom)"
SIZE_SQL = """sz AS (SELECT doc_id, page, word_ix, list(size) OVER p AS ss, list(height) OVER p AS hh FROM w WINDOW p AS (PARTITION BY doc_id, page)),
    av AS (SELECT doc_id, page, CASE WHEN len(v) = 0 THEN 12.0 ELSE list_avg(v[(len(v) // 10) + 1 : len(v) - (len(v) // 10)]) END AS average_size FROM (
        SELECT doc_id, page, CASE WHEN count(*) FILTER (size > 0) > 0 THEN list_sort(list(size) FILTER (size > 0)) ELSE coalesce(list_sort(list(height) FILTER (height > 0)), []) END AS v FROM w GROUP BY ALL))"""
SCRIPTS_SQL = """m0 AS (SELECT w.*, coalesce(size, height, 0.0) / average_size AS relative_size, lag(text) OVER o AS preceding_text, lead(text) OVER o AS following_text,
        CASE WHEN lag(coalesce(size, height, 0.0)) OVER o > 0 THEN (top - lag(top) OVER o) / lag(coalesce(size, height, 0.0)) OVER o ELSE 0.0 END AS baseline_offset
        FROM w JOIN av USING (doc_id, page) WINDOW o AS (PARTITION BY doc_id, page ORDER BY top, x0, word_ix)),
    m1 AS (SELECT *, relative_size < 0.7 AND (baseline_offset < -0.2 OR regexp_matches(text, '^(?:[⁰¹²³⁴⁵⁶⁷⁸⁹]+|\\*[0-9]+|\\[[0-9]+\\])$') OR coalesce(preceding_text IN ('*', '†', '‡', '※'), false)) AS is_superscript FROM m0),
    m AS (SELECT *, relative_size < 0.7 AND NOT is_superscript AND (baseline_offset > 0.2 OR regexp_matches(text, '^[₀₁₂₃₄₅₆₇₈₉]+$')) AS is_subscript FROM m1)"""

ORACLES = {
    "words_columns": f"WITH {WORDS_SQL}, {LINED_SQL} SELECT doc_id, page, word_ix, column_no FROM c",
    "words_lines": f"WITH {WORDS_SQL}, {LINED_SQL} SELECT doc_id, page, word_ix, column_no, line_no FROM l",
    "line_text": f"WITH {WORDS_SQL}, {LINED_SQL}, {SPACED_SQL} SELECT doc_id, page, column_no, line_no, line_text FROM t",
    "page_text": f"""WITH {WORDS_SQL}, {LINED_SQL}, {SPACED_SQL}
        SELECT doc_id, page, string_agg(ct, chr(10) || chr(10) ORDER BY column_no) AS page_text FROM (SELECT doc_id, page, column_no, string_agg(line_text, chr(10) ORDER BY line_no) AS ct FROM t GROUP BY ALL) GROUP BY ALL""",
    "word_bands": f"""WITH RECURSIVE {WORDS_SQL}, o AS (SELECT doc_id, page, word_ix, top, row_number() OVER (PARTITION BY doc_id, page ORDER BY top, x0, word_ix) AS rn FROM w),
        b AS (SELECT doc_id, page, word_ix, rn, top AS first_top, 0 AS band_no FROM o WHERE rn = 1
            UNION ALL SELECT o.doc_id, o.page, o.word_ix, o.rn, CASE WHEN abs(o.top - b.first_top) <= 15 THEN b.first_top ELSE o.top END, b.band_no + CASE WHEN abs(o.top - b.first_top) <= 15 THEN 0 ELSE 1 END
            FROM b JOIN o ON o.doc_id = b.doc_id AND o.page = b.page AND o.rn = b.rn + 1)
        SELECT doc_id, page, band_no, first_top, word_ix FROM b""",
    "word_kinds": f"WITH {WORDS_SQL} SELECT regexp_matches(text, '{SECTION_RE2}') AS is_section, regexp_matches(text, '{FOOTNOTE_RE2}') AS is_footnote, regexp_matches(text, '{JP}') AS is_japanese, count(*) AS n_words FROM w GROUP BY ALL",
    "zone_texts": f"WITH {WORDS_SQL}, {SIZES_SQL}, {ZONES_SQL} SELECT * FROM zt",
    "repeating_headers": f"WITH {WORDS_SQL}, {SIZES_SQL}, {ZONES_SQL}, {SAMPLED_SQL}, {REPEATED_SQL} SELECT doc_id, zone, zone_text, n_pages FROM rz",
    "nearby_words": f"WITH {WORDS_SQL} SELECT a.doc_id, a.page, a.word_ix FROM w a WHERE regexp_matches(a.text, '^[0-9]+$') AND EXISTS (SELECT 1 FROM w b WHERE b.doc_id = a.doc_id AND b.page = a.page AND {OTHER} AND {NEAR.format(50)})",
    "metadata_filter": f"""WITH {WORDS_SQL}, {SIZES_SQL}, {ZONES_SQL}, {SAMPLED_SQL}, {REPEATED_SQL},
        e AS (SELECT w.*, width, page_height, CASE WHEN top < 0.1 * page_height THEN 'top' WHEN top > 0.9 * page_height THEN 'bottom' END AS zone FROM w JOIN z USING (doc_id, page)),
        n AS (SELECT a.* FROM e a WHERE regexp_matches(text, '^[0-9]+$') AND zone IS NOT NULL AND (abs((x0 + x1) / 2 - width / 2) < 0.2 * width OR x0 < 0.2 * width OR x1 > 0.8 * width)
            AND NOT EXISTS (SELECT 1 FROM w b WHERE b.doc_id = a.doc_id AND b.page = a.page AND {OTHER} AND {NEAR.format(50)})),
        r AS (SELECT e.doc_id, e.page, e.word_ix, CASE WHEN regexp_matches(text, '{SECTION_RE2}') THEN 'section' WHEN regexp_matches(text, '{FOOTNOTE_RE2}') THEN 'footnote'
            WHEN regexp_matches(lower(text), '^(?:page\\s*[0-9]+|p\\.\\s*[0-9]+|-\\s*[0-9]+\\s*-|[0-9]+\\s*/\\s*[0-9]+|[0-9]+\\s*ページ|[0-9]+\\s*頁)$') THEN 'page_number'
            WHEN EXISTS (SELECT 1 FROM rz WHERE rz.doc_id = e.doc_id AND rz.zone = e.zone) THEN 'repeated'
            WHEN (e.doc_id, e.page, e.word_ix) IN (SELECT (doc_id, page, word_ix) FROM n) AND length(text) <= 3 THEN 'lonely_number'
            WHEN top < 0.05 * page_height THEN CASE WHEN coalesce(height, 0.0) > 14 THEN 'top_large' ELSE 'top_margin' END
            WHEN top > 0.9 * page_height AND (e.doc_id, e.page, e.word_ix) IN (SELECT (doc_id, page, word_ix) FROM n) THEN 'bottom_number' ELSE 'body' END AS rule FROM e)
        SELECT *, rule IN ('section', 'footnote', 'top_large', 'body') AS keep FROM r""",
    "same_line_markers": f"WITH {WORDS_SQL} SELECT a.doc_id, a.page, a.word_ix FROM w a WHERE EXISTS (SELECT 1 FROM w b WHERE b.doc_id = a.doc_id AND b.page = a.page AND b.word_ix <> a.word_ix AND regexp_matches(b.text, '{FOOTNOTE_RE2}') AND abs(a.top - b.top) < 20)",
    "words_outside_tables": f"""WITH {WORDS_SQL}, t AS (SELECT doc_id, page_number AS page, table_ix, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom FROM table_cells GROUP BY ALL)
        SELECT doc_id, page, word_ix FROM w WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = w.doc_id AND t.page = w.page AND (w.x0 + w.x1) / 2 BETWEEN t.x0 AND t.x1 AND (w.top + w.bottom) / 2 BETWEEN t.top AND t.bottom)""",
    "overlap_pairs": f"""WITH {WORDS_SQL}, p AS (SELECT a.doc_id, a.page, a.word_ix AS word_a, b.word_ix AS word_b, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) AS wide, (least(a.bottom, b.bottom) - greatest(a.top, b.top)) AS high,
            least((a.x1 - a.x0) * (a.bottom - a.top), (b.x1 - b.x0) * (b.bottom - b.top)) AS smaller FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.page = b.page AND a.word_ix < b.word_ix)
        SELECT doc_id, page, word_a, word_b FROM p WHERE wide > 0 AND high > 0 AND smaller > 0 AND wide * high > 0.5 * smaller""",
    "overlap_pairs_slight": f"""WITH {WORDS_SQL}, p AS (SELECT a.doc_id, a.page, a.word_ix AS word_a, b.word_ix AS word_b, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) AS wide, (least(a.bottom, b.bottom) - greatest(a.top, b.top)) AS high,
            least((a.x1 - a.x0) * (a.bottom - a.top), (b.x1 - b.x0) * (b.bottom - b.top)) AS smaller FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.page = b.page AND a.word_ix < b.word_ix)
        SELECT doc_id, page, word_a, word_b FROM p WHERE wide > 0 AND high > 0 AND smaller > 0 AND wide * high > 0.1 * smaller""",
    "recurring_headers": f"WITH {WORDS_SQL}, {SIZES_SQL}, {ZONES_SQL}, {SAMPLED_SQL}, {REPEATED_SQL} SELECT doc_id, zone, zone_text, n_pages FROM rz".replace("0.8 * t.n", "0.3 * t.n"),
    "inventory_by_page": f"""WITH {WORDS_SQL}, {SIZES_SQL} SELECT doc_id, page, count(*) AS total, count(*) FILTER (top < 0.15 * page_height) AS top_region, count(*) FILTER (top >= 0.15 * page_height AND top <= 0.85 * page_height) AS middle_region,
        count(*) FILTER (top > 0.85 * page_height) AS bottom_region, count(*) FILTER (s > 18) AS large_text, count(*) FILTER (s >= 10 AND s <= 18) AS standard_text, count(*) FILTER (s >= 6 AND s < 10) AS small_text, count(*) FILTER (s < 6) AS tiny_text
        FROM (SELECT w.*, page_height, coalesce(size, height, 0.0) AS s FROM w JOIN z USING (doc_id, page)) GROUP BY ALL""",
    "size_distribution": f"WITH {WORDS_SQL} SELECT doc_id, page, coalesce(w.size, height) AS size, count(*) AS n_words FROM w GROUP BY ALL",
    "coverage_report": f"""WITH {WORDS_SQL}, {SIZES_SQL}, e AS (SELECT doc_id, count(*) AS expected, count(*) FILTER (top < 0.15 * page_height) AS top_region, count(*) FILTER (top >= 0.15 * page_height AND top <= 0.85 * page_height) AS middle_region, count(*) FILTER (top > 0.85 * page_height) AS bottom_region,
            count(*) FILTER (s > 18) AS large_text, count(*) FILTER (s >= 10 AND s <= 18) AS standard_text, count(*) FILTER (s >= 6 AND s < 10) AS small_text, count(*) FILTER (s < 6) AS tiny_text FROM (SELECT w.*, page_height, coalesce(size, height, 0.0) AS s FROM w JOIN z USING (doc_id, page)) GROUP BY doc_id),
        r AS (SELECT DISTINCT doc_id, coalesce(word_count, 0) AS n FROM extraction_results),
        j AS (SELECT e.*, coalesce(n, 0) AS extracted, coalesce(n, 0) * 100.0 / expected AS share, greatest(expected - coalesce(n, 0), 0) AS missing FROM e LEFT JOIN r USING (doc_id))
        SELECT doc_id, expected, extracted, missing, round(share, 2) AS coverage_percent, round(missing * 100.0 / expected, 2) AS missing_percent, CASE WHEN share >= 85 THEN 'GOOD' WHEN share >= 70 THEN 'WARNING' ELSE 'POOR' END AS status, top_region, middle_region, bottom_region, large_text, standard_text, small_text, tiny_text FROM j""",
    "trimmed_font_size": f"WITH {WORDS_SQL}, {SIZE_SQL} SELECT doc_id, page, round(average_size, 6) AS average_size FROM av",
    "mean_font_size": f"WITH {WORDS_SQL} SELECT doc_id, page, round(avg(coalesce(size, height, 10.0)), 6) AS mean_size FROM w GROUP BY ALL",
    "word_scripts": f"WITH {WORDS_SQL}, {SIZE_SQL}, {SCRIPTS_SQL} SELECT doc_id, page, word_ix, round(relative_size, 6) AS relative_size, round(baseline_offset, 6) AS baseline_offset, is_superscript, is_subscript, preceding_text, following_text, CASE WHEN is_superscript THEN '^{{' || text || '}}' WHEN is_subscript THEN '_{{' || text || '}}' ELSE text END AS markup FROM m",
    "script_statistics": f"WITH {WORDS_SQL}, {SIZE_SQL}, {SCRIPTS_SQL} SELECT doc_id, count(*) AS n_words, count(*) FILTER (is_superscript) AS n_superscript, count(*) FILTER (is_subscript) AS n_subscript, round(100.0 * count(*) FILTER (is_superscript) / count(*), 6) AS superscript_percent FROM m GROUP BY doc_id",
    "column_clusters": f"""WITH {WORDS_SQL}, g0 AS (SELECT doc_id, page, x0, CASE WHEN x0 - lag(x0) OVER (PARTITION BY doc_id, page ORDER BY x0) > 5 THEN 1 ELSE 0 END AS nn FROM w),
        g AS (SELECT *, sum(nn) OVER (PARTITION BY doc_id, page ORDER BY x0 RANGE UNBOUNDED PRECEDING)::BIGINT AS cluster_no FROM g0)
        SELECT doc_id, page, cluster_no, round(avg(x0), 6) AS mean, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 3""",
    "gap_regularity": f"""WITH {WORDS_SQL}, e AS (SELECT DISTINCT doc_id, page, x0 FROM w), g AS (SELECT doc_id, page, x0 - lag(x0) OVER (PARTITION BY doc_id, page ORDER BY x0) AS gap FROM e)
        SELECT doc_id, page, count(*) AS n_gaps, round(1 - stddev_samp(gap) / avg(gap), 6) AS regularity FROM g WHERE gap > 15 GROUP BY ALL HAVING count(*) >= 2""",
}
