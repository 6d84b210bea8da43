"""Queries over several reports at once, and of the finer operators, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import chunking as C
from leafmill.operators import footnotes as N
from leafmill.operators import formatting as M
from leafmill.operators import layout as L
from leafmill.operators import reports as R
from leafmill.operators import tables as T
from leafmill.operators import textops as X
from leafmill.plans import extraction
from leafmill.plans import layout_queries as LQ
from leafmill.plans import report_queries as RQ
from leafmill.plans import text_queries as TQ
from leafmill.settings import PROFILES
from leafmill.sources.decoders import recovered
from leafmill.sources.tables import read_table


def reported(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text, with its coverage of the words laid out, the match rate of its footnotes and its number of tables."""
    r = RQ.results(spark, d).select("doc_id", "raw_text", "page_count")
    covered = LQ.coverage_report(spark, d).select("doc_id", "coverage_percent")
    notes = RQ.footnote_report(spark, d).select("doc_id", "match_rate")
    tables = RQ.assembled(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_tables"))
    return r.join(covered, "doc_id", "left").join(notes, "doc_id", "left").join(tables, "doc_id", "left")


def scored(texts: DataFrame) -> DataFrame:
    return X.quality_dimensions(texts, "raw_text", "page_count", "coverage_percent", "match_rate", "n_tables").withColumn("overall", X.quality_overall())


def quality_score(spark: SparkSession, d: str) -> DataFrame:
    """The quality of every document by its text and its reports."""
    return TQ.quality_columns(scored(reported(spark, d)))


def remediation_best(spark: SparkSession, d: str, least: float = 70.0) -> DataFrame:
    """Each document under `least` as it is and in two cleaned variants; the best is kept, of a tie the earliest. Others aren't tried again."""
    inputs = reported(spark, d)
    t = F.col("raw_text")
    poor = scored(inputs).where(F.round("overall", 6) < least).select(*inputs.columns)
    variants = F.array(*(F.struct(F.lit(k).alias("attempt"), v.alias("text")) for k, v in enumerate([t, X.without_invented(t), X.cleanup(X.without_invented(t))])))
    tried = poor.withColumn("_v", F.explode(variants)).withColumns({"attempt": F.col("_v.attempt"), "raw_text": F.col("_v.text")}).drop("_v")
    return X.best_variant(scored(tried).select("doc_id", "attempt", F.round("overall", 6).alias("score")), ["doc_id"]).select("doc_id", "attempt", "score")


def remediation_under_95(spark: SparkSession, d: str) -> DataFrame:
    """As remediation_best, of documents under 95."""
    return remediation_best(spark, d, 95.0)


def footnote_content(spark: SparkSession, d: str) -> DataFrame:
    return L.footnote_content(LQ.words(spark, d)).select(*L.WORD, "rule")


def footnote_line_texts(spark: SparkSession, d: str) -> DataFrame:
    w = LQ.words(spark, d)
    return N.footnote_lines(w, L.page_sizes(w))


def footnote_line_spans(spark: SparkSession, d: str) -> DataFrame:
    """Definitions in the lines of the pages' lower parts."""
    return N.definition_spans(footnote_line_texts(spark, d), L.PAGE, "line_no", "line_text")


def words_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    return L.without_repeated_places(LQ.words(spark, d)).select(*L.WORD)


def page_kinds(spark: SparkSession, d: str) -> DataFrame:
    return L.page_kinds(LQ.words(spark, d), R.clean_pages(read_table(spark, d, "page_analysis")))


def words_rotated(spark: SparkSession, d: str) -> DataFrame:
    """Words of rotated pages, with the angle."""
    pages = read_table(spark, d, "page_analysis").dropDuplicates(["doc_id", "page_number"])
    return L.tagged_rotation(LQ.words(spark, d), pages).where("rotated <> 0").select(*L.WORD, "rotated")


def pages_by_profile(spark: SparkSession, d: str) -> DataFrame:
    """How many pages have text, and how much, under each profile of settings."""
    w, made = LQ.words(spark, d), None
    for name, settings in PROFILES.items():
        texts = extraction.page_texts(w, settings).agg(F.count("*").alias("n_pages"), F.sum(F.length("page_text")).alias("n_chars")).select(F.lit(name).alias("profile"), "n_pages", "n_chars")
        made = texts if made is None else made.unionByName(texts)
    return made


def page_texts_bare(spark: SparkSession, d: str) -> DataFrame:
    """Page texts under the profile that filters and repairs nothing."""
    return extraction.page_texts(LQ.words(spark, d), PROFILES["bare"])


def tables_by_method(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of tables by how they were found: by whole grids, or by cells that line up."""
    t = RQ.assembled(spark, d).withColumn("method", F.when(T.fill_share(F.col("rows")) == 1, "lines").otherwise("alignment"))
    return T.method_summary(t)


def table_rows_aligned(spark: SparkSession, d: str) -> DataFrame:
    w = LQ.words(spark, d)
    return T.aligned_rows(w, L.clusters(w, L.PAGE, "x0", 5.0, 3)).select(*L.PAGE, "cluster_no", F.round("mean", 4).alias("mean"), "n")


def table_texts_marked(spark: SparkSession, d: str) -> DataFrame:
    """Tables with bars, under a title, and between marks that tell their method and how sure they are."""
    t, rows = RQ.assembled(spark, d), F.col("rows")
    title = F.concat(F.lit("Table "), F.col("table_ix").cast("string"))
    return t.select(*T.TABLE, M.formatted_table(rows, title).alias("titled"), T.method_marked_table(rows, T.to_tabs(rows), F.lit("lines"), F.col("confidence")).alias("marked"))


def regions_ordered(spark: SparkSession, d: str) -> DataFrame:
    w, t = LQ.words(spark, d), RQ.assembled(spark, d)
    rects = RQ.rectangles(w)
    boxes = T.boxes(w, rects, t).join(rects, ["doc_id", "page", "rect_ix"]).select("doc_id", "page", "x0", "top")
    return T.ordered_regions(T.regions(t.select("doc_id", "page", "x0", "top"), boxes)).select("doc_id", "page", "place", "region_type", "top", "x0")


def recovery_report(spark: SparkSession, d: str) -> DataFrame:
    """Errors of each document, those whose page has words counting as recovered."""
    return R.recovery_report(RQ.page_errors(spark, d), LQ.words(spark, d).select("doc_id", "page").distinct())


def pages_laddered(spark: SparkSession, d: str) -> DataFrame:
    """Every page from the first of three sources that has text: its delivered text, its words, the chunks of the document."""
    pages = RQ.result_pages(spark, d)
    laid = LQ.page_text(spark, d).withColumnRenamed("page_text", "words")
    chunk = RQ.clean_chunks(spark, d).select("doc_id", F.col("page_start").alias("page"), F.col("content").alias("chunk")).groupBy("doc_id", "page").agg(F.min("chunk").alias("chunk"))
    joined = pages.join(laid, ["doc_id", "page"], "left").join(chunk, ["doc_id", "page"], "left")
    return recovered(joined, "text", "words", "chunk").select("doc_id", "page", "recovery_method", F.length("page_text").alias("n_chars"))


def chunks_by_sections(spark: SparkSession, d: str) -> DataFrame:
    return C.packed_by_sections(RQ.results(spark, d), ["doc_id"], "raw_text", 2000, 400).select("doc_id", "chunk_id", "start_pos", "end_pos", "content")


def format_footers(spark: SparkSession, d: str) -> DataFrame:
    r = RQ.results(spark, d)
    return r.select("doc_id", M.document_footer(F.col("page_count"), F.col("word_count"), F.length("raw_text"), F.col("extraction_time")).alias("footer"))


def flags_appended(spark: SparkSession, d: str) -> DataFrame:
    """The section of open flags of every document that has one."""
    rank = F.array_position(F.array(*map(F.lit, R.SEVERITIES)), F.col("severity"))
    lists = R.open_flags(RQ.flags(spark, d)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "flag_id", "severity", "page", "message"))).alias("_f"))
    return lists.select("doc_id", M.flags_section(F.col("_f")).alias("section"))


def notes_formatted(spark: SparkSession, d: str) -> DataFrame:
    notes = RQ.definitions(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "y", "footnote_id", "marker", "text"))).alias("_n"))
    return notes.select("doc_id", M.notes_block(F.col("_n")).alias("notes"))


def texts_marked(spark: SparkSession, d: str) -> DataFrame:
    """Low-confidence texts with a mark behind them, and sizes and shares as text."""
    r = RQ.results(spark, d).where("confidence < 0.5 AND raw_text IS NOT NULL")
    return r.select("doc_id", F.length(M.with_quality_mark(F.col("raw_text"), "uncertain")).alias("n_chars"), F.substring(M.with_quality_mark(F.col("raw_text"), "illegible", F.lit(3)), 1, 20).alias("head"), M.percent(F.floor(F.col("confidence") * 1000) / 1000).alias("share"), M.byte_size(F.octet_length("raw_text")).alias("size"))


QUERIES = [
    quality_score, remediation_best, remediation_under_95, footnote_content, footnote_line_texts, footnote_line_spans, words_deduplicated, page_kinds, words_rotated, pages_by_profile, page_texts_bare, tables_by_method, table_rows_aligned, table_texts_marked, regions_ordered, recovery_report, pages_laddered,
    chunks_by_sections, format_footers, flags_appended, notes_formatted, texts_marked,
]

BEGIN = "regexp_matches(trim(a.text), '^(?:\\*[0-9]*|※[0-9]*|注[0-9]*|†|‡|\\[[0-9]+\\]|\\([0-9]+\\)|[¹²³⁴⁵⁶⁷⁸⁹⁰])')"
FOOTNOTE_LINES = f"""{RQ.WORDS}, lw AS (SELECT w.*, row_number() OVER (PARTITION BY doc_id, page ORDER BY word_ix) AS rn FROM w JOIN z USING (doc_id, page) WHERE top >= 0.8 * page_height),
    fl AS (SELECT doc_id, page, rn, text, x0, word_ix, top AS anchor, 0 AS line_no FROM lw WHERE rn = 1
        UNION ALL SELECT lw.doc_id, lw.page, lw.rn, lw.text, lw.x0, lw.word_ix, CASE WHEN abs(lw.top - fl.anchor) >= 5 THEN lw.top ELSE fl.anchor END, fl.line_no + (abs(lw.top - fl.anchor) >= 5)::INT
        FROM fl JOIN lw ON lw.doc_id = fl.doc_id AND lw.page = fl.page AND lw.rn = fl.rn + 1),
    ft AS (SELECT doc_id, page, line_no, string_agg(text, ' ' ORDER BY x0, word_ix) AS line_text FROM fl GROUP BY ALL)"""
SPANS = lambda source, order: f"""sp AS (SELECT *, sum(regexp_matches(line_text, '{RQ.MARKER}')::INT) OVER (PARTITION BY doc_id, page ORDER BY {order} ROWS UNBOUNDED PRECEDING)::BIGINT AS definition_no FROM {source}),
    sw AS (SELECT doc_id, page, definition_no, string_agg(line_text, ' ' ORDER BY {order}) AS whole FROM sp WHERE definition_no > 0 GROUP BY ALL)
    SELECT doc_id, page, definition_no, regexp_extract(whole, '{RQ.MARKER}') AS marker, regexp_replace(whole, '{RQ.MARKER}[:： ]*', '') AS text FROM sw"""  # noqa: E731
REPORTED = f"""{RQ.RESULTS}, {RQ.CELLS}, cv AS ({LQ.ORACLES['coverage_report']}), fr AS ({RQ.ORACLES['footnote_report']}), tn AS (SELECT doc_id, count(*) AS n_tables FROM t GROUP BY doc_id),
    src AS (SELECT r.doc_id, r.raw_text, r.page_count, cv.coverage_percent, fr.match_rate, tn.n_tables FROM r LEFT JOIN cv USING (doc_id) LEFT JOIN fr USING (doc_id) LEFT JOIN tn USING (doc_id))"""
QUALITY = lambda source: TQ.quality_sql(source, "raw_text", "page_count", "coverage_percent", "match_rate", "n_tables")
REMEDIATED = f"""WITH {REPORTED}, lo AS (SELECT doc_id, raw_text, page_count, coverage_percent, match_rate, n_tables FROM ({QUALITY('src')}) WHERE round(overall, 6) < {{least}}),
    v AS (SELECT *, 0 AS attempt FROM lo UNION ALL SELECT * REPLACE ({TQ.invented_sql('raw_text')} AS raw_text), 1 FROM lo UNION ALL SELECT * REPLACE ({TQ.cleanup_sql(TQ.invented_sql('raw_text'))} AS raw_text), 2 FROM lo)
    SELECT doc_id, attempt, round(overall, 6) AS score FROM ({QUALITY('v')}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(overall, 6) DESC, attempt) = 1"""

ORACLES = {
    "quality_score": f"WITH {REPORTED} SELECT {TQ.QUALITY_COLUMNS.format(grade=TQ.GRADE_SQL)} FROM ({QUALITY('src')})",
    "remediation_best": REMEDIATED.replace("{least}", "70"),
    "remediation_under_95": REMEDIATED.replace("{least}", "95"),
    "footnote_content": f"""WITH {RQ.WORDS} SELECT * FROM (SELECT doc_id, page, word_ix, CASE WHEN {BEGIN} THEN 'marker'
            WHEN EXISTS (SELECT 1 FROM w b WHERE b.doc_id = a.doc_id AND b.page = a.page AND b.word_ix <> a.word_ix AND abs(a.top - b.top) < 20 AND {BEGIN.replace('a.text', 'b.text')}) THEN 'beside_marker'
            WHEN regexp_matches(trim(text), '{L.FOOTNOTE_PHRASES}') THEN 'phrase' WHEN length(trim(text)) > 10 THEN 'long' END AS rule FROM w a) WHERE rule IS NOT NULL""",
    "footnote_line_texts": f"WITH RECURSIVE {FOOTNOTE_LINES} SELECT * FROM ft",
    "footnote_line_spans": f"WITH RECURSIVE {FOOTNOTE_LINES}, {SPANS('ft', 'line_no')}",
    "footnote_spans": f"WITH {LQ.WORDS_SQL}, {LQ.LINED_SQL}, {LQ.SPACED_SQL}, {SPANS('t', 'column_no, line_no')}",
    "words_deduplicated": f"WITH {RQ.WORDS} SELECT doc_id, page, word_ix FROM w QUALIFY row_number() OVER (PARTITION BY doc_id, page, round(x0, 1), round(top, 1), text ORDER BY top, x0, word_ix) = 1",
    "page_kinds": f"""WITH {RQ.WORDS}, {RQ.PAGES}, n AS (SELECT doc_id, page, count(*) AS n FROM w GROUP BY ALL), k AS (SELECT p.doc_id, page_number AS page, coalesce(n, 0) AS n_words, CASE WHEN coalesce(n, 0) > 0 THEN 'text' WHEN is_scanned THEN 'scanned' WHEN coalesce(char_count, 0) > 0 THEN 'error' ELSE 'blank' END AS kind FROM p LEFT JOIN n ON n.doc_id = p.doc_id AND n.page = p.page_number)
        SELECT doc_id, page, kind, n_words, CASE kind WHEN 'scanned' THEN '[SCANNED PAGE ' || page || ' - OCR REQUIRED]' WHEN 'error' THEN '[EXTRACTION ERROR: Page ' || page || ']' WHEN 'blank' THEN '' END AS placeholder FROM k""",
    "words_rotated": f"WITH {RQ.WORDS}, p AS (SELECT DISTINCT ON (doc_id, page_number) * FROM page_analysis) SELECT w.doc_id, page, word_ix, rotation_angle AS rotated FROM w JOIN p ON p.doc_id = w.doc_id AND p.page_number = w.page WHERE coalesce(rotation_angle, 0) <> 0",
    "page_texts_bare": LQ.ORACLES["page_text"],
    "tables_by_method": f"WITH {RQ.CELLS} SELECT CASE WHEN len(filled) = len(flatten(rows)) THEN 'lines' ELSE 'alignment' END AS method, count(*) AS n_tables, count(DISTINCT (doc_id, page)) AS n_pages FROM t GROUP BY ALL",
    "table_rows_aligned": f"""WITH {RQ.WORDS}, cl AS (SELECT doc_id, page, count(*) AS n_columns FROM ({LQ.ORACLES['column_clusters']}) GROUP BY ALL),
        g0 AS (SELECT doc_id, page, top, CASE WHEN top - lag(top) OVER (PARTITION BY doc_id, page ORDER BY top) > 9 THEN 1 ELSE 0 END AS nn FROM w), g AS (SELECT *, sum(nn) OVER (PARTITION BY doc_id, page ORDER BY top RANGE UNBOUNDED PRECEDING)::BIGINT AS cluster_no FROM g0)
        SELECT doc_id, page, cluster_no, round(avg(top), 4) AS mean, count(*) AS n FROM g JOIN cl USING (doc_id, page) GROUP BY ALL, n_columns HAVING count(*) >= 0.5 * n_columns""".replace("GROUP BY ALL, n_columns", "GROUP BY doc_id, page, cluster_no, n_columns"),
    "table_texts_marked": f"""WITH {RQ.CELLS}, b AS (SELECT *, list_transform(rows, lambda x: array_to_string(x, ' | ')) AS ls FROM t)
        SELECT doc_id, page, table_ix, chr(10) || '[TABLE: Table ' || table_ix || ']' || chr(10) || array_to_string(list_concat(list_concat(ls[1:1], [repeat('-', length(ls[1]))]), ls[2:]), chr(10)) || chr(10) || '[TABLE END]' || chr(10) AS titled,
            '[TABLE: ' || n_rows || 'x' || n_cols || ' | lines | ' || round(confidence * 100)::INT || '%]' || chr(10) || array_to_string(list_transform(rows, lambda x: array_to_string(x, chr(9))), chr(10)) || chr(10) || '[TABLE END]' AS marked FROM b""",
    "regions_ordered": f"""WITH {RQ.WORDS}, {RQ.CELLS}, {RQ.BOXES}, rg AS (SELECT doc_id, page, top, x0, 'table' AS region_type FROM t UNION ALL SELECT doc_id, page, top, x0, 'textbox' FROM h)
        SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY top, x0, region_type)::INT AS place, region_type, top, x0 FROM rg""",
    "recovery_report": f"""WITH {RQ.WORDS}, {RQ.PAGES}, k AS (SELECT e.*, EXISTS (SELECT 1 FROM w WHERE w.doc_id = e.doc_id AND w.page = e.page_number) AS ok FROM e)
        SELECT doc_id, count(*) AS total_errors, count(*) FILTER (ok) AS recovered, round(count(*) FILTER (ok) / count(*), 2) AS recovery_rate,
            array_to_string(list_filter([CASE WHEN bool_or(severity = 'high') THEN 'Some pages may have incomplete extraction' END, CASE WHEN bool_or(error_type = 'scanned_page') THEN 'Consider using OCR for scanned pages' END, CASE WHEN bool_or(error_type = 'rotated_page') THEN 'Enable rotation correction for rotated pages' END,
                CASE WHEN bool_or(error_type = 'encoding_error') THEN 'Try different encoding fallbacks (UTF-8, Shift-JIS, EUC-JP)' END, CASE WHEN bool_or(error_type = 'overlapping_text') THEN 'Review overlapping text - may need manual cleanup' END], lambda x: x IS NOT NULL), chr(10)) AS recommendations FROM k GROUP BY doc_id""",
    "pages_laddered": f"""WITH {RQ.RPAGES}, pt AS ({LQ.ORACLES['page_text']}), ck AS (SELECT doc_id, page_start AS page, min(content) AS chunk FROM (SELECT DISTINCT ON (doc_id, chunk_id) * FROM chunks) GROUP BY ALL),
        j AS (SELECT rp.doc_id, rp.page::INT AS page, nullif(trim(coalesce(text, ''), ' '), '') IS NOT NULL AS a, nullif(trim(coalesce(page_text, ''), ' '), '') IS NOT NULL AS b, nullif(trim(coalesce(chunk, ''), ' '), '') IS NOT NULL AS c, text, page_text, chunk FROM rp LEFT JOIN pt USING (doc_id, page) LEFT JOIN ck USING (doc_id, page))
        SELECT doc_id, page, CASE WHEN a THEN 'text' WHEN b THEN 'words' WHEN c THEN 'chunk' ELSE 'none' END AS recovery_method, length(CASE WHEN a THEN text WHEN b THEN page_text WHEN c THEN chunk ELSE '[EXTRACTION ERROR: Page ' || page || ']' END)::INT AS n_chars FROM j""",
    "format_footers": f"""WITH {RQ.RESULTS} SELECT doc_id, array_to_string(list_filter(['', repeat('=', 60), 'EXTRACTION STATISTICS', repeat('=', 60), 'Total Pages: ' || page_count, 'Total Words: ' || format('{{:,}}', word_count), 'Total Characters: ' || format('{{:,}}', length(raw_text)), 'Extraction Time: ' || format('{{:.2f}}', extraction_time) || 's', repeat('=', 60)], lambda x: x IS NOT NULL), chr(10)) AS footer FROM r""",
    "flags_appended": f"""WITH {RQ.FLAGS} SELECT doc_id, chr(10) || chr(10) || repeat('=', 60) || chr(10) || 'REVIEW FLAGS' || chr(10) || repeat('=', 60) || chr(10) || string_agg(chr(10) || '[' || upper(severity) || '] Page ' || coalesce(page::VARCHAR, 'None') || ': ' || coalesce(message, ''), '' ORDER BY {RQ.SEVERITY_RANK}, flag_id) AS section FROM f WHERE NOT resolved GROUP BY doc_id""",
    "notes_formatted": """WITH fd AS (SELECT DISTINCT ON (footnote_id) * FROM footnote_definitions) SELECT doc_id, chr(10) || repeat('=', 40) || chr(10) || 'FOOTNOTES:' || chr(10) || repeat('=', 40) || chr(10) || string_agg(coalesce(marker, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY page_number, y, footnote_id) AS notes FROM fd GROUP BY doc_id""",
    "texts_marked": f"""WITH {RQ.RESULTS} SELECT doc_id, (length(raw_text) + 12)::INT AS n_chars, left(substr(raw_text, 1, 3) || '[ILLEGIBLE]' || substr(raw_text, 4), 20) AS head, format('{{:.1f}}', 100 * (floor(confidence * 1000) / 1000)) || '%' AS share,
        CASE WHEN strlen(raw_text) >= 1048576 THEN format('{{:.1f}}', strlen(raw_text) / 1048576.0) || ' MB' WHEN strlen(raw_text) >= 1024 THEN format('{{:.1f}}', strlen(raw_text) / 1024.0) || ' KB' ELSE strlen(raw_text) || ' B' END AS size FROM r WHERE confidence < 0.5 AND raw_text IS NOT NULL""",
}
