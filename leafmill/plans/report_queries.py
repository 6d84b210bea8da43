"""Queries over tables, footnotes, flags, page analyses, batches and chunks, and their DuckDB statements."""

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
from leafmill.plans.layout_queries import ORACLES as LAYOUT_ORACLES
from leafmill.plans.layout_queries import coverage_report, words
from leafmill.sources.tables import read_table

DOC = ["doc_id"]


# ---- tables


def assembled(spark: SparkSession, d: str) -> DataFrame:
    return T.assemble(T.clean_cells(read_table(spark, d, "table_cells")))


def tables_assembled(spark: SparkSession, d: str) -> DataFrame:
    return assembled(spark, d).select(*T.TABLE, "n_rows", F.col("n_cols").cast("long").alias("n_cols"), T.to_tabs(F.col("rows")).alias("body"), "x0", "top", "x1", "bottom", "confidence")


def tables_valid(spark: SparkSession, d: str) -> DataFrame:
    t = assembled(spark, d)
    return t.where(T.is_valid(F.col("rows"), F.col("confidence"))).select(*T.TABLE, F.round(T.fill_share(F.col("rows")), 6).alias("fill_share"))


def tables_plausible(spark: SparkSession, d: str) -> DataFrame:
    """As tables_valid, at a confidence of .7."""
    t = assembled(spark, d)
    return t.where(T.is_valid(F.col("rows"), F.col("confidence"), sure=0.7)).select(*T.TABLE, F.round(T.fill_share(F.col("rows")), 6).alias("fill_share"))


def tables_valid_text(spark: SparkSession, d: str) -> DataFrame:
    """Tables that hold as found by their text alone."""
    t = assembled(spark, d)
    return t.where(T.is_valid_text_table(F.col("rows"), F.col("confidence"))).select(*T.TABLE)


def table_headers(spark: SparkSession, d: str) -> DataFrame:
    return assembled(spark, d).select(*T.TABLE, T.has_number_free_header(F.col("rows")).alias("header_1"), T.has_short_header(F.col("rows")).alias("header_2"))


def table_texts(spark: SparkSession, d: str) -> DataFrame:
    t, rows = assembled(spark, d), F.col("rows")
    return t.select(*T.TABLE, T.to_markdown(rows).alias("markdown"), T.marked_table(rows, T.to_pipes(rows, T.has_number_free_header(rows))).alias("pipes"))


def tables_kept(spark: SparkSession, d: str) -> DataFrame:
    return T.keep_surest(assembled(spark, d)).select(*T.TABLE)


def grid_cells(spark: SparkSession, d: str) -> DataFrame:
    w = words(spark, d)
    return T.grid_cells(w, L.clusters(w, L.PAGE, "x0", 5.0, 3), L.clusters(w, L.PAGE, "top", 9.0, 3)).select(*L.PAGE, F.round("row_y", 6).alias("row_y"), F.round("col_x", 6).alias("col_x"), "cell_text")


def text_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes around the columns of pages, as rectangles that no table touches and five words stand in."""
    w = words(spark, d)
    return T.boxes(w, rectangles(w), assembled(spark, d))


def rectangles(w: DataFrame) -> DataFrame:
    """Rectangles to look at where no decoder gives any: the extents of a page's columns."""
    extent = L.columns(w).groupBy("doc_id", "page", F.col("column_no").cast("int").alias("rect_ix"))
    return extent.agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))


def sidebars(spark: SparkSession, d: str) -> DataFrame:
    w = words(spark, d)
    return T.sidebars(w, L.page_sizes(w))


def sidebars_narrow(spark: SparkSession, d: str) -> DataFrame:
    """As sidebars, of two words and a gap of 5 points on."""
    w = words(spark, d)
    return T.sidebars(w, L.page_sizes(w), least=2, gap=5.0)


def table_confidence(spark: SparkSession, d: str) -> DataFrame:
    fill = T.fill_share(F.col("rows"))
    return assembled(spark, d).select(*T.TABLE, F.round(T.alignment_confidence(fill), 6).alias("alignment_confidence"), F.round(T.whitespace_confidence(fill), 6).alias("whitespace_confidence"))


def layout_summary(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of regions by kind."""
    return T.regions(assembled(spark, d).select(*T.TABLE), text_boxes(spark, d)).groupBy("region_type").agg(F.count("*").alias("n_regions"), F.countDistinct("doc_id").alias("n_docs"))


def tables_merged(spark: SparkSession, d: str) -> DataFrame:
    """Tables as two methods find them: by their cells, and, less surely, a little to the right."""
    t = assembled(spark, d).select(*T.TABLE, "x0", "top", "x1", "bottom", "confidence")
    other = t.withColumns({"x0": F.col("x0") + 5, "x1": F.col("x1") + 5, "confidence": F.col("confidence") * 0.9})
    merged = T.merge_methods(t.withColumn("method", F.lit("lines")).unionByName(other.withColumn("method", F.lit("text"))))
    return merged.select("doc_id", "page", "method", "table_ix", F.round("confidence", 6).alias("confidence"))


def document_tables(spark: SparkSession, d: str) -> DataFrame:
    """Per page its tables' numbers in order."""
    numbers = F.array_join(F.transform(F.array_sort(F.collect_list("table_ix")), lambda x: x.cast("string")), ",")
    return assembled(spark, d).groupBy("doc_id", "page").agg(F.count("*").alias("n_tables"), numbers.alias("table_ixs"))


def page_text_tables(spark: SparkSession, d: str) -> DataFrame:
    texts = L.page_texts(L.line_texts(L.lines(L.columns(words(spark, d)))))
    return T.pages_with_tables(texts, assembled(spark, d))


def formulas(spark: SparkSession, d: str) -> DataFrame:
    w = words(spark, d)
    return L.formulas(L.scripts(w, L.trimmed_sizes(w)))


# ---- footnotes


def marks(spark: SparkSession, d: str) -> DataFrame:
    w = words(spark, d)
    return N.markers(w, None)


def definitions(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "footnote_definitions").dropDuplicates(["footnote_id"]).withColumnRenamed("page_number", "page")


def footnote_markers(spark: SparkSession, d: str) -> DataFrame:
    return marks(spark, d)


def footnote_types(spark: SparkSession, d: str) -> DataFrame:
    f = definitions(spark, d)
    return f.groupBy(N.marker_type(F.col("marker")).alias("marker_type")).agg(F.count("*").alias("n_definitions"), F.countDistinct(N.normal_marker(F.col("marker"))).alias("n_markers"))


def footnote_matches(spark: SparkSession, d: str) -> DataFrame:
    """Markers on pages with the definitions of the same pages."""
    return N.matches(marks(spark, d), definitions(spark, d), "word_ix", "footnote_id")


def footnote_report(spark: SparkSession, d: str) -> DataFrame:
    m, f = marks(spark, d), definitions(spark, d)
    return N.completeness(m, f, N.matches(m, f, "word_ix", "footnote_id"))


def footnote_spans(spark: SparkSession, d: str) -> DataFrame:
    """Definitions found in the lines of the words."""
    lines = L.line_texts(L.lines(L.columns(words(spark, d))))
    return N.definition_spans(lines, L.PAGE, ["column_no", "line_no"], "line_text")


def notes_appended(spark: SparkSession, d: str) -> DataFrame:
    texts = L.page_texts(L.line_texts(L.lines(L.columns(words(spark, d)))))
    return N.appended_notes(texts, definitions(spark, d))


# ---- reports


def flags(spark: SparkSession, d: str) -> DataFrame:
    return R.clean_flags(read_table(spark, d, "flags"))


def flag_summary(spark: SparkSession, d: str) -> DataFrame:
    return R.flag_summary(flags(spark, d), ["flag_type"])


def flags_open(spark: SparkSession, d: str) -> DataFrame:
    return R.open_flags(flags(spark, d), "high").select("flag_id", "doc_id", "flag_type", "message")


def flags_first(spark: SparkSession, d: str) -> DataFrame:
    return R.first_flags(flags(spark, d), DOC).select("doc_id", "flag_id", "place")


def flags_resolved(spark: SparkSession, d: str) -> DataFrame:
    f = flags(spark, d)
    done = f.where("severity = 'low'").select("flag_id", F.lit("low").alias("note"))
    return R.resolved_flags(f, done).select("flag_id", "resolved", "resolution_note")


def flag_lines(spark: SparkSession, d: str) -> DataFrame:
    return R.flag_report(flags(spark, d)).select("flag_id", "line")


def page_errors(spark: SparkSession, d: str) -> DataFrame:
    return R.page_errors(R.clean_pages(read_table(spark, d, "page_analysis")))


def error_counts(spark: SparkSession, d: str) -> DataFrame:
    """Errors by type and severity with their totals."""
    return page_errors(spark, d).cube("error_type", "severity").agg(F.count("*").alias("n_errors"), F.countDistinct("doc_id").alias("n_docs"), F.grouping_id().cast("long").alias("level"))


def error_report(spark: SparkSession, d: str) -> DataFrame:
    r = R.error_report(page_errors(spark, d))
    as_text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return r.select("doc_id", "total_errors", as_text("by_type").alias("by_type"), as_text("by_severity").alias("by_severity"), F.array_join(F.transform("pages_affected", lambda p: p.cast("string")), ",").alias("pages_affected"))


def scanned_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with fewer than ten words."""
    pages = R.clean_pages(read_table(spark, d, "page_analysis"))
    return pages.where(F.coalesce("word_count", F.lit(0)) < 10).select("doc_id", "page_number")


def results(spark: SparkSession, d: str) -> DataFrame:
    return R.clean_results(read_table(spark, d, "extraction_results"))


def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    return R.batch_summary(results(spark, d))


def batch_issues(spark: SparkSession, d: str) -> DataFrame:
    """Issues of files, with the coverage of those that words were laid out for."""
    covered = coverage_report(spark, d).select("doc_id", F.col("coverage_percent").alias("coverage"))
    return R.batch_issues(results(spark, d).join(covered, "doc_id", "left"), "coverage")


def batch_table(spark: SparkSession, d: str) -> DataFrame:
    return R.batch_table(results(spark, d))


def extraction_confidence(spark: SparkSession, d: str) -> DataFrame:
    """From the score, the coverage of the words and the match rate of the footnotes; a report that isn't there counts as full."""
    full = lambda c: F.least(F.coalesce(F.col(c), F.lit(100.0)), F.lit(100.0))
    r = results(spark, d).join(coverage_report(spark, d).select("doc_id", "coverage_percent"), "doc_id", "left").join(footnote_report(spark, d).select("doc_id", "match_rate"), "doc_id", "left")
    return r.select("doc_id", F.round(R.extraction_confidence(F.coalesce(R.sound_score(F.col("quality_score")), F.lit(0.0)), full("coverage_percent"), full("match_rate")), 4).alias("extraction_confidence"))


def engines(spark: SparkSession, d: str) -> DataFrame:
    """Three readings of each document: as delivered, without line feeds, and its chunks joined."""
    r = results(spark, d).where("raw_text IS NOT NULL").select("doc_id", "raw_text")
    chunks = C.reassembled(clean_chunks(spark, d), DOC).select("doc_id", F.lit("chunks").alias("engine"), F.col("full_text").alias("text"))
    return r.select("doc_id", F.lit("raw").alias("engine"), F.col("raw_text").alias("text")).unionByName(r.select("doc_id", F.lit("flat").alias("engine"), F.regexp_replace("raw_text", "\n", " ").alias("text"))).unionByName(chunks)


def consensus_base(spark: SparkSession, d: str) -> DataFrame:
    """The engine with the longest text of each document."""
    e = engines(spark, d)
    return e.groupBy("doc_id").agg(F.min(F.struct((-F.length("text")).alias("_n"), "engine"))["engine"].alias("base_engine"), F.count("*").alias("n_engines"))


def consensus_pages(spark: SparkSession, d: str) -> DataFrame:
    """Exact similarity of three readings of each page: as delivered, cleaned up, and without invented passages."""
    text = F.col("text")
    readings = F.array(*(F.struct(F.lit(name).alias("engine"), made.alias("text")) for name, made in (("raw", text), ("clean", X.cleanup(text)), ("plain", X.without_invented(text)))))
    engines = result_pages(spark, d).where("text IS NOT NULL").select("doc_id", "page", F.explode(readings).alias("_r")).select("doc_id", "page", "_r.*")
    return R.consensus(R.consensus_pairs(engines, ["doc_id", "page"]), engines, ["doc_id", "page"]).withColumn("consensus_score", F.round("consensus_score", 6))


def consensus_texts(spark: SparkSession, d: str) -> DataFrame:
    """Exact similarity of the whole texts of a document's engines; a document of one engine scores 1."""
    return R.consensus_at_once(engines(spark, d), DOC).withColumn("consensus_score", F.round("consensus_score", 6))


def element_check(spark: SparkSession, d: str) -> DataFrame:
    """Words laid out against words extracted, of each document."""
    w = words(spark, d).groupBy("doc_id").agg(F.count("*").alias("expected"))
    ratio, verdict = X.element_check(F.col("expected"), F.coalesce("word_count", F.lit(0)))
    return w.join(results(spark, d), "doc_id").select("doc_id", F.round(ratio, 6).alias("ratio"), verdict.alias("verdict"))


def position_check(spark: SparkSession, d: str) -> DataFrame:
    w = words(spark, d)
    bottom = L.inventory(w, None).groupBy("doc_id").agg(F.sum("bottom_region").alias("n_bottom"))
    return bottom.join(results(spark, d), "doc_id").select("doc_id", X.position_score(F.col("n_bottom"), F.col("raw_text")).alias("position_score"))


def undefined_markers(spark: SparkSession, d: str) -> DataFrame:
    return X.undefined_markers(results(spark, d), DOC, "raw_text")


def latest_results(spark: SparkSession, d: str) -> DataFrame:
    """The delivery of each document that was loaded last."""
    return results(spark, d).select("doc_id", F.date_format("loaded_at", "yyyy-MM-dd HH:mm:ss").alias("loaded_at"), "success")


# ---- chunks


def clean_chunks(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "chunks").dropDuplicates(["doc_id", "chunk_id"])


def result_pages(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).select("doc_id", F.posexplode("pages").alias("_p", "text")).select("doc_id", (F.col("_p") + 1).alias("page"), "text")


def chunks_by_characters(spark: SparkSession, d: str) -> DataFrame:
    return C.packed(result_pages(spark, d), DOC, "page", "text", 5000, 1000).select("doc_id", "chunk_id", "page_start", "page_end", "char_count")


def chunks_by_words(spark: SparkSession, d: str) -> DataFrame:
    return C.packed(result_pages(spark, d), DOC, "page", "text", 600, 100, unit="words").select("doc_id", "chunk_id", "page_start", "page_end", "char_count")


def chunks_by_pages(spark: SparkSession, d: str) -> DataFrame:
    return C.packed_by_count(result_pages(spark, d), DOC, "page", "text", 3).select("doc_id", "chunk_id", "page_start", "page_end", "char_count")


def section_starts(spark: SparkSession, d: str) -> DataFrame:
    return C.section_positions(results(spark, d), DOC, "raw_text")


def section_counts(spark: SparkSession, d: str) -> DataFrame:
    return section_starts(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_sections"))


def chunk_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return C.with_overlaps(clean_chunks(spark, d).drop("overlap_start_text", "overlap_end_text"), DOC, 200).select("doc_id", "chunk_id", "overlap_start_text", "overlap_end_text")


def page_chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.page_to_chunk(result_pages(spark, d), clean_chunks(spark, d), DOC, "page")


def chunk_pages(spark: SparkSession, d: str) -> DataFrame:
    found = C.pages_of_chunk(clean_chunks(spark, d), result_pages(spark, d), DOC, "page", "text")
    return found.select("doc_id", "chunk_id", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


def reassemble(spark: SparkSession, d: str) -> DataFrame:
    return C.reassembled(clean_chunks(spark, d), DOC)


def chunk_context(spark: SparkSession, d: str) -> DataFrame:
    return C.context_text(clean_chunks(spark, d), DOC)


def context_fit(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d).where("raw_text IS NOT NULL")
    return r.select("doc_id", C.estimated_tokens(F.col("raw_text")).cast("long").alias("n_tokens"), C.fitted(F.col("raw_text"), 500).alias("fitted_text"), C.memory_estimate(F.length("raw_text"), 5000).cast("double").alias("memory_bytes"))


def context_pieces(spark: SparkSession, d: str) -> DataFrame:
    return C.context_pieces(results(spark, d), DOC, "raw_text")


# ---- formatted output


def formatted(spark: SparkSession, d: str) -> DataFrame:
    pages = result_pages(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", M.marked_page(F.col("page"), F.col("text")).alias("t")))).alias("_p"))
    return pages.select("doc_id", F.array_join(F.transform("_p", lambda x: x["t"]), "\n").alias("formatted"))


def format_pages(spark: SparkSession, d: str) -> DataFrame:
    begins, ends = M.marker_counts(F.col("formatted"))
    return formatted(spark, d).select("doc_id", "formatted", begins.cast("long").alias("n_start"), ends.cast("long").alias("n_end"))


def format_headers(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).select("doc_id", M.document_header(F.col("filename"), F.col("page_count"), F.col("word_count")).alias("header"))


def format_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Pages read back from their formatted documents."""
    back = formatted(spark, d).select("doc_id", F.posexplode(M.pages_of(F.col("formatted"))).alias("_p", "text"))
    return back.select("doc_id", (F.col("_p") + 1).alias("page"), "text")


def flag_boxes(spark: SparkSession, d: str) -> DataFrame:
    return flags(spark, d).select("flag_id", M.boxed(F.col("severity"), F.coalesce("context", F.lit(""))).alias("box"))


def flag_prompts(spark: SparkSession, d: str) -> DataFrame:
    made = M.correction_prompt(F.col("flag_type"), F.lit("<"), F.coalesce("message", F.lit("")), F.lit(">"))
    reply = M.parsed_reply(F.concat(F.lit("so "), F.to_json(F.struct(F.translate(F.coalesce("message", F.lit("")), "{}", "()").alias("corrected"), F.lit(0.9).alias("confidence"))), F.lit(" end")), F.col("message"))
    return flags(spark, d).select("flag_id", F.length(made).alias("n_prompt"), reply["corrected"].alias("corrected"), reply["confidence"].alias("confidence"))


def durations(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).select("doc_id", F.round("extraction_time", 2).alias("seconds"), M.eta(F.col("extraction_time") * 100).alias("eta"))


QUERIES = [
    tables_assembled, tables_valid, tables_plausible, tables_valid_text, table_headers, table_texts, tables_kept, table_confidence, layout_summary, tables_merged, document_tables, page_text_tables, formulas, grid_cells, text_boxes, sidebars, sidebars_narrow, footnote_markers, footnote_types, footnote_matches, footnote_report, footnote_spans, notes_appended,
    flag_summary, flags_open, flags_first, flags_resolved, flag_lines, page_errors, error_counts, error_report, scanned_pages, batch_summary, batch_issues, batch_table, extraction_confidence, element_check, position_check, undefined_markers, latest_results, consensus_base, consensus_pages, consensus_texts,
    chunks_by_characters, chunks_by_words, chunks_by_pages, section_starts, section_counts, chunk_overlaps, page_chunks, chunk_pages, reassemble, chunk_context, context_fit, context_pieces,
    format_pages, format_headers, format_round_trip, flag_boxes, flag_prompts, durations,
]

WORDS = """w AS (SELECT DISTINCT ON (doc_id, page, word_ix) * FROM words WHERE trim(text) <> ''),
    z AS (SELECT doc_id, page, max(x1) AS width, max(bottom) AS page_height FROM w GROUP BY ALL)"""
CELLS = """c AS (SELECT DISTINCT ON (cell_id) * REPLACE (trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(8194) || chr(8195) || chr(8201) || chr(8239) || chr(12288)) AS text) FROM table_cells),
    t0 AS (SELECT doc_id, page_number AS page, table_ix, max(col_no) AS last, count(DISTINCT row_no) AS n_rows, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom, sum(confidence::DECIMAL(18,6))::DOUBLE / count(confidence) AS confidence FROM c GROUP BY ALL),
    g AS (SELECT t0.*, r.row_no, k.col_no, coalesce((SELECT max(c.text) FROM c WHERE c.doc_id = t0.doc_id AND c.page_number = t0.page AND c.table_ix = t0.table_ix AND c.row_no = r.row_no AND c.col_no = k.col_no), '') AS text
        FROM t0 JOIN (SELECT DISTINCT doc_id, page_number AS page, table_ix, row_no FROM c) r USING (doc_id, page, table_ix), (SELECT unnest(range(0, (SELECT max(last) + 1 FROM t0))) AS col_no) k WHERE t0.n_rows >= 2 AND k.col_no <= t0.last),
    rw AS (SELECT doc_id, page, table_ix, row_no, list(text ORDER BY col_no) AS cells FROM g GROUP BY ALL),
    t AS (SELECT t0.*, last + 1 AS n_cols, rr.rows, list_filter(flatten(rr.rows), lambda x: x <> '') AS filled, flatten(rr.rows[2:]) AS rest FROM t0 JOIN (SELECT doc_id, page, table_ix, list(cells ORDER BY row_no) AS rows FROM rw GROUP BY ALL) rr USING (doc_id, page, table_ix))"""
BOXES = """c1 AS (SELECT *, CASE WHEN x0 - lag(x1) OVER o > 50 THEN 1 ELSE 0 END AS nc FROM w WINDOW o AS (PARTITION BY doc_id, page ORDER BY x0, word_ix)),
    c2 AS (SELECT *, sum(nc) OVER (PARTITION BY doc_id, page ORDER BY x0, word_ix ROWS UNBOUNDED PRECEDING)::INT AS rect_ix FROM c1),
    rc AS (SELECT doc_id, page, rect_ix, min(x0) AS x0, max(x1) AS x1, min(top) AS top, max(bottom) AS bottom FROM c2 GROUP BY ALL),
    fr AS (SELECT * FROM rc r WHERE r.x1 - r.x0 >= 50 AND r.bottom - r.top >= 20 AND NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = r.doc_id AND t.page = r.page AND NOT (r.x1 < t.x0 OR t.x1 < r.x0 OR r.bottom < t.top OR t.bottom < r.top))),
    h AS (SELECT fr.doc_id, fr.page, rect_ix, fr.x0, fr.top, string_agg(w.text, ' ' ORDER BY word_ix) AS text FROM fr JOIN w ON w.doc_id = fr.doc_id AND w.page = fr.page AND (w.x0 + w.x1) / 2 BETWEEN fr.x0 AND fr.x1 AND (w.top + w.bottom) / 2 BETWEEN fr.top AND fr.bottom GROUP BY ALL HAVING count(*) >= 5)"""
NUM = "regexp_matches(replace(replace(x, '.', ''), ',', ''), '^[0-9]+$')"
FIG = "regexp_matches(x, '^[0-9.,]+$')"
ANY = lambda cells, cond: f"len(list_filter({cells}, lambda x: {cond})) > 0"
HEADER_1 = f"(len(rows) > 1 AND NOT {ANY('rows[1]', NUM)} AND {ANY('rest', NUM)})"
MEAN_LEN = lambda cells: f"(list_sum(list_transform({cells}, lambda x: length(x))) / len({cells}))"
MARKER = r"^(?:\*\d+|※\d+|注\d+|†|‡|\[\d+\]|\(\*?\d+\))"
NORM = lambda c: f"translate(regexp_replace({c}, '[ \\x{{3000}}:：]', '', 'g'), '＊（）０１２３４５６７８９', '*()0123456789')"
MARKS = f"""mk AS (SELECT doc_id, page, word_ix, text AS marker, array_to_string(list_concat(list_concat(coalesce(bf, []), ['[' || text || ']']), coalesce(af, [])), ' ') AS context FROM (
        SELECT *, list(text) OVER (PARTITION BY doc_id, page ORDER BY word_ix ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS bf, list(text) OVER (PARTITION BY doc_id, page ORDER BY word_ix ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS af
        FROM w JOIN z USING (doc_id, page) WHERE top < 0.8 * page_height) WHERE regexp_matches(text, '{MARKER}'))"""
MATCHED = f"""fd AS (SELECT DISTINCT ON (footnote_id) *, page_number AS page FROM footnote_definitions),
    ma AS (SELECT *, {NORM('marker')} AS norm, row_number() OVER (PARTITION BY doc_id, page, {NORM('marker')} ORDER BY word_ix) AS k FROM mk),
    mb AS (SELECT *, {NORM('marker')} AS norm, row_number() OVER (PARTITION BY doc_id, page, {NORM('marker')} ORDER BY footnote_id) AS k FROM fd),
    mt AS (SELECT ma.doc_id, ma.page, ma.word_ix AS mark_id, ma.marker, mb.footnote_id AS definition_id, mb.text AS definition_text FROM ma JOIN mb ON ma.doc_id = mb.doc_id AND ma.page = mb.page AND ma.norm = mb.norm AND ma.k = mb.k)"""
FLAGS = "f AS (SELECT DISTINCT ON (flag_id) * REPLACE (coalesce(resolved, false) AS resolved) FROM flags)"
PAGES = """p AS (SELECT DISTINCT ON (doc_id, page_number) * FROM page_analysis),
    e AS (SELECT doc_id, page_number, 'rotated_page' AS error_type, 'medium' AS severity FROM p WHERE is_rotated UNION ALL SELECT doc_id, page_number, 'scanned_page', 'high' FROM p WHERE is_scanned
        UNION ALL SELECT doc_id, page_number, 'overlapping_text', 'low' FROM p WHERE has_overlapping_text UNION ALL SELECT doc_id, page_number, 'encoding_error', 'medium' FROM p WHERE has_encoding_issues)"""
RESULTS = """r AS (SELECT *, raw_text IS NOT NULL AS success, CASE WHEN quality_score IS NULL OR isnan(quality_score) THEN NULL ELSE greatest(0.0, least(100.0, quality_score)) END AS score FROM extraction_results
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC, filename) = 1)"""
RPAGES = f"{RESULTS}, rp AS (SELECT doc_id, unnest(pages) AS text, generate_subscripts(pages, 1) AS page FROM r)"
CHUNKS = "ch AS (SELECT DISTINCT ON (doc_id, chunk_id) * FROM chunks)"
REASSEMBLED = f"""{CHUNKS}, cb AS (SELECT *, coalesce(length(overlap_start_text), 0) > 0 AND starts_with(content, overlap_start_text) AS dup FROM ch),
    ra AS (SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (dup) AS duplicates_removed, regexp_replace(string_agg(coalesce(CASE WHEN dup THEN substr(content, length(overlap_start_text) + 1) ELSE content END, ''), chr(10) || chr(10) ORDER BY chunk_id), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g') AS full_text FROM cb GROUP BY doc_id)"""


def packed_sql(size: str, sep: int, most: int, least: int) -> str:
    return f"""WITH RECURSIVE {RPAGES}, n AS (SELECT *, coalesce({size}, 0) AS n FROM rp),
        k AS (SELECT doc_id, page, text, 0 AS chunk_id, n AS held FROM n WHERE page = 1
            UNION ALL SELECT n.doc_id, n.page, n.text, k.chunk_id + (k.held >= {least} AND k.held + n.n > {most})::INT, CASE WHEN k.held >= {least} AND k.held + n.n > {most} THEN n.n ELSE k.held + {sep} + n.n END FROM k JOIN n ON n.doc_id = k.doc_id AND n.page = k.page + 1)
        SELECT doc_id, chunk_id, min(page)::INT AS page_start, max(page)::INT AS page_end, length(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY page))::INT AS char_count FROM k GROUP BY ALL"""


def marker_sql(kind: str) -> str:
    text = f"(' PAGE ' || page || ' {kind} ')"
    return f"(repeat('-', (60 - length({text})) // 2) || {text} || repeat('-', 60 - length({text}) - (60 - length({text})) // 2))"


SECTION = "(?m)^(?:#{1,6}\\s+|[0-9]+\\.\\s+|[0-9]+\\.[0-9]+\\s+|第[0-9]+[章条節項]|[一二三四五六七八九十]+[、.]|={3,}|-{3,})"
SEVERITY_RANK = "list_position(['critical', 'high', 'medium', 'low'], severity)"
ORACLES = {
    "tables_assembled": f"WITH {CELLS} SELECT doc_id, page, table_ix, n_rows, n_cols::BIGINT AS n_cols, array_to_string(list_transform(rows, lambda x: array_to_string(x, chr(9))), chr(10)) AS body, x0, top, x1, bottom, confidence FROM t",
    "tables_valid": f"WITH {CELLS} SELECT doc_id, page, table_ix, round(len(filled) / len(flatten(rows)), 6) AS fill_share FROM t WHERE n_rows >= 3 AND n_cols >= 3 AND confidence >= 0.8 AND len(filled) >= 0.5 * len(flatten(rows))",
    "tables_plausible": f"WITH {CELLS} SELECT doc_id, page, table_ix, round(len(filled) / len(flatten(rows)), 6) AS fill_share FROM t WHERE n_rows >= 3 AND n_cols >= 3 AND confidence >= 0.7 AND len(filled) >= 0.5 * len(flatten(rows))",
    "tables_valid_text": f"WITH {CELLS} SELECT doc_id, page, table_ix FROM t WHERE n_rows BETWEEN 3 AND 20 AND n_cols BETWEEN 3 AND 10 AND confidence >= 0.9 AND len(filled) >= 0.5 * len(flatten(rows)) AND len(list_distinct(flatten(rows))) >= 0.3 * len(flatten(rows))",
    "table_headers": f"WITH {CELLS} SELECT doc_id, page, table_ix, {HEADER_1} AS header_1, len(rows) > 1 AND NOT {ANY('rows[1]', FIG)} AND ({ANY('rest', FIG)} OR {MEAN_LEN('rows[1]')} < 1.5 * {MEAN_LEN('rest')}) AS header_2 FROM t",
    "table_texts": f"""WITH {CELLS}, wd AS (SELECT *, list_transform(range(1, n_cols + 1), lambda k: least(30, greatest(3, list_max(list_transform(rows, lambda r: length(r[k])))))) AS ws, {HEADER_1} AS hd FROM t),
        ln AS (SELECT *, list_transform(rows, lambda r: array_to_string(list_transform(range(1, n_cols + 1), lambda k: rpad(CASE WHEN length(r[k]) > ws[k] THEN substr(r[k], 1, ws[k] - 3) || '...' ELSE r[k] END, ws[k]::INT, ' ')), ' | ')) AS body,
            list_transform(rows, lambda r: '| ' || array_to_string(r, ' | ') || ' |') AS md FROM wd)
        SELECT doc_id, page, table_ix, array_to_string(list_concat(list_concat(md[1:1], ['|' || repeat(' --- |', n_cols)]), md[2:]), chr(10)) AS markdown,
            '[TABLE: ' || n_rows || 'x' || n_cols || ']' || chr(10) || array_to_string(CASE WHEN hd THEN list_concat(list_concat(body[1:1], [array_to_string(list_transform(ws, lambda k: repeat('-', k)), '-+-')]), body[2:]) ELSE body END, chr(10)) || chr(10) || '[TABLE END]' AS pipes FROM ln""",
    "table_confidence": f"WITH {CELLS} SELECT doc_id, page, table_ix, round(0.6 + 0.3 * len(filled) / len(flatten(rows)), 6) AS alignment_confidence, round(0.7 + 0.2 * len(filled) / len(flatten(rows)), 6) AS whitespace_confidence FROM t",
    "layout_summary": f"""WITH {WORDS}, {CELLS}, {BOXES}, rg AS (SELECT doc_id, 'table' AS region_type FROM t UNION ALL SELECT doc_id, 'textbox' FROM h) SELECT region_type, count(*) AS n_regions, count(DISTINCT doc_id) AS n_docs FROM rg GROUP BY region_type""",
    "document_tables": f"WITH {CELLS} SELECT doc_id, page, count(*) AS n_tables, string_agg(table_ix::VARCHAR, ',' ORDER BY table_ix) AS table_ixs FROM t GROUP BY ALL",
    "element_check": f"""WITH {WORDS}, {RESULTS}, e AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id), q AS (SELECT doc_id, coalesce(word_count, 0) / n AS ratio FROM e JOIN r USING (doc_id))
        SELECT doc_id, round(least(ratio, 1.0), 6) AS ratio, CASE WHEN ratio < 0.5 THEN 'issue' WHEN ratio < 0.7 OR ratio > 1.5 THEN 'warning' ELSE 'ok' END AS verdict FROM q""",
    "position_check": f"""WITH {WORDS}, {RESULTS}, b AS (SELECT doc_id, count(*) FILTER (top > 0.85 * page_height) AS n FROM w JOIN z USING (doc_id, page) GROUP BY doc_id)
        SELECT doc_id, CASE WHEN n > 0 AND NOT regexp_matches(coalesce(raw_text, ''), '\\*[0-9]+|※[0-9]+|\\[[0-9]+\\]|[†‡]') THEN 0.8 ELSE 1.0 END::DOUBLE AS position_score FROM b JOIN r USING (doc_id)""",
    "undefined_markers": f"""WITH {RESULTS}, m AS (SELECT doc_id, raw_text, unnest(list_distinct(regexp_extract_all(raw_text, '\\*[0-9]+'))) AS marker FROM r WHERE length(raw_text) > 0)
        SELECT doc_id, marker FROM m WHERE NOT (contains(raw_text, marker || ':') OR contains(raw_text, marker || '：') OR contains(raw_text, marker || ' ') OR contains(raw_text, marker || chr(10)) OR contains(raw_text, marker || chr(9)))""",
    "latest_results": f"WITH {RESULTS} SELECT doc_id, strftime(loaded_at, '%Y-%m-%d %H:%M:%S') AS loaded_at, success FROM r",
    "text_boxes": f"""WITH {WORDS}, {CELLS}, {BOXES}
        SELECT * EXCLUDE (x0, top), CASE WHEN regexp_matches(lower(text), 'warning|警告|caution|注意|danger|危険') THEN 'warning' WHEN regexp_matches(lower(text), 'note|注|info|情報|tip|hint') THEN 'note' WHEN regexp_matches(lower(text), 'example|例|sample|サンプル') THEN 'example' ELSE 'generic' END AS box_type FROM h""",
    "footnote_markers": f"WITH {WORDS}, {MARKS} SELECT doc_id, page, word_ix, marker, context FROM mk",
    "footnote_types": f"""WITH fd AS (SELECT DISTINCT ON (footnote_id) *, left(marker, 1) AS c FROM footnote_definitions) SELECT CASE WHEN c IN ('*', '＊') THEN 'star' WHEN c = '※' THEN 'komejirushi' WHEN c = '注' THEN 'chu' WHEN c = '[' THEN 'bracket' WHEN c IN ('(', '（') THEN 'paren' WHEN c IN ('†', '‡') THEN 'dagger' END AS marker_type,
        count(*) AS n_definitions, count(DISTINCT {NORM('marker')}) AS n_markers FROM fd GROUP BY ALL""",
    "footnote_matches": f"WITH {WORDS}, {MARKS}, {MATCHED} SELECT *, 0.95::DOUBLE AS confidence, {NORM('marker')} AS norm FROM mt".replace(f", {NORM('marker')} AS norm FROM mt", " FROM mt"),
    "footnote_report": f"""WITH {WORDS}, {MARKS}, {MATCHED}, a AS (SELECT doc_id, count(*) AS n_markers FROM mk GROUP BY doc_id), b AS (SELECT doc_id, count(*) AS n_definitions FROM fd GROUP BY doc_id), m AS (SELECT doc_id, count(*) AS n_matches FROM mt GROUP BY doc_id),
        u AS (SELECT doc_id, string_agg(marker, ' ' ORDER BY marker) AS unmatched FROM (SELECT DISTINCT doc_id, marker FROM mk WHERE (doc_id, marker) NOT IN (SELECT (doc_id, marker) FROM mt)) GROUP BY doc_id),
        j AS (SELECT doc_id, coalesce(n_markers, 0) AS n_markers, coalesce(n_definitions, 0) AS n_definitions, coalesce(n_matches, 0) AS n_matches, coalesce(unmatched, '') AS unmatched FROM a FULL JOIN b USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN u USING (doc_id)),
        q AS (SELECT *, CASE WHEN n_markers > 0 THEN 100.0 * n_matches / n_markers ELSE 100.0 END AS rate FROM j)
        SELECT doc_id, n_markers, n_definitions, n_matches, round(rate, 6) AS match_rate, CASE WHEN rate = 100 THEN 'COMPLETE' WHEN rate >= 80 THEN 'PARTIAL' ELSE 'POOR' END AS status, unmatched FROM q""",
    "flag_summary": f"WITH {FLAGS} SELECT flag_type, count(*) AS total, count(*) FILTER (NOT resolved) AS unresolved, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM f GROUP BY flag_type",
    "flags_open": f"WITH {FLAGS} SELECT flag_id, doc_id, flag_type, message FROM f WHERE NOT resolved AND severity = 'high'",
    "flags_first": f"WITH {FLAGS} SELECT doc_id, flag_id, row_number() OVER (PARTITION BY doc_id ORDER BY {SEVERITY_RANK}, created_at, flag_id)::INT AS place FROM f QUALIFY place <= 3",
    "flags_resolved": f"WITH {FLAGS} SELECT flag_id, severity = 'low' OR resolved AS resolved, CASE WHEN severity = 'low' THEN 'low' ELSE resolution_note END AS resolution_note FROM f",
    "flag_lines": f"WITH {FLAGS} SELECT flag_id, '[' || upper(severity) || '] ' || flag_type || ' p.' || coalesce(page::INT::VARCHAR, '-') || ': ' || coalesce(message, 'null') AS line FROM f WHERE NOT resolved",
    "page_errors": f"WITH {PAGES} SELECT * FROM e",
    "error_counts": f"WITH {PAGES} SELECT error_type, severity, count(*) AS n_errors, count(DISTINCT doc_id) AS n_docs, grouping(error_type, severity)::BIGINT AS level FROM e GROUP BY CUBE (error_type, severity)",
    "error_report": f"""WITH {PAGES}, ty AS (SELECT doc_id, string_agg(error_type || '=' || n, ',' ORDER BY error_type) AS by_type FROM (SELECT doc_id, error_type, count(*) AS n FROM e GROUP BY ALL) GROUP BY doc_id), sv AS (SELECT doc_id, string_agg(severity || '=' || n, ',' ORDER BY severity) AS by_severity FROM (SELECT doc_id, severity, count(*) AS n FROM e GROUP BY ALL) GROUP BY doc_id),
        pg AS (SELECT doc_id, string_agg(page_number::VARCHAR, ',' ORDER BY page_number) AS pages_affected FROM (SELECT DISTINCT doc_id, page_number FROM e WHERE page_number > 0) GROUP BY doc_id)
        SELECT doc_id, total_errors, by_type, by_severity, pages_affected FROM (SELECT doc_id, count(*) AS total_errors FROM e GROUP BY doc_id) JOIN ty USING (doc_id) JOIN sv USING (doc_id) JOIN pg USING (doc_id)""",
    "scanned_pages": f"WITH {PAGES} SELECT doc_id, page_number FROM p WHERE coalesce(word_count, 0) < 10",
    "batch_summary": f"""WITH {RESULTS} SELECT count(*) AS total_files, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed, sum(page_count)::BIGINT AS total_pages, sum(word_count)::BIGINT AS total_words, sum(score::DECIMAL(18,6)) FILTER (success)::DOUBLE / count(score) FILTER (success) AS mean_quality,
        (SELECT filename FROM r WHERE success AND score IS NOT NULL ORDER BY score DESC, filename LIMIT 1) AS best_file, (SELECT filename FROM r WHERE success AND score IS NOT NULL ORDER BY score, filename LIMIT 1) AS worst_file FROM r""",
    "batch_issues": f"WITH {RESULTS}, cv AS ({LAYOUT_ORACLES['coverage_report']}), i AS (SELECT doc_id, filename, CASE WHEN NOT success THEN 'failed' WHEN score < 60 THEN 'low_quality' WHEN coverage_percent < 80 THEN 'low_coverage' WHEN confidence < 0.5 THEN 'low_confidence' END AS issue FROM r LEFT JOIN cv USING (doc_id)) SELECT *, CASE WHEN issue LIKE 'low_co%' THEN 'medium' ELSE 'high' END AS severity FROM i WHERE issue IS NOT NULL",
    "batch_table": f"WITH {RESULTS} SELECT filename, format('{{:.1f}}', score) AS score, CASE WHEN score >= 80 THEN 'good' WHEN score >= 60 THEN 'ok' ELSE 'bad' END AS css, coalesce(word_count, 0) AS words FROM r",
    "consensus_base": f"""WITH {RESULTS}, {REASSEMBLED}, en AS (SELECT doc_id, 'raw' AS engine, length(raw_text) AS n FROM r WHERE raw_text IS NOT NULL UNION ALL SELECT doc_id, 'flat', length(raw_text) FROM r WHERE raw_text IS NOT NULL UNION ALL SELECT doc_id, 'chunks', length(full_text) FROM ra)
        SELECT doc_id, arg_min(engine, (-n, engine)) AS base_engine, count(*) AS n_engines FROM en GROUP BY doc_id""",
    "chunks_by_characters": packed_sql("length(text)", 2, 5000, 1000),
    "chunks_by_words": packed_sql("len(list_filter(regexp_split_to_array(text, '[ \\t\\n]+'), lambda x: x <> ''))", 0, 600, 100),
    "chunks_by_pages": f"WITH {RPAGES} SELECT doc_id, ((page - 1) // 3)::INT AS chunk_id, min(page)::INT AS page_start, max(page)::INT AS page_end, length(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY page))::INT AS char_count FROM rp GROUP BY ALL",
    "section_counts": f"WITH {RESULTS}, s AS (SELECT doc_id, len(regexp_extract_all(raw_text, '{SECTION}')) AS n_sections FROM r WHERE length(raw_text) > 0) SELECT * FROM s WHERE n_sections > 0",
    "chunk_overlaps": f"""WITH {CHUNKS}, tl AS (SELECT *, CASE WHEN length(content) > 200 THEN right(content, 200) ELSE content END AS tail FROM ch)
        SELECT doc_id, chunk_id, coalesce(lag(tail) OVER o, '') AS overlap_start_text, CASE WHEN lead(chunk_id) OVER o IS NOT NULL THEN tail ELSE '' END AS overlap_end_text FROM tl WINDOW o AS (PARTITION BY doc_id ORDER BY chunk_id)""",
    "page_chunks": f"WITH {RPAGES}, {CHUNKS} SELECT rp.doc_id, page::INT AS page, min(chunk_id) AS chunk_id FROM rp JOIN ch ON ch.doc_id = rp.doc_id AND page BETWEEN page_start AND page_end GROUP BY ALL",
    "chunk_pages": f"""WITH {RPAGES}, {CHUNKS}, h AS (SELECT ch.doc_id, ch.chunk_id, page FROM ch JOIN rp ON rp.doc_id = ch.doc_id AND length(substr(rp.text, 1, 100)) > 0 AND (contains(content, substr(rp.text, 1, 100)) OR contains(content, right(rp.text, 100))))
        SELECT ch.doc_id, ch.chunk_id, coalesce(pp, '1') AS pages FROM ch LEFT JOIN (SELECT doc_id, chunk_id, string_agg(page::VARCHAR, ',' ORDER BY page) AS pp FROM h GROUP BY ALL) USING (doc_id, chunk_id)""",
    "reassemble": f"WITH {REASSEMBLED} SELECT * FROM ra",
    "chunk_context": f"""WITH {CHUNKS} SELECT doc_id, chunk_id, coalesce('[...previous context...]' || chr(10) || right(lag(content) OVER o, 200) || chr(10), '') || content || coalesce(chr(10) || substr(lead(content) OVER o, 1, 200) || chr(10) || '[...continues...]', '') AS context_text FROM ch WINDOW o AS (PARTITION BY doc_id ORDER BY chunk_id)""",
    "context_fit": f"WITH {RESULTS} SELECT doc_id, length(raw_text) // 4 AS n_tokens, CASE WHEN length(raw_text) <= 2000 THEN raw_text ELSE substr(raw_text, 1, 500) || chr(10) || '[... content omitted ...]' || chr(10) || right(raw_text, 500) END AS fitted_text, ((length(raw_text) * 2 + greatest(1, length(raw_text) // 5000) * 1000) * 1.5)::DOUBLE AS memory_bytes FROM r WHERE raw_text IS NOT NULL",
    "format_pages": f"""WITH {RPAGES}, fm AS (SELECT doc_id, string_agg({marker_sql('START')} || chr(10) || coalesce(text, '') || chr(10) || {marker_sql('END')}, chr(10) ORDER BY page) AS formatted FROM rp GROUP BY doc_id)
        SELECT doc_id, formatted, len(regexp_extract_all(formatted, '-+ PAGE [0-9]+ START -+')) AS n_start, len(regexp_extract_all(formatted, '-+ PAGE [0-9]+ END -+')) AS n_end FROM fm""",
    "format_headers": f"WITH {RESULTS} SELECT doc_id, array_to_string([repeat('=', 60), '[DOCUMENT FILENAME: ' || coalesce(filename, '') || ']', 'Pages: ' || format('{{:,}}', coalesce(page_count, 0)), 'Words: ' || format('{{:,}}', coalesce(word_count, 0)), repeat('=', 60)], chr(10)) AS header FROM r",
    "format_round_trip": f"WITH {RPAGES} SELECT doc_id, page::INT AS page, coalesce(text, '') AS text FROM rp",
    "durations": f"WITH {RESULTS} SELECT doc_id, round(extraction_time, 2) AS seconds, CASE WHEN s < 60 THEN floor(s)::BIGINT || 's' WHEN s < 3600 THEN floor(s / 60)::BIGINT || 'm' ELSE floor(s / 3600)::BIGINT || 'h' END AS eta FROM (SELECT *, extraction_time * 100 AS s FROM r)",
}
ORACLES["extraction_confidence"] = f"WITH {RESULTS}, cv AS ({LAYOUT_ORACLES['coverage_report']}), fr AS ({ORACLES['footnote_report']}) SELECT doc_id, round(0.5 * coalesce(score, 0) / 100 + 0.3 * least(coalesce(coverage_percent, 100.0), 100.0) / 100 + 0.2 * least(coalesce(match_rate, 100.0), 100.0) / 100, 4) AS extraction_confidence FROM r LEFT JOIN cv USING (doc_id) LEFT JOIN fr USING (doc_id)"
ORACLES["section_starts"] = f"""WITH {RESULTS}, s AS (SELECT doc_id, regexp_extract_all(raw_text, '{SECTION}') AS m, list_transform(string_split_regex(raw_text, '{SECTION}'), lambda x: length(x)) AS b FROM r WHERE length(raw_text) > 0)
    SELECT doc_id, (list_sum(b[1:k]) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0))::INT AS position, m[k] AS start_text FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM s WHERE len(m) > 0)"""
TOUCH = "NOT (o.x1 < k.x0 OR k.x1 < o.x0 OR o.bottom < k.top OR k.bottom < o.top)"
ORACLES["tables_kept"] = f"""WITH RECURSIVE {CELLS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY confidence DESC, table_ix) AS rn FROM t),
    gk AS (SELECT doc_id, page, rn, [{{'ix': table_ix, 'x0': x0, 'top': top, 'x1': x1, 'bottom': bottom}}] AS kept FROM o WHERE rn = 1
        UNION ALL SELECT o.doc_id, o.page, o.rn, CASE WHEN len(list_filter(gk.kept, lambda k: {TOUCH})) > 0 THEN gk.kept ELSE list_append(gk.kept, {{'ix': o.table_ix, 'x0': o.x0, 'top': o.top, 'x1': o.x1, 'bottom': o.bottom}}) END FROM gk JOIN o ON o.doc_id = gk.doc_id AND o.page = gk.page AND o.rn = gk.rn + 1)
    SELECT doc_id, page, unnest(kept).ix AS table_ix FROM (SELECT * FROM gk QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY rn DESC) = 1)"""
ORACLES["sidebars"] = f"""WITH {WORDS}, x AS (SELECT doc_id, page, min(x0) AS lo, max(x1) AS hi FROM w GROUP BY ALL), p AS (SELECT w.*, x1 < lo + 0.2 * width AS l, x0 > hi - 0.2 * width AS r FROM w JOIN x USING (doc_id, page) JOIN z USING (doc_id, page)),
    s AS (SELECT doc_id, page, 'left' AS side, count(*) FILTER (l) AS n_words, min(x0) FILTER (NOT l) - max(x1) FILTER (l) AS gap, string_agg(text, ' ' ORDER BY top, x0, word_ix) FILTER (l) AS text FROM p GROUP BY ALL
        UNION ALL SELECT doc_id, page, 'right', count(*) FILTER (r), min(x0) FILTER (r) - max(x1) FILTER (NOT r), string_agg(text, ' ' ORDER BY top, x0, word_ix) FILTER (r) FROM p GROUP BY ALL)
    SELECT doc_id, page, side, n_words, text FROM s WHERE n_words >= 5 AND gap > 30"""
ORACLES["sidebars_narrow"] = ORACLES["sidebars"].replace("n_words >= 5 AND gap > 30", "n_words >= 2 AND gap > 5")
ORACLES["grid_cells"] = f"""WITH {WORDS}, x0s AS (SELECT doc_id, page, x0 AS v, CASE WHEN x0 - lag(x0) OVER (PARTITION BY doc_id, page ORDER BY x0) > 5 THEN 1 ELSE 0 END AS nn FROM w), x1s AS (SELECT *, sum(nn) OVER (PARTITION BY doc_id, page ORDER BY v RANGE UNBOUNDED PRECEDING) AS c FROM x0s), cx AS (SELECT doc_id, page, c, avg(v) AS col_x FROM x1s GROUP BY ALL HAVING count(*) >= 3),
    y0s AS (SELECT doc_id, page, top AS v, CASE WHEN top - lag(top) OVER (PARTITION BY doc_id, page ORDER BY top) > 9 THEN 1 ELSE 0 END AS nn FROM w), y1s AS (SELECT *, sum(nn) OVER (PARTITION BY doc_id, page ORDER BY v RANGE UNBOUNDED PRECEDING) AS c FROM y0s), cy AS (SELECT doc_id, page, c, avg(v) AS row_y FROM y1s GROUP BY ALL HAVING count(*) >= 3)
    SELECT w.doc_id, w.page, round(row_y, 6) AS row_y, round(col_x, 6) AS col_x, string_agg(text, ' ' ORDER BY word_ix) AS cell_text FROM w JOIN cx ON cx.doc_id = w.doc_id AND cx.page = w.page AND abs(x0 - col_x) <= 10 JOIN cy ON cy.doc_id = w.doc_id AND cy.page = w.page AND abs(top - row_y) <= 9 GROUP BY w.doc_id, w.page, row_y, col_x"""
ORACLES["notes_appended"] = f"""WITH pt AS ({LAYOUT_ORACLES['page_text']}), fd AS (SELECT DISTINCT ON (footnote_id) *, page_number AS page FROM footnote_definitions), n AS (SELECT doc_id, page, string_agg(concat_ws(' ', marker, text), chr(10) ORDER BY y, footnote_id) AS lines FROM fd GROUP BY ALL)
    SELECT doc_id, page, page_text || coalesce(chr(10) || chr(10) || repeat('-', 40) || chr(10) || 'FOOTNOTES:' || chr(10) || lines, '') AS page_text FROM pt LEFT JOIN n USING (doc_id, page)"""
ORACLES["page_text_tables"] = f"""WITH pt AS ({LAYOUT_ORACLES['page_text']}), tt AS ({ORACLES['table_texts']}), {CELLS}, b AS (SELECT doc_id, page, string_agg(pipes, chr(10) || chr(10) ORDER BY top, table_ix) AS blocks FROM tt JOIN t USING (doc_id, page, table_ix) GROUP BY ALL)
    SELECT doc_id, page, page_text || coalesce(chr(10) || chr(10) || blocks, '') AS page_text FROM pt LEFT JOIN b USING (doc_id, page)"""
ORACLES["flag_prompts"] = f"WITH {FLAGS} SELECT flag_id, (length('{M.PROMPT.replace(chr(37) + 's', '').replace(chr(39), chr(39) * 2)}') + length(flag_type) + 2 + length(coalesce(message, '')))::INT AS n_prompt, coalesce(message, '') AS corrected, 0.9::DOUBLE AS confidence FROM f"
ORACLES["flag_boxes"] = f"""WITH {FLAGS}, wd AS (SELECT flag_id, upper(severity) AS k, list_filter(regexp_split_to_array(coalesce(context, ''), '[ \\t\\n]+'), lambda x: x <> '') AS ws FROM f),
    ls AS (SELECT *, CASE WHEN len(ws) = 0 THEN [] ELSE string_split(list_reduce(ws, lambda a, x: a || CASE WHEN length(string_split(a, chr(10))[-1]) + 1 + length(x) <= 56 THEN ' ' ELSE chr(10) END || x), chr(10)) END AS lines FROM wd)
    SELECT flag_id, '[' || k || ' BOX]' || chr(10) || array_to_string(list_transform(lines, lambda x: '| ' || rpad(x, 56, ' ') || ' |'), chr(10)) || chr(10) || '[END ' || k || ' BOX]' AS box FROM ls"""
