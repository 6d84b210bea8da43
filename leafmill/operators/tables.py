"""Tables: assembly from cells, validity, overlaps, headers and text forms.

A table is a row of (doc_id, page, table_ix, rows array<array<string>>, box, confidence).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.layout import clusters, near_pairs

TABLE = ["doc_id", "page", "table_ix"]
BLANKS = " \t\n\r\u00a0\u2002\u2003\u2009\u202f\u3000"


def clean_cells(cells: DataFrame) -> DataFrame:
    """Each cell once; null texts as empty, others trimmed."""
    return cells.dropDuplicates(["cell_id"]).withColumn("text", F.trim(F.coalesce("text", F.lit("")), F.lit(BLANKS))).withColumnRenamed("page_number", "page")


def assemble(cells: DataFrame, least_rows: int = 2) -> DataFrame:
    """Tables of `least_rows` rows or more: rows of equal width (a missing cell is empty, of two in one place the greater text stands), the box around the cells, the mean confidence."""
    row = cells.groupBy(*TABLE, "row_no").agg(F.collect_list(F.struct("col_no", "text")).alias("_cells"), F.max("col_no").alias("_last"), F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), F.sum(F.col("confidence").cast("decimal(18,6)")).alias("_sum"), F.count("confidence").alias("_n"))
    table = row.groupBy(*TABLE).agg(
        F.array_sort(F.collect_list(F.struct("row_no", "_cells"))).alias("_rows"),
        (F.max("_last") + 1).alias("n_cols"),
        F.count("*").alias("n_rows"),
        F.min("x0").alias("x0"),
        F.min("top").alias("top"),
        F.max("x1").alias("x1"),
        F.max("bottom").alias("bottom"),
        (F.sum("_sum").cast("double") / F.sum("_n")).alias("confidence"),  # an exact sum, whatever the order
    )
    wide = F.transform("_rows", lambda r: F.transform(F.sequence(F.lit(0), F.col("n_cols") - 1), lambda c: F.coalesce(F.array_max(F.transform(F.filter(r["_cells"], lambda x: x["col_no"] == c), lambda x: x["text"])), F.lit(""))))
    return table.where(F.col("n_rows") >= least_rows).withColumn("rows", wide).drop("_rows")


def is_valid(rows: Column, confidence: Column, least: int = 3, sure: float = 0.8, filled: float = 0.5) -> Column:
    """Whether a table has `least` rows and columns, enough confidence and half of its cells filled."""
    cells = F.flatten(rows)
    full = F.size(F.filter(cells, lambda c: c != ""))
    return (F.size(rows) >= least) & (F.size(rows[0]) >= least) & (confidence >= sure) & (full >= filled * F.size(cells))


def is_valid_text_table(rows: Column, confidence: Column, sure: float = 0.9, most_rows: int = 20, most_columns: int = 10, distinct: float = 0.3) -> Column:
    """Whether a table that was found by its text alone is one: surer, of bounded size, and not the same few cells over and over."""
    cells = F.flatten(rows)
    varied = F.size(F.array_distinct(cells)) >= distinct * F.size(cells)
    return is_valid(rows, confidence, 3, sure) & (F.size(rows) <= most_rows) & (F.size(rows[0]) <= most_columns) & varied


def fill_share(rows: Column) -> Column:
    """Share of the cells that hold text."""
    cells = F.flatten(rows)
    return F.size(F.filter(cells, lambda c: c != "")) / F.size(cells)


def has_number_free_header(rows: Column) -> Column:
    """Header rule 1: no number in the first row, one or more in the others."""
    number = lambda c: F.regexp_replace(c, "[.,]", "").rlike("^[0-9]+$")
    rest = F.flatten(F.slice(rows, F.lit(2), F.size(rows)))
    return (F.size(rows) > 1) & ~F.exists(rows[0], number) & F.exists(rest, number)


def has_short_header(rows: Column) -> Column:
    """Header rule 2: no figure in the first row, and a figure in the others or a first row not much longer than they are on average."""
    figure = lambda c: c.rlike("^[0-9.,]+$")
    rest = F.flatten(F.slice(rows, F.lit(2), F.size(rows)))
    mean = lambda cells: F.aggregate(cells, F.lit(0.0), lambda a, c: a + F.length(c)) / F.size(cells)
    return (F.size(rows) > 1) & ~F.exists(rows[0], figure) & (F.exists(rest, figure) | (mean(rows[0]) < 1.5 * mean(rest)))


def _fitted(cell: Column, width: Column) -> Column:
    cut = F.concat(F.substring(cell, F.lit(1), width - 3), F.lit("..."))
    return F.rpad(F.when(F.length(cell) > width, cut).otherwise(cell), width, " ")


def to_pipes(rows: Column, header: Column, widest: int = 30) -> Column:
    """Padded cells between pipes, cut at `widest`, with a rule under the header."""
    widths = F.transform(
        F.sequence(F.lit(0), F.size(rows[0]) - 1),
        lambda c: F.least(F.lit(widest), F.greatest(F.lit(3), F.array_max(F.transform(rows, lambda r: F.length(r[c]))))),
    )
    line = lambda r: F.array_join(F.zip_with(r, widths, _fitted), " | ")
    rule = F.array_join(F.transform(widths, lambda w: F.repeat(F.lit("-"), w)), "-+-")
    body = F.transform(rows, line)
    lines = F.when(header, F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, F.lit(2), F.size(body)))).otherwise(body)
    return F.array_join(lines, "\n")


def to_markdown(rows: Column) -> Column:
    """A markdown table, the first row as its header."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(rows[0])))
    body = F.transform(rows, line)
    return F.array_join(F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, F.lit(2), F.size(body))), "\n")


def to_tabs(rows: Column) -> Column:
    """Cells parted by tabs."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, "\t")), "\n")


def marked_table(rows: Column, text: Column) -> Column:
    """A table's text between its marks."""
    return F.concat(F.format_string("[TABLE: %dx%d]\n", F.size(rows), F.size(rows[0])), text, F.lit("\n[TABLE END]"))


def method_marked_table(rows: Column, text: Column, method: Column, confidence: Column) -> Column:
    """A table's text between its marks, which tell how it was found and how sure it is."""
    return F.concat(F.format_string("[TABLE: %dx%d | %s | %d%%]\n", F.size(rows), F.size(rows[0]), method, F.round(confidence * 100).cast("int")), text, F.lit("\n[TABLE END]"))


def method_summary(found: DataFrame) -> DataFrame:
    """Numbers of tables and pages with one by method."""
    return found.groupBy("method").agg(F.count("*").alias("n_tables"), F.countDistinct("doc_id", "page").alias("n_pages"))


def keep_surest(tables: DataFrame) -> DataFrame:
    """Of tables of a page whose boxes touch the surest, the earlier on a tie.

    A greedy choice depends on what was kept before, so a page's tables, a handful, are folded in order of confidence.
    """
    item = F.struct((-F.col("confidence")).alias("_minus"), "table_ix", "x0", "top", "x1", "bottom")
    ordered = tables.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(item)).alias("_t"))
    start = F.array().cast("array<struct<_minus:double,table_ix:int,x0:double,top:double,x1:double,bottom:double>>")

    def step(acc: Column, t: Column) -> Column:
        touches = F.exists(acc, lambda k: ~((t["x1"] < k["x0"]) | (k["x1"] < t["x0"]) | (t["bottom"] < k["top"]) | (k["bottom"] < t["top"])))
        return F.when(touches, acc).otherwise(F.concat(acc, F.array(t)))

    kept = ordered.select("doc_id", "page", F.explode(F.aggregate("_t", start, step)).alias("_k"))
    return tables.join(kept.select("doc_id", "page", F.col("_k.table_ix").alias("table_ix")), TABLE, "left_semi")


def aligned_rows(words: DataFrame, columns: DataFrame, gap: float = 9.0) -> DataFrame:
    """Row clusters of a page's words, neighbours within `gap`, that at least half as many words as the page has `columns` stand in: mean and size."""
    rows = clusters(words, ["doc_id", "page"], "top", gap, 1)
    wide = columns.groupBy("doc_id", "page").agg(F.count("*").alias("_columns"))
    return rows.join(wide, ["doc_id", "page"]).where(F.col("n") >= 0.5 * F.col("_columns")).drop("_columns")


def grid_cells(words: DataFrame, columns: DataFrame, rows: DataFrame, dx: float = 10.0, dy: float = 9.0) -> DataFrame:
    """The words at each crossing of aligned columns and rows of a page, joined by spaces; a word can fall in several."""
    page = ["doc_id", "page"]
    c, r, w = columns.select(*page, F.col("mean").alias("col_x")), rows.select(*page, F.col("mean").alias("row_y")), words.select(*page, "word_ix", "text", "x0", "top")
    # A word meets the columns near it by bands of x, then the rows near it by bands of y.
    at_column = near_pairs(w, c, "x0", "col_x", dx)
    both = near_pairs(at_column, r, "top", "row_y", dy)
    texts = F.array_sort(F.collect_list(F.struct("word_ix", "text")))
    joined = both.groupBy(*page, "row_y", "col_x").agg(texts.alias("_w"))
    return joined.select("doc_id", "page", "row_y", "col_x", F.array_join(F.transform("_w", lambda x: x["text"]), " ").alias("cell_text"))


# Words that tell the kind of a box, the first kind that has one.
BOX_KINDS = [("warning", "warning|警告|caution|注意|danger|危険"), ("note", "note|注|info|情報|tip|hint"), ("example", "example|例|sample|サンプル")]


def box_kind(text: Column) -> Column:
    """warning, note, example or generic by the words of a box."""
    kind = F.lit("generic")
    for name, pattern in reversed(BOX_KINDS):
        kind = F.when(F.lower(text).rlike(pattern), name).otherwise(kind)
    return kind


def boxes(words: DataFrame, rects: DataFrame, tables: DataFrame, least: int = 5) -> DataFrame:
    """Rectangles of 50 x 20 or more that touch no table and hold the centres of `least` words: text and box_type."""
    r, t, w = rects.where((F.col("x1") - F.col("x0") >= 50) & (F.col("bottom") - F.col("top") >= 20)).alias("r"), tables.alias("t"), words.alias("w")
    same = lambda a, b: (F.col(f"{a}.doc_id") == F.col(f"{b}.doc_id")) & (F.col(f"{a}.page") == F.col(f"{b}.page"))
    apart = (F.col("r.x1") < F.col("t.x0")) | (F.col("t.x1") < F.col("r.x0")) | (F.col("r.bottom") < F.col("t.top")) | (F.col("t.bottom") < F.col("r.top"))
    free = r.join(t, same("r", "t") & ~apart, "left_anti").alias("r")
    x, y = (F.col("w.x0") + F.col("w.x1")) / 2, (F.col("w.top") + F.col("w.bottom")) / 2
    inside = x.between(F.col("r.x0"), F.col("r.x1")) & y.between(F.col("r.top"), F.col("r.bottom"))
    held = free.join(w, same("r", "w") & inside).groupBy("r.doc_id", "r.page", "r.rect_ix").agg(F.array_sort(F.collect_list(F.struct("w.word_ix", "w.text"))).alias("_w"))
    texts = held.where(F.size("_w") >= least).select("doc_id", "page", "rect_ix", F.array_join(F.transform("_w", lambda v: v["text"]), " ").alias("text"))
    return texts.withColumn("box_type", box_kind(F.col("text")))


def sidebars(words: DataFrame, sizes: DataFrame, share: float = 0.2, gap: float = 30.0, least: int = 5) -> DataFrame:
    """Page rows of side (left, right) and text where `least` words end within the outer `share` of the width and a gap parts them from the rest."""
    page = ["doc_id", "page"]
    extent = words.groupBy(*page).agg(F.min("x0").alias("_left"), F.max("x1").alias("_right"))
    placed = words.join(extent, page).join(sizes.select(*page, "width"), page)
    parts = []
    for side, inside, edge in (
        ("left", F.col("x1") < F.col("_left") + share * F.col("width"), F.min(F.when(~F.col("_in"), F.col("x0"))) - F.max(F.when(F.col("_in"), F.col("x1")))),
        ("right", F.col("x0") > F.col("_right") - share * F.col("width"), F.min(F.when(F.col("_in"), F.col("x0"))) - F.max(F.when(~F.col("_in"), F.col("x1")))),
    ):
        texts = F.array_sort(F.collect_list(F.when(F.col("_in"), F.struct("top", "x0", "word_ix", "text"))))
        grouped = placed.withColumn("_in", inside).groupBy(*page).agg(F.count_if("_in").alias("n_words"), edge.alias("gap"), texts.alias("_w"))
        kept = grouped.where((F.col("n_words") >= least) & (F.col("gap") > gap))
        parts.append(kept.select(*page, F.lit(side).alias("side"), "n_words", F.array_join(F.transform("_w", lambda v: v["text"]), " ").alias("text")))
    return parts[0].unionByName(parts[1])


def shared_area(a: Column, b: Column) -> Column:
    """The share of the smaller of two boxes that lies in the other; 0 for boxes without area."""
    wide = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0))
    high = F.greatest(F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"]), F.lit(0.0))
    area = lambda r: (r["x1"] - r["x0"]) * (r["bottom"] - r["top"])
    smaller = F.least(area(a), area(b))
    return F.when(smaller > 0, wide * high / smaller).otherwise(0.0)


def merge_methods(found: DataFrame, boost: float = 0.1) -> DataFrame:
    """Tables of several methods (method, table_ix, box, confidence) as one list for each page.

    In order of confidence a table that shares over half of the smaller area with a kept one is dropped; if
    another method found it, the kept one gains `boost`, up to 1.
    """
    item = F.struct((-F.col("confidence")).alias("_minus"), "method", "table_ix", "x0", "top", "x1", "bottom")
    ordered = found.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(item)).alias("_t"))
    start = F.array().cast("array<struct<method:string,table_ix:int,x0:double,top:double,x1:double,bottom:double,confidence:double>>")

    def step(acc: Column, t: Column) -> Column:
        same = lambda k: shared_area(k, t) > 0.5
        first = F.array_position(F.transform(acc, same), True)
        fields = ("method", "table_ix", "x0", "top", "x1", "bottom")
        grown = F.transform(acc, lambda k, i: F.struct(*(k[c].alias(c) for c in fields), F.when((i + 1 == first) & (k["method"] != t["method"]), F.least(F.lit(1.0), k["confidence"] + boost)).otherwise(k["confidence"]).alias("confidence")))
        fresh = F.struct(*(t[c].alias(c) for c in fields), (-t["_minus"]).alias("confidence"))
        return F.when(first > 0, grown).otherwise(F.concat(acc, F.array(fresh)))

    return ordered.select("doc_id", "page", F.explode(F.aggregate("_t", start, step)).alias("_k")).select("doc_id", "page", "_k.*")


def alignment_confidence(filled: Column) -> Column:
    """Of a table found by aligned words: .6 and .3 of its filled share."""
    return 0.6 + 0.3 * filled


def whitespace_confidence(regularity: Column) -> Column:
    """Of a table found by regular gaps: .7 and .2 of the regularity."""
    return 0.7 + 0.2 * regularity


def regions(tables: DataFrame, boxes_: DataFrame) -> DataFrame:
    """Tables and boxes as one relation, told apart by region_type; what only one kind has is null for the other."""
    return tables.withColumn("region_type", F.lit("table")).unionByName(boxes_.withColumn("region_type", F.lit("textbox")), allowMissingColumns=True)


def ordered_regions(found: DataFrame) -> DataFrame:
    """Regions with their place on the page, from the top down and from the left; ties by kind."""
    place = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("top", "x0", "region_type"))
    return found.withColumn("place", place)


def pages_with_tables(texts: DataFrame, tables: DataFrame) -> DataFrame:
    """Page texts with their tables' marked texts behind them, from the top down."""
    block = marked_table(F.col("rows"), to_pipes(F.col("rows"), has_number_free_header(F.col("rows"))))
    blocks = tables.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("top", "table_ix", block.alias("t")))).alias("_b"))
    joined = texts.join(blocks, ["doc_id", "page"], "left")
    added = F.concat(F.lit("\n\n"), F.array_join(F.transform("_b", lambda x: x["t"]), "\n\n"))
    return joined.select("doc_id", "page", F.concat("page_text", F.coalesce(added, F.lit(""))).alias("page_text"))
