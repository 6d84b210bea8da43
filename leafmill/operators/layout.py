"""Positioned words: filters, columns, lines, bands, spacing, scripts and page text.

Words are rows of (doc_id, page, word_ix, text, x0, top, x1, bottom, fontname, size, height);
word_ix is the decoder's order and breaks every tie. All operators partition by
(doc_id, page), so a page of any document is one unit of work and big documents spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]
WORD = [*PAGE, "word_ix"]


def _in_page() -> WindowSpec:
    return Window.partitionBy(*PAGE)


# Patterns that begin a section number.
SECTION_NUMBER = r"^(?:\d+\.\d+|\(\d+\)|[①-⑳]|\d+[)）]|第?\d+[章条項節款目]|\d+\.|[一二三四五六七八九十]+[、.])"
# Patterns that begin a footnote marker.
FOOTNOTE_MARKER = r"^(?:\*\d+|※\d+|注\d+|†|‡|\[\d+\]|\(\*?\d+\))"
# Patterns that a word of a footnote begins with.
FOOTNOTE_BEGIN = r"^(?:\*\d*|※\d*|注\d*|†|‡|\[\d+\]|\(\d+\)|[¹²³⁴⁵⁶⁷⁸⁹⁰])"
# Words that are nothing but a page number.
STRICT_PAGE_NUMBER = r"^(?:page\s*\d+|p\.\s*\d+|-\s*\d+\s*-|\d+\s*/\s*\d+|\d+\s*ページ|\d+\s*頁)$"
# Phrases of footnotes.
FOOTNOTE_PHRASES = r"参照|参考|出典|引用|See |Ref\.|Note:|Source:|注記|備考"


def clean_words(words: DataFrame) -> DataFrame:
    """Each word once, blank ones left out; repeated rows of a key are exact copies.

    Words are brought together by page first: that one exchange serves the
    dropping of copies and every window and fold over pages behind it.
    """
    return words.where(F.trim("text") != "").repartition(*PAGE).dropDuplicates(WORD)


def page_sizes(words: DataFrame) -> DataFrame:
    """The extent of the words of each page, for sources without page sizes."""
    return words.groupBy(*PAGE).agg(F.max("x1").alias("width"), F.max("bottom").alias("page_height"))


def sized(words: DataFrame, sizes: DataFrame | None) -> DataFrame:
    """Words with the width and page_height of their page, from `sizes` or, where that is None, from the page's words themselves, without another exchange."""
    if sizes is not None:
        return words.join(sizes, PAGE)
    return words.withColumns({"width": F.max("x1").over(_in_page()), "page_height": F.max("bottom").over(_in_page())})


def columns(words: DataFrame, gap: float = 50.0) -> DataFrame:
    """Adds column_no (from 0): a new column where x0 is more than `gap` beyond the x1 of the word before, by x0."""
    order = _in_page().orderBy("x0", "word_ix")
    opens = F.when(F.col("x0") - F.lag("x1").over(order) > gap, 1).otherwise(0)
    return words.withColumn("_new", opens).withColumn("column_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def lines(words: DataFrame, gap: float = 15.0) -> DataFrame:
    """Adds line_no (from 0) within each column: a new line where top is `gap` or more from the word before, by (top, x0)."""
    order = Window.partitionBy(*PAGE, "column_no").orderBy("top", "x0", "word_ix")
    opens = F.when(F.abs(F.col("top") - F.lag("top").over(order)) >= gap, 1).otherwise(0)
    return words.withColumn("_new", opens).withColumn("line_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def bands(words: DataFrame, reach: float = 15.0) -> DataFrame:
    """page rows of band_no, first_top and the band's word_ix in order.

    Words by (top, x0); a new band where top is more than `reach` from the band's first, an
    anchor that only an ordered fold can carry: a page's words, a few thousand at most, are folded as an array.
    """
    item = F.struct("top", "x0", "word_ix")
    ordered = words.groupBy(*PAGE).agg(F.array_sort(F.collect_list(item)).alias("_w"))
    start = F.array().cast("array<struct<first:double,ix:array<int>>>")

    def step(acc: Column, w: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["first"].alias("first"), F.concat(last["ix"], F.array(w["word_ix"])).alias("ix"))))
        opened = F.concat(acc, F.array(F.struct(w["top"].alias("first"), F.array(w["word_ix"]).alias("ix"))))
        return F.when((F.size(acc) > 0) & (F.abs(w["top"] - F.try_element_at(acc, F.lit(-1))["first"]) <= reach), joined).otherwise(opened)

    folded = ordered.select(*PAGE, F.posexplode(F.aggregate("_w", start, step)).alias("band_no", "_b"))
    return folded.select(*PAGE, "band_no", F.col("_b.first").alias("first_top"), F.col("_b.ix").alias("word_ixs"))


# Japanese letters, and the marks that take no space before or behind them.
JAPANESE = "[\\u3040-\\u30FF\\u4E00-\\u9FFF\\u3400-\\u4DBF]"
NO_SPACE_AFTER = "（「『【〈《([{、。"
NO_SPACE_BEFORE = "）」』】〉》)]}、。，．,.!?！？:;：；"


def needs_space(before: Column, text: Column, gap: Column) -> Column:
    """Whether a space goes between two words of a line, by the gap and the scripts around it."""
    last, first = F.substring(before, -1, 1), F.substring(text, 1, 1)
    both = last.rlike(JAPANESE) & first.rlike(JAPANESE)
    marks = F.lit(NO_SPACE_AFTER).contains(last) | F.lit(NO_SPACE_BEFORE).contains(first)
    return F.when(gap < 2, False).when(both, gap > 10).when(marks, False).otherwise(gap > 3)


def line_texts(lined: DataFrame) -> DataFrame:
    """The text of each line: its words by x0, spaced by needs_space."""
    line = Window.partitionBy(*PAGE, "column_no", "line_no").orderBy("x0", "word_ix")
    spaced = lined.withColumn("_space", needs_space(F.lag("text").over(line), F.col("text"), F.col("x0") - F.lag("x1").over(line)))
    piece = F.concat(F.when(F.col("_space"), " ").otherwise(""), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("x0", "word_ix", piece.alias("piece"))))
    return spaced.groupBy(*PAGE, "column_no", "line_no").agg(F.array_join(F.transform(ordered, lambda w: w["piece"]), "").alias("line_text"))


def page_texts(texts: DataFrame) -> DataFrame:
    """The text of each page: lines joined by a line feed, columns by a blank line."""
    column = texts.groupBy(*PAGE, "column_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "line_text"))).alias("_l"))
    joined = column.select(*PAGE, "column_no", F.array_join(F.transform("_l", lambda x: x["line_text"]), "\n").alias("_t"))
    page = joined.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("column_no", "_t"))).alias("_c"))
    return page.select(*PAGE, F.array_join(F.transform("_c", lambda x: x["_t"]), "\n\n").alias("page_text"))


def zone_strings(words: DataFrame, sizes: DataFrame | None, share: float = 0.1) -> DataFrame:
    """The words of the top and of the bottom zone of each page as one string each: zone, zone_text."""
    placed = sized(words, sizes)
    zone = F.when(F.col("top") < share * F.col("page_height"), "top").when(F.col("top") > (1 - share) * F.col("page_height"), "bottom")
    ordered = F.array_sort(F.collect_list(F.struct("word_ix", "text")))
    texts = placed.withColumn("zone", zone).where("zone IS NOT NULL").groupBy(*PAGE, "zone").agg(ordered.alias("_w"))
    return texts.select(*PAGE, "zone", F.array_join(F.transform("_w", lambda w: w["text"]), " ").alias("zone_text"))


def repeating_zones(zones: DataFrame, pages: DataFrame, sample: int = 5, share: float = 0.8, least: int = 3) -> DataFrame:
    """Zone strings on at least `share` of a document's first `sample` pages, of documents of `least` pages or more."""
    enough = pages.groupBy("doc_id").agg(F.countDistinct("page").alias("_pages")).where(F.col("_pages") >= least).select("doc_id")
    sampled = zones.where(F.col("page") <= sample).join(enough, "doc_id", "left_semi")
    total = sampled.groupBy("doc_id", "zone").agg(F.count("*").alias("_n"))
    counted = sampled.groupBy("doc_id", "zone", "zone_text").agg(F.count("*").alias("n_pages"))
    return counted.join(total, ["doc_id", "zone"]).where(F.col("n_pages") >= share * F.col("_n")).drop("_n")


def near_pairs(a: DataFrame, b: DataFrame, x: str, y: str, reach: float) -> DataFrame:
    """Rows of a page with the rows of `b` whose `y` is within `reach` of their `x`: an equality join on the page and on bands as wide as `reach`, each row of `b` standing in three."""
    band = F.floor(F.col(y) / reach)
    wide = b.withColumn("_band", F.explode(F.array(band - 1, band, band + 1)))
    joined = a.withColumn("_band", F.floor(F.col(x) / reach)).join(wide, [*PAGE, "_band"])
    return joined.where(F.abs(F.col(x) - F.col(y)) <= reach).drop("_band")


def _centre(prefix: str = "") -> tuple[Column, Column]:
    return (F.col(f"{prefix}x0") + F.col(f"{prefix}x1")) / 2, (F.col(f"{prefix}top") + F.col(f"{prefix}bottom")) / 2


def near_words(candidates: DataFrame, words: DataFrame, reach: float = 50.0) -> DataFrame:
    """The candidates that have another word's centre nearer than `reach`; an exact copy of a word is no other word.

    Centres fall into squares as wide as `reach`; a candidate meets the words of its square and the eight around it.
    """
    return candidates.join(_near_keys(candidates, words, reach), WORD, "left_semi")


def _near_keys(candidates: DataFrame, words: DataFrame, reach: float) -> DataFrame:
    x, y = _centre()
    squares = lambda k: (F.floor(x / reach) + k).cast("long"), lambda k: (F.floor(y / reach) + k).cast("long")
    around = F.explode(F.array(*(F.struct(squares[0](i).alias("i"), squares[1](j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    a = candidates.withColumn("_s", around).withColumns({"_i": F.col("_s.i"), "_j": F.col("_s.j")}).drop("_s").alias("a")
    b = words.withColumns({"_i": squares[0](0), "_j": squares[1](0)}).alias("b")
    (ax, ay), (bx, by) = _centre("a."), _centre("b.")
    same_place = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")) & (F.col("a._i") == F.col("b._i")) & (F.col("a._j") == F.col("b._j"))
    other = F.struct(*(F.col(f"a.{c}") for c in ("text", "x0", "top", "x1", "bottom"))) != F.struct(*(F.col(f"b.{c}") for c in ("text", "x0", "top", "x1", "bottom")))
    near = F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)) < reach
    return a.join(b, same_place & other & near, "left_semi").select(*WORD).distinct()


def without_repeated_places(words: DataFrame) -> DataFrame:
    """Of words of one text at one place, rounded to a tenth, the first from the top and the left."""
    first = Window.partitionBy(*PAGE, F.round("x0", 1), F.round("top", 1), "text").orderBy("top", "x0", "word_ix")
    return words.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def footnote_content(words: DataFrame, reach: float = 20.0) -> DataFrame:
    """Words that may be of a footnote: they begin like a marker, stand on a line with another word that does, hold a phrase of footnotes, or are longer than ten characters."""
    text = F.trim("text")
    begins = text.rlike(FOOTNOTE_BEGIN)
    marks = words.where(begins).select(*PAGE, F.col("word_ix").alias("_mark"), F.col("top").alias("_mark_top"))
    beside = near_pairs(words.select(*WORD, "top"), marks, "top", "_mark_top", reach)
    beside = beside.where((F.abs(F.col("top") - F.col("_mark_top")) < reach) & (F.col("word_ix") != F.col("_mark"))).select(*WORD, F.lit(True).alias("_beside")).distinct()
    rule = F.when(begins, "marker").when(F.coalesce("_beside", F.lit(False)), "beside_marker").when(text.rlike(FOOTNOTE_PHRASES), "phrase").when(F.length(text) > 10, "long")
    return words.join(beside, WORD, "left").withColumn("rule", rule).where("rule IS NOT NULL").drop("_beside")


def page_kinds(words: DataFrame, pages: DataFrame) -> DataFrame:
    """What becomes of each analysed page: its text where it has words, else a placeholder if it is scanned, an error mark if it holds characters that weren't read, nothing if it is blank."""
    held = words.groupBy(*PAGE).agg(F.count("*").alias("n_words"))
    n = F.coalesce("n_words", F.lit(0))
    kind = F.when(n > 0, "text").when(F.col("is_scanned"), "scanned").when(F.coalesce("char_count", F.lit(0)) > 0, "error").otherwise("blank")
    filler = F.when(kind == "scanned", F.format_string("[SCANNED PAGE %d - OCR REQUIRED]", F.col("page"))).when(kind == "error", F.format_string("[EXTRACTION ERROR: Page %d]", F.col("page"))).when(kind == "blank", "")
    joined = pages.withColumnRenamed("page_number", "page").join(held, PAGE, "left")
    return joined.select(*PAGE, kind.alias("kind"), n.alias("n_words"), filler.alias("placeholder"))


def tagged_rotation(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Words with the rotation of their page (0 where it isn't known); places stay as they are."""
    angles = pages.select("doc_id", F.col("page_number").alias("page"), F.coalesce("rotation_angle", F.lit(0)).alias("_angle"))
    return words.join(angles, PAGE, "left").withColumn("rotated", F.coalesce("_angle", F.lit(0))).drop("_angle")


def metadata_filter(words: DataFrame, sizes: DataFrame | None, repeated: DataFrame, drop_page_numbers: bool = True) -> DataFrame:
    """Words with `keep` and the deciding `rule`, first hit first.

    Section numbers and footnote markers stay; strict page numbers, words of repeated zones
    and short numbers in a page-number place go; in the top twentieth only
    words higher than 14 stay; in the bottom tenth what isn't a page number stays.
    """
    edge = sized(words, sizes)
    h, w = F.col("page_height"), F.col("width")
    in_margin = (F.col("top") < 0.1 * h) | (F.col("top") > 0.9 * h)
    at_side = (F.abs((F.col("x0") + F.col("x1")) / 2 - w / 2) < 0.2 * w) | (F.col("x0") < 0.2 * w) | (F.col("x1") > 0.8 * w)
    placed = F.col("text").rlike(r"^\d+$") & in_margin & at_side
    near = _near_keys(edge.where(placed), words, 50.0).withColumn("_near", F.lit(True))
    zone = F.when(F.col("top") < 0.1 * h, "top").when(F.col("top") > 0.9 * h, "bottom")
    marked = edge.join(near, WORD, "left").withColumn("_number", placed & F.col("_near").isNull()).drop("_near").withColumn("zone", zone)
    marked = marked.join(repeated.select("doc_id", "zone", F.lit(True).alias("_repeated")).distinct(), ["doc_id", "zone"], "left")
    number = F.coalesce("_number", F.lit(False))
    rule = (
        F.when(F.col("text").rlike(SECTION_NUMBER), "section")
        .when(F.col("text").rlike(FOOTNOTE_MARKER), "footnote")
        .when(F.lower("text").rlike(STRICT_PAGE_NUMBER) & F.lit(drop_page_numbers), "page_number")
        .when(F.coalesce("_repeated", F.lit(False)), "repeated")
        .when(number & (F.length("text") <= 3), "lonely_number")
        .when(F.col("top") < 0.05 * h, F.when(F.coalesce("height", F.lit(0.0)) > 14, "top_large").otherwise("top_margin"))
        .when((F.col("top") > 0.9 * h) & number, "bottom_number")
        .otherwise("body")
    )
    return marked.withColumn("rule", rule).withColumn("keep", F.col("rule").isin("section", "footnote", "top_large", "body")).drop("_number", "_repeated", "width", "page_height", "zone")


def same_line_markers(words: DataFrame, reach: float = 20.0) -> DataFrame:
    """Words on whose line, within `reach` of top, another word is a footnote marker."""
    a, b = words.alias("a"), words.where(F.col("text").rlike(FOOTNOTE_MARKER)).alias("b")
    on = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")) & (F.col("a.word_ix") != F.col("b.word_ix"))
    return a.join(b, on & (F.abs(F.col("a.top") - F.col("b.top")) < reach), "left_semi")


def outside_tables(words: DataFrame, tables: DataFrame) -> DataFrame:
    """Words whose centre lies in no table's closed box: equality on the page, the box as residual condition."""
    x, y = (F.col("w.x0") + F.col("w.x1")) / 2, (F.col("w.top") + F.col("w.bottom")) / 2
    inside = x.between(F.col("t.x0"), F.col("t.x1")) & y.between(F.col("t.top"), F.col("t.bottom"))
    return words.alias("w").join(tables.alias("t"), (F.col("w.doc_id") == F.col("t.doc_id")) & (F.col("w.page") == F.col("t.page")) & inside, "left_anti")


def overlap_pairs(words: DataFrame, share: float = 0.5, band: float = 20.0) -> DataFrame:
    """Pairs of words of a page whose boxes share more than `share` of the smaller one.

    A box stands in every square of `band` that it touches, so only boxes of one square meet; a pair that meets in several counts once.
    """
    squares = lambda lo, hi: F.sequence(F.floor(F.col(lo) / band), F.floor(F.greatest(lo, hi) / band))
    placed = words.withColumn("_i", F.explode(squares("x0", "x1"))).withColumn("_j", F.explode(squares("top", "bottom")))
    a, b = placed.alias("a"), placed.alias("b")
    wide = F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0")
    high = F.least("a.bottom", "b.bottom") - F.greatest("a.top", "b.top")
    area = lambda p: (F.col(f"{p}.x1") - F.col(f"{p}.x0")) * (F.col(f"{p}.bottom") - F.col(f"{p}.top"))
    smaller = F.least(area("a"), area("b"))
    on = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")) & (F.col("a._i") == F.col("b._i")) & (F.col("a._j") == F.col("b._j")) & (F.col("a.word_ix") < F.col("b.word_ix"))
    found = a.join(b, on & (wide > 0) & (high > 0)).where((smaller > 0) & (wide * high > share * smaller))
    return found.select(F.col("a.doc_id"), F.col("a.page"), F.col("a.word_ix").alias("word_a"), F.col("b.word_ix").alias("word_b")).distinct()


def inventory(words: DataFrame, sizes: DataFrame | None) -> DataFrame:
    """Per page: words by region (top .15, bottom .15) and by size class; null sizes fall back to heights."""
    placed = sized(words, sizes)
    size = F.coalesce("size", "height", F.lit(0.0))
    h = F.col("page_height")
    return placed.groupBy(*PAGE).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("top") < 0.15 * h).alias("top_region"),
        F.count_if((F.col("top") >= 0.15 * h) & (F.col("top") <= 0.85 * h)).alias("middle_region"),
        F.count_if(F.col("top") > 0.85 * h).alias("bottom_region"),
        F.count_if(size > 18).alias("large_text"),
        F.count_if((size >= 10) & (size <= 18)).alias("standard_text"),
        F.count_if((size >= 6) & (size < 10)).alias("small_text"),
        F.count_if(size < 6).alias("tiny_text"),
    )


def size_distribution(words: DataFrame) -> DataFrame:
    """Per page a row for each size, with its number of words."""
    return words.groupBy(*PAGE, F.coalesce("size", "height").alias("size")).agg(F.count("*").alias("n_words"))


REGIONS = ("top_region", "middle_region", "bottom_region")
SIZES = ("large_text", "standard_text", "small_text", "tiny_text")


def coverage(inventories: DataFrame, extracted: DataFrame) -> DataFrame:
    """Per document: expected words, extracted words, coverage and missing percent, status by the unrounded coverage, words by region and by size."""
    expected = inventories.groupBy("doc_id").agg(F.sum("total").alias("expected"), *(F.sum(c).alias(c) for c in (*REGIONS, *SIZES)))
    both = expected.join(extracted.select("doc_id", F.col("n_words").alias("extracted")), "doc_id", "left").na.fill(0, ["extracted"])
    share = F.when(F.col("expected") > 0, F.col("extracted") * 100.0 / F.col("expected")).otherwise(0.0)
    missing = F.greatest(F.col("expected") - F.col("extracted"), F.lit(0))
    missing_share = F.when(F.col("expected") > 0, missing * 100.0 / F.col("expected")).otherwise(0.0)
    status = F.when(share >= 85, "GOOD").when(share >= 70, "WARNING").otherwise("POOR")
    return both.select("doc_id", "expected", "extracted", missing.alias("missing"), F.round(share, 2).alias("coverage_percent"), F.round(missing_share, 2).alias("missing_percent"), status.alias("status"), *REGIONS, *SIZES)


def trimmed_sizes(words: DataFrame) -> DataFrame:
    """Per page the mean font size without the tenth at either end: of positive sizes, else of positive heights, else 12."""
    sizes = F.array_sort(F.filter(F.collect_list("size"), lambda s: (s > 0) & ~F.isnan(s)))
    heights = F.array_sort(F.filter(F.collect_list("height"), lambda s: (s > 0) & ~F.isnan(s)))
    per_page = words.groupBy(*PAGE).agg(sizes.alias("_s"), heights.alias("_h"))
    values = F.when(F.size("_s") > 0, F.col("_s")).otherwise(F.col("_h"))
    cut = F.floor(F.size("_v") / 10).cast("int")
    kept = F.slice("_v", cut + 1, F.size("_v") - 2 * cut)
    mean = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept)
    return per_page.select(*PAGE, values.alias("_v")).select(*PAGE, F.when(F.size("_v") > 0, mean).otherwise(12.0).alias("average_size"))


def scripts(words: DataFrame, averages: DataFrame) -> DataFrame:
    """Adds relative_size, baseline_offset, is_superscript and is_subscript to words, and their neighbours' texts.

    A word is small under .7 of the page's average. Tops grow downward, so a small word whose
    top is a fifth of the size above the word before is raised, a fifth below lowered.
    """
    order = _in_page().orderBy("top", "x0", "word_ix")
    size = F.coalesce("size", "height", F.lit(0.0))
    placed = words.join(averages, PAGE).withColumn("_size", size)
    placed = placed.select(
        "*",
        (F.col("_size") / F.col("average_size")).alias("relative_size"),
        F.lag("text").over(order).alias("preceding_text"),
        F.lead("text").over(order).alias("following_text"),
        F.lag("top").over(order).alias("_top"),
        F.lag("_size").over(order).alias("_before"),
    )
    offset = F.when(F.col("_before") > 0, (F.col("top") - F.col("_top")) / F.col("_before")).otherwise(0.0)
    small = F.col("relative_size") < 0.7
    marks = F.col("text").rlike(r"^(?:[⁰¹²³⁴⁵⁶⁷⁸⁹]+|\*\d+|\[\d+\])$")
    raised = small & ((F.col("baseline_offset") < -0.2) | marks | F.coalesce(F.col("preceding_text").isin("*", "†", "‡", "※"), F.lit(False)))
    lowered = small & ~raised & ((F.col("baseline_offset") > 0.2) | F.col("text").rlike("^[₀₁₂₃₄₅₆₇₈₉]+$"))
    return (
        placed.withColumn("baseline_offset", offset)
        .withColumn("is_superscript", raised)
        .withColumn("is_subscript", lowered)
        .drop("_size", "_top", "_before", "average_size")
    )


# Characters that have a raised or a lowered form.
RAISED = ("0123456789+-=()ni*", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ*")
LOWERED = ("0123456789+-=()aeox", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₒₓ")


def to_superscript(text: Column) -> Column:
    """The text in raised characters; those without one stay."""
    return F.translate(text, *RAISED)


def to_subscript(text: Column) -> Column:
    """The text in lowered characters; those without one stay."""
    return F.translate(text, *LOWERED)


def script_markup(marked: DataFrame) -> DataFrame:
    """Adds markup: ^{x} for raised words, _{x} for lowered ones, the text for others."""
    made = F.when(F.col("is_superscript"), F.concat(F.lit("^{"), "text", F.lit("}"))).when(F.col("is_subscript"), F.concat(F.lit("_{"), "text", F.lit("}")))
    return marked.withColumn("markup", F.coalesce(made, "text"))


def attach_scripts(words: DataFrame, reach: float = 5.0, gap: float = 15.0, small: float = 0.7) -> DataFrame:
    """Per page and band the words by x0 with small ones attached to the word they follow: (band_no, item_no, text).

    A word of full size takes in the following small ones while each begins within `reach`
    of the extended right end; one whose middle is above the word's middle is raised,
    below lowered, else plain. Small words that follow none stay as they are.
    """
    size = F.coalesce("size", "height", F.lit(10.0))
    sized = words.withColumn("_size", size).withColumn("_avg", F.avg("_size").over(_in_page()))
    banded = bands(words, gap).select(*PAGE, "band_no", F.explode("word_ixs").alias("word_ix"))
    item = F.struct("x0", "word_ix", "x1", "text", ((F.col("top") + F.col("bottom")) / 2).alias("mid"), (F.col("_size") < small * F.col("_avg")).alias("small"))
    folded = sized.join(banded, WORD).groupBy(*PAGE, "band_no").agg(F.array_sort(F.collect_list(item)).alias("_w"))
    start = F.array().cast("array<struct<text:string,x1:double,mid:double,open:boolean>>")

    def step(acc: Column, w: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        takes = (F.size(acc) > 0) & last["open"] & w["small"] & (w["x0"] - last["x1"] < reach)
        form = F.when(w["mid"] < last["mid"], to_superscript(w["text"])).when(w["mid"] > last["mid"], to_subscript(w["text"])).otherwise(w["text"])
        grown = F.struct(F.concat(last["text"], form).alias("text"), w["x1"].alias("x1"), last["mid"].alias("mid"), F.lit(True).alias("open"))
        opened = F.struct(w["text"].alias("text"), w["x1"].alias("x1"), w["mid"].alias("mid"), (~w["small"]).alias("open"))
        return F.when(takes, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(opened)))

    made = folded.select(*PAGE, "band_no", F.posexplode(F.aggregate("_w", start, step)).alias("item_no", "_i"))
    return made.select(*PAGE, "band_no", "item_no", F.col("_i.text").alias("text"))


def clusters(values: DataFrame, keys: list[str], value: str, tolerance: float, least: int) -> DataFrame:
    """Groups of sorted values in which each is within `tolerance` of the one before, of `least` members or more: mean and size."""
    order = Window.partitionBy(*keys).orderBy(value)
    opened = values.withColumn("_new", F.when(F.col(value) - F.lag(value).over(order) > tolerance, 1).otherwise(0))
    numbered = opened.withColumn("cluster_no", F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "cluster_no").agg(F.avg(value).alias("mean"), F.count("*").alias("n")).where(F.col("n") >= least)


def gap_regularity(words: DataFrame, least: float = 15.0) -> DataFrame:
    """Per page 1 - stddev / mean of the gaps over `least` between its distinct left edges, of two gaps or more."""
    edges = words.select(*PAGE, "x0").distinct()
    gaps = edges.withColumn("_gap", F.col("x0") - F.lag("x0").over(_in_page().orderBy("x0"))).where(F.col("_gap") > least)
    return gaps.groupBy(*PAGE).agg(F.count("*").alias("n_gaps"), (1 - F.stddev_samp("_gap") / F.avg("_gap")).alias("regularity")).where("n_gaps >= 2")


# Words that begin a chemical formula.
FORMULA_STARTS = ("H", "O", "C", "N", "Ca", "Na", "CO", "H2", "NH")


def formulas(marked: DataFrame, gap: float = 5.0) -> DataFrame:
    """Chemical formulas of each page: from a start word on while the next begins within `gap` and is a script or a letter word.

    A word closes the formula before it if it can't go on; of one word alone there is no formula. `marked` has the columns of `scripts`.
    """
    form = F.when(F.col("is_superscript"), to_superscript(F.col("text"))).when(F.col("is_subscript"), to_subscript(F.col("text"))).otherwise(F.col("text"))
    goes_on = F.col("is_superscript") | F.col("is_subscript") | F.col("text").rlike("^[A-Za-z]{1,2}$")
    item = F.struct("top", "x0", "word_ix", "x1", form.alias("form"), goes_on.alias("on"), F.col("text").isin(*FORMULA_STARTS).alias("starts"))
    ordered = marked.groupBy(*PAGE).agg(F.sort_array(F.collect_list(item)).alias("_w"))
    start = F.struct(F.lit(None).cast("struct<text:string,x1:double,n:int,first:int>").alias("now"), F.array().cast("array<struct<text:string,first:int>>").alias("done"))

    def step(acc: Column, w: Column) -> Column:
        now = acc["now"]
        extends = now.isNotNull() & w["on"] & (w["x0"] - now["x1"] <= gap) & (w["x0"] - now["x1"] >= -gap)
        closed = F.when(now.isNotNull() & (now["n"] > 1), F.concat(acc["done"], F.array(F.struct(now["text"].alias("text"), now["first"].alias("first"))))).otherwise(acc["done"])
        grown = F.struct(F.concat(now["text"], w["form"]).alias("text"), w["x1"].alias("x1"), (now["n"] + 1).alias("n"), now["first"].alias("first"))
        opened = F.when(w["starts"], F.struct(w["form"].alias("text"), w["x1"].alias("x1"), F.lit(1).alias("n"), w["word_ix"].alias("first")))
        return F.struct(F.when(extends, grown).otherwise(opened).alias("now"), F.when(extends, acc["done"]).otherwise(closed).alias("done"))

    def finish(acc: Column) -> Column:
        now = acc["now"]
        return F.when(now.isNotNull() & (now["n"] > 1), F.concat(acc["done"], F.array(F.struct(now["text"].alias("text"), now["first"].alias("first"))))).otherwise(acc["done"])

    return ordered.select(*PAGE, F.explode(F.aggregate("_w", start, step, finish)).alias("_f")).select(*PAGE, F.col("_f.first").alias("word_ix"), F.col("_f.text").alias("formula"))
