"""Footnote markers in the text, definitions, their matches and how complete they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.layout import FOOTNOTE_MARKER, PAGE, sized


def normal_marker(marker: Column) -> Column:
    """A marker without blanks and colons, full-width signs as narrow ones."""
    return F.translate(F.regexp_replace(marker, "[ \\u3000:：]", ""), "＊（）０１２３４５６７８９", "*()0123456789")


def marker_type(marker: Column) -> Column:
    """star, komejirushi, chu, bracket, paren or dagger by the first sign; null for others."""
    first = F.substring(marker, 1, 1)
    return F.when(first.isin("*", "＊"), "star").when(first == "※", "komejirushi").when(first == "注", "chu").when(first == "[", "bracket").when(first.isin("(", "（"), "paren").when(first.isin("†", "‡"), "dagger")


def markers(words: DataFrame, sizes: DataFrame | None, main: float = 0.8, around: int = 3) -> DataFrame:
    """Markers in a page's upper `main` part, in decoder order, with up to `around` words before and after."""
    placed = sized(words, sizes).where(F.col("top") < main * F.col("page_height"))
    order = Window.partitionBy(*PAGE).orderBy("word_ix")
    before = F.collect_list("text").over(order.rowsBetween(-around, -1))
    after = F.collect_list("text").over(order.rowsBetween(1, around))
    found = placed.withColumn("_before", before).withColumn("_after", after).where(F.col("text").rlike(FOOTNOTE_MARKER))
    context = F.concat_ws(" ", F.concat(F.col("_before"), F.array(F.concat(F.lit("["), F.col("text"), F.lit("]"))), F.col("_after")))
    return found.select(*PAGE, "word_ix", F.col("text").alias("marker"), context.alias("context"))


def footnote_lines(words: DataFrame, sizes: DataFrame | None, main: float = 0.8, reach: float = 5.0) -> DataFrame:
    """The lines of a page's lower part: a word opens a line when it stands `reach` or more from the line's first word, words in order of the decoder; a line's words go by x0.

    Each line's first word depends on those before, so the words of a page's lower part, which are few, are folded.
    """
    low = sized(words, sizes).where(F.col("top") >= main * F.col("page_height"))
    ordered = low.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("word_ix", "top", "x0", "text"))).alias("_w"))
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("line"), F.array().cast("array<int>").alias("lines"))

    def step(acc: Column, w: Column) -> Column:
        opens = acc["anchor"].isNull() | (F.abs(w["top"] - acc["anchor"]) >= reach)
        line = acc["line"] + opens.cast("int")
        return F.struct(F.when(opens, w["top"]).otherwise(acc["anchor"]).alias("anchor"), line.alias("line"), F.concat(acc["lines"], F.array(line)).alias("lines"))

    placed = ordered.withColumn("_l", F.aggregate("_w", start, step, lambda a: a["lines"]))
    each = placed.select(*PAGE, F.explode(F.arrays_zip("_w", "_l")).alias("_x")).select(*PAGE, F.col("_x._l").alias("line_no"), "_x._w.*")
    texts = F.array_sort(F.collect_list(F.struct("x0", "word_ix", "text")))
    return each.groupBy(*PAGE, "line_no").agg(texts.alias("_t")).select(*PAGE, "line_no", F.array_join(F.transform("_t", lambda x: x["text"]), " ").alias("line_text"))


def definition_spans(lines: DataFrame, keys: list[str], line_no: str | list[str], text: str) -> DataFrame:
    """Definitions from ordered lines: one begins at a marker and takes in the lines up to the next; lines before the first are dropped."""
    starts = F.col(text).rlike(FOOTNOTE_MARKER)
    line_no = [line_no] if isinstance(line_no, str) else line_no
    order = Window.partitionBy(*keys).orderBy(*line_no)
    grouped = lines.withColumn("_d", F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_d > 0")
    joined = grouped.groupBy(*keys, F.col("_d").alias("definition_no")).agg(F.array_sort(F.collect_list(F.struct(*line_no, text))).alias("_l"))
    whole = F.array_join(F.transform("_l", lambda x: x[text]), " ")
    marker = F.regexp_extract(whole, FOOTNOTE_MARKER, 0)
    return joined.select(*keys, "definition_no", marker.alias("marker"), F.regexp_replace(whole, FOOTNOTE_MARKER + "[:： ]*", "").alias("text"))


def matches(marks: DataFrame, definitions: DataFrame, mark_order: str, definition_order: str) -> DataFrame:
    """Markers of a page with their definitions, one to one: the k-th marker of a normalized text with the k-th definition of that text.

    Only equal normalized texts on one page score above a half, so this is what a greedy choice in
    order would pick; it is an equality join on (doc_id, page, text, k).
    """
    key = [*PAGE, "norm"]
    kth = lambda df, order: df.withColumn("norm", normal_marker(F.col("marker"))).withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(order)))
    a = kth(marks, mark_order).select(*key, "k", F.col(mark_order).alias("mark_id"), "marker")
    b = kth(definitions, definition_order).select(*key, "k", F.col(definition_order).alias("definition_id"), F.col("text").alias("definition_text"))
    return a.join(b, [*key, "k"]).select(*PAGE, "mark_id", "marker", "definition_id", "definition_text", F.lit(0.95).alias("confidence"))


def completeness(marks: DataFrame, definitions: DataFrame, matched: DataFrame) -> DataFrame:
    """Per document: numbers of markers, definitions and matches, the match rate (100 without markers), the status and unmatched marker texts."""
    n = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    missing = marks.select("doc_id", "marker").distinct().join(matched.select("doc_id", "marker"), ["doc_id", "marker"], "left_anti")
    lists = missing.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("marker")), " ").alias("unmatched"))
    joined = n(marks, "n_markers").join(n(definitions, "n_definitions"), "doc_id", "full").join(n(matched, "n_matches"), "doc_id", "left").join(lists, "doc_id", "left")
    filled = joined.na.fill(0, ["n_markers", "n_definitions", "n_matches"]).na.fill("", ["unmatched"])
    rate = F.when(F.col("n_markers") > 0, 100.0 * F.col("n_matches") / F.col("n_markers")).otherwise(100.0)
    status = F.when(rate == 100, "COMPLETE").when(rate >= 80, "PARTIAL").otherwise("POOR")
    return filled.select("doc_id", "n_markers", "n_definitions", "n_matches", F.round(rate, 6).alias("match_rate"), status.alias("status"), "unmatched")


def appended_notes(texts: DataFrame, definitions: DataFrame) -> DataFrame:
    """Page texts with their definitions under a rule of 40 dashes, in order of y."""
    notes = definitions.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("y", "footnote_id", F.concat_ws(" ", "marker", "text").alias("line")))).alias("_n"))
    block = F.concat(F.lit("\n\n" + "-" * 40 + "\nFOOTNOTES:\n"), F.array_join(F.transform("_n", lambda x: x["line"]), "\n"))
    return texts.join(notes, PAGE, "left").select(*PAGE, F.concat("page_text", F.coalesce(block, F.lit(""))).alias("page_text"))
