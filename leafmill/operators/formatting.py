"""Formatted output: page markers, documents, wrapped boxes, and the way back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTH = 60


def centred(text: Column, fill: Column, width: int = WIDTH) -> Column:
    """The text in the middle of a line of `width`, the odd sign behind it."""
    n = F.greatest(F.lit(width) - F.length(text), F.lit(0))
    left = F.floor(n / 2).cast("int")
    return F.concat(F.repeat(fill, left), text, F.repeat(fill, n.cast("int") - left))


def page_marker(page: Column, end: bool = False, fill: str = "-") -> Column:
    """The line that begins or ends a page."""
    return centred(F.concat(F.lit(" PAGE "), page.cast("string"), F.lit(" END " if end else " START ")), F.lit(fill))


def marked_page(page: Column, text: Column) -> Column:
    """A page between its markers."""
    return F.concat_ws("\n", page_marker(page), F.coalesce(text, F.lit("")), page_marker(page, end=True))


def document_header(name: Column, pages: Column, words: Column) -> Column:
    """The head of a formatted document."""
    return F.concat_ws("\n", F.lit("=" * WIDTH), F.concat(F.lit("[DOCUMENT FILENAME: "), F.coalesce(name, F.lit("")), F.lit("]")), F.concat(F.lit("Pages: "), F.format_number(F.coalesce(pages, F.lit(0)), 0)), F.concat(F.lit("Words: "), F.format_number(F.coalesce(words, F.lit(0)), 0)), F.lit("=" * WIDTH))


def document_footer(pages: Column, words: Column, chars: Column, seconds: Column) -> Column:
    """The statistics that end a formatted document; a line for each that is known."""
    rule = F.lit("=" * WIDTH)
    count = lambda name, c: F.concat(F.lit(f"{name}: "), F.format_number(c, 0))
    return F.concat_ws("\n", F.lit(""), rule, F.lit("EXTRACTION STATISTICS"), rule, F.concat(F.lit("Total Pages: "), pages.cast("string")), count("Total Words", words), count("Total Characters", chars), F.concat(F.lit("Extraction Time: "), F.format_string("%.2fs", seconds.cast("double"))), rule)


def formatted_table(rows: Column, title: Column) -> Column:
    """Cells between bars, a rule as long as the first row under it, the title above; empty for no rows."""
    lines = F.transform(rows, lambda r: F.array_join(r, " | "))
    ruled = F.concat(F.slice(lines, 1, 1), F.array(F.repeat(F.lit("-"), F.length(lines[0]))), F.slice(lines, F.lit(2), F.size(lines)))
    head = F.when(title.isNotNull(), F.array(F.concat(F.lit("\n[TABLE: "), title, F.lit("]")))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(head, ruled, F.array(F.lit("[TABLE END]\n"))), "\n")).otherwise("")


def notes_block(notes: Column) -> Column:
    """The footnotes of a document (structs of marker and text, in order) as a section; empty for none."""
    rule = "=" * 40
    lines = F.transform(notes, lambda n: F.concat(F.coalesce(n["marker"], F.lit("")), F.lit(": "), F.coalesce(n["text"], F.lit(""))))
    return F.when(F.size(notes) > 0, F.array_join(F.concat(F.array(F.lit(f"\n{rule}"), F.lit("FOOTNOTES:"), F.lit(rule)), lines), "\n")).otherwise("")


# Marks of doubtful places.
QUALITY_MARKS = {"illegible": "[ILLEGIBLE]", "uncertain": "[UNCERTAIN]", "missing": "[MISSING]", "corrected": "[CORRECTED]"}


def with_quality_mark(text: Column, kind: str, position: Column | None = None) -> Column:
    """The text with a mark of a known kind at a position (from 0), else behind it; unknown kinds change nothing."""
    if kind not in QUALITY_MARKS:
        return text
    mark = F.lit(QUALITY_MARKS[kind])
    behind = F.concat(text, F.lit(" "), mark)
    if position is None:
        return behind
    return F.when(position.isNull(), behind).otherwise(F.concat(F.substring(text, F.lit(1), position), mark, F.substring(text, position + 1, F.length(text))))


def flags_section(flags: Column) -> Column:
    """Open flags (structs of severity, page and message, in order) as the section that ends a formatted text; empty for none."""
    rule = "=" * WIDTH
    lines = F.transform(flags, lambda f: F.concat(F.lit("\n["), F.upper(f["severity"]), F.lit("] Page "), F.coalesce(f["page"].cast("string"), F.lit("None")), F.lit(": "), F.coalesce(f["message"], F.lit(""))))
    return F.when(F.size(flags) > 0, F.concat(F.lit(f"\n\n{rule}\nREVIEW FLAGS\n{rule}\n"), F.array_join(lines, ""))).otherwise("")


def percent(share: Column, places: int = 1) -> Column:
    """A share as percent with a fixed number of decimals."""
    return F.concat(F.format_number(100 * share, places), F.lit("%"))


def byte_size(n: Column) -> Column:
    """A number of bytes in the largest unit that it has one of, with one decimal."""
    units = [("GB", 1 << 30), ("MB", 1 << 20), ("KB", 1 << 10)]
    made = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for name, size in reversed(units):
        made = F.when(n >= size, F.concat(F.format_string("%.1f", n / float(size)), F.lit(f" {name}"))).otherwise(made)
    return made


MARKER = "-+ PAGE [0-9]+ (?:START|END) -+"


def pages_of(formatted: Column) -> Column:
    """The page texts of a formatted document, whole marker lines taken away."""
    found = F.regexp_extract_all(formatted, F.lit("(?s)-+ PAGE [0-9]+ START -+\n(.*?)\n-+ PAGE [0-9]+ END -+"), F.lit(1))
    return found


def without_markers(formatted: Column) -> Column:
    """A formatted text without its marker lines."""
    return F.trim(F.regexp_replace(formatted, f"(?m)^{MARKER}\n?", ""), F.lit(" \n"))


def marker_counts(formatted: Column) -> tuple[Column, Column]:
    """Numbers of begin and of end markers."""
    count = lambda p: F.size(F.regexp_extract_all(formatted, F.lit(p), F.lit(0)))
    return count("-+ PAGE [0-9]+ START -+"), count("-+ PAGE [0-9]+ END -+")


def wrapped(text: Column, width: int = 56) -> Column:
    """Lines of whole words of at most `width`, filled greedily; a longer word has its own line."""
    words = F.filter(F.split(text, "[ \\t\\n]+"), lambda w: w != "")
    start = F.array().cast("array<string>")

    def step(acc: Column, w: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = (F.size(acc) > 0) & (F.length(last) + 1 + F.length(w) <= width)
        return F.when(fits, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, F.lit(" "), w)))).otherwise(F.concat(acc, F.array(w)))

    return F.aggregate(words, start, step)


def boxed(kind: Column, text: Column) -> Column:
    """A box of a kind around wrapped text."""
    lines = F.transform(wrapped(text), lambda line: F.concat(F.lit("| "), F.rpad(line, 56, " "), F.lit(" |")))
    return F.concat_ws("\n", F.concat(F.lit("["), F.upper(kind), F.lit(" BOX]")), F.array_join(lines, "\n"), F.concat(F.lit("[END "), F.upper(kind), F.lit(" BOX]")))


def eta(seconds: Column) -> Column:
    """A duration in whole seconds, minutes or hours."""
    n = F.when(seconds < 60, seconds).when(seconds < 3600, seconds / 60).otherwise(seconds / 3600)
    unit = F.when(seconds < 60, "s").when(seconds < 3600, "m").otherwise("h")
    return F.concat(F.floor(n).cast("string"), unit)


# The texts of a request to an external corrector.
PROMPT = "Correct the marked text if it is an extraction error. Reply with JSON {\"corrected\": ..., \"confidence\": ...}.\nType: %s\nText: %s[[%s]]%s"


def correction_prompt(issue_type: Column, before: Column, original: Column, after: Column) -> Column:
    """The request for one issue."""
    return F.format_string(PROMPT, issue_type, before, original, after)


def parsed_reply(reply: Column, original: Column) -> Column:
    """struct<corrected, confidence> from the first flat JSON object of a reply; the original at .5 where there is none."""
    # A reply's first flat object; quotes inside its texts are escaped by who wrote it.
    made = F.from_json(F.regexp_extract(F.coalesce(reply, F.lit("")), "\\{[^{}]*\\}", 0), "corrected string, confidence double")
    return F.struct(F.coalesce(made["corrected"], original).alias("corrected"), F.coalesce(made["confidence"], F.lit(0.5)).alias("confidence"))
