"""Text repair, issue scans, consistency checks and quality scores of extracted text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.columns import let, match_starts

U = "(?U)"
WORD_CHAR = "[\\p{L}\\p{N}_]"
JP = "[\\u3040-\\u30FF\\u4E00-\\u9FFF\\u3400-\\u4DBF]"


def n_words(text: Column) -> Column:
    """Number of tokens between blanks; 0 for null and blank texts."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t\\r\\n\\f\\x0B\\u3000]+", " "))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " ")))


def text_stats(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Characters, words and lines of every text; null counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.select(*keys, F.length(t).alias("n_chars"), n_words(t).alias("n_words"), F.size(F.split(t, "\n", -1)).alias("n_lines"))


# ---- cleanup -----------------------------------------------------------------------------


def fix_spacing(text: Column) -> Column:
    """Blanks between Japanese letters and before or behind their brackets go; one blank parts them from Latin letters and digits."""
    for pattern, to in [
        (f"({JP})[ \\t\\u3000]+({JP})", "$1$2"),
        ("[ \\t\\u3000]+([）」』】、。，．])", "$1"),
        ("([（「『【])[ \\t\\u3000]+", "$1"),
        (f"({JP})([A-Za-z0-9])", "$1 $2"),
        (f"([A-Za-z0-9])({JP})", "$1 $2"),
    ]:
        text = F.regexp_replace(text, pattern, to)
    return text


def should_join(line: Column, after: Column) -> Column:
    """Whether a line goes on in the next: it ends with a particle or comma, and the next begins no item or section."""
    ends = line.rlike("[。！？」』】）：；;]$")
    item = after.rlike("^(?:[・•●○■□◆◇※*-]|\\d+[.)、．）]|第?[0-9一二三四五六七八九十]+[章条項節])")
    particle = line.rlike("[はがをにでとのへからもや、，]$")
    return ~ends & ~item & particle


def join_lines(df: DataFrame, keys: list[str], line_no: str, line: str) -> DataFrame:
    """Lines merged pairwise: in a run of lines that go on, every odd one takes the next, which is used up.

    Greedy pairing from the left equals the odd positions of each run, so two windows do it.
    """
    order = Window.partitionBy(*keys).orderBy(line_no)
    after = F.lead(line).over(order)
    joins = df.withColumn("_after", after).withColumn("_joins", F.coalesce(should_join(F.col(line), after), F.lit(False)))
    broke = F.when(F.col("_joins"), 0).otherwise(1)
    run = F.sum(broke).over(order.rowsBetween(Window.unboundedPreceding, 0))
    numbered = joins.withColumn("_run", run)
    in_run = Window.partitionBy(*keys, "_run").orderBy(line_no)
    place = F.sum(F.col("_joins").cast("int")).over(in_run.rowsBetween(Window.unboundedPreceding, 0))
    odd = numbered.withColumn("_head", F.col("_joins") & (F.pmod(place, F.lit(2)) == 1))
    taken = F.coalesce(F.lag("_head").over(order), F.lit(False))
    merged = F.when(F.col("_head"), F.concat(F.col(line), F.col("_after"))).otherwise(F.col(line))
    return odd.withColumn("_taken", taken).where(~F.col("_taken")).select(*keys, F.col(line_no), merged.alias(line))


def fix_punctuation(text: Column) -> Column:
    """Repeated full stops and commas once, dots as an ellipsis."""
    for pattern, to in [("。+", "。"), ("、+", "、"), ("\\.{3,}", "…"), ("・{3,}", "…")]:
        text = F.regexp_replace(text, pattern, to)
    return text


def collapse_blank_lines(text: Column) -> Column:
    """Four line feeds or more as three; blanks at the ends go."""
    return F.trim(F.regexp_replace(text, "\n{4,}", "\n\n\n"))


def cleanup(text: Column, spacing: bool = True, punctuation: bool = True) -> Column:
    """The cleanup in order, each step by its switch (line joining works on rows: join_lines)."""
    text = fix_spacing(text) if spacing else text
    text = fix_punctuation(text) if punctuation else text
    return collapse_blank_lines(text)


# ---- encoding ----------------------------------------------------------------------------


def encoding_errors(text: Column) -> Column:
    """Replacement characters, NULs and printed codes in a text, each once."""
    return F.regexp_count(text, F.lit("\\x{FFFD}|\\x00|\\\\x[0-9a-f]{2}|\\\\u[0-9a-f]{4}"))


def has_encoding_issues(text: Column) -> Column:
    """More than 5 % of the text are encoding errors."""
    return encoding_errors(text) > 0.05 * F.length(text)


def drop_encoding_errors(text: Column) -> Column:
    """The text without replacement characters and NULs, printed bytes as characters."""
    bare = F.regexp_replace(text, "[\\x{FFFD}\\x00]", "")
    parts = F.split(F.regexp_replace(bare, "\\\\x([0-9a-f]{2})", "\u0001$1\u0002"), "\u0001")
    decoded = F.transform(parts, lambda p: F.when(p.contains("\u0002"), F.concat(F.char(F.conv(F.substring(p, 1, 2), 16, 10).cast("int")), F.substring_index(p, "\u0002", -1))).otherwise(p))
    return F.array_join(decoded, "")


# ---- issues ------------------------------------------------------------------------------

# Issue types and patterns (a pattern's whole match is the issue). Word characters and blanks are those of Unicode.
ISSUE_PATTERNS = [
    ("ocr_digit_in_word", "[a-zA-Z]+[0-9]+[a-zA-Z]+"),
    ("ocr_letter_in_number", "[0-9]+[a-zA-Z]+[0-9]+"),
    ("ocr_ambiguous_il1", "(?<![\\p{L}\\p{N}_])[Il1][Il1]+(?![\\p{L}\\p{N}_])"),
    ("ocr_ambiguous_o0", "(?<![\\p{L}\\p{N}_])[O0][O0]+(?![\\p{L}\\p{N}_])"),
    ("ocr_random_caps", "[a-z][A-Z][a-z]"),
    ("ocr_rn_as_m", "rn(?=[a-z])"),
    ("broken_suffix", "[\\p{L}\\p{N}_]+[\\s\\p{Z}]+(?:ing|ed|tion|ment|ness|ly)(?![\\p{L}\\p{N}_])"),
    ("broken_prefix", "(?<![\\p{L}\\p{N}_])(?:un|re|pre|dis)[\\s\\p{Z}]+[\\p{L}\\p{N}_]+"),
    ("broken_hyphenated_break", "[\\p{L}\\p{N}_]+-[\\s\\p{Z}]*\\n[\\s\\p{Z}]*[\\p{L}\\p{N}_]+"),
    ("format_excess_spaces", "[\\s\\p{Z}]{3,}"),
    ("format_duplicate_punct", "[。、]{2,}"),
    ("format_excess_newlines", "\\n{4,}"),
]
# The longer scan's issue types, patterns and confidences before their surroundings count.
ENHANCED_PATTERNS = [
    ("jp_ocr_mixed_kana", "[ァ-ヶ][ぁ-ん][ァ-ヶ]", 0.8),
    ("jp_ocr_mixed_kana", "[ぁ-ん][ァ-ヶ][ぁ-ん]", 0.8),
    ("jp_ocr_long_vowel_confusion", "[ー一][^ー一]", 0.7),
    ("jp_ocr_kuchi_ro_confusion", "[口ロ][^口ロ]", 0.75),
    ("jp_ocr_ni_confusion", "[二ニ][^二ニ]", 0.75),
    ("jp_ocr_chikara_ka_confusion", "[力カ][^力カ]", 0.75),
    ("jp_ocr_kou_e_confusion", "[工エ][^工エ]", 0.75),
    ("jp_ocr_yuu_ta_confusion", "[夕タ][^夕タ]", 0.75),
    ("jp_ocr_fullwidth_number_kanji", "[０-９][一-龯]", 0.7),
    ("jp_ocr_kanji_fullwidth_number", "[一-龯][０-９]", 0.7),
    ("jp_ocr_duplicate_jp_punct", "[。、]{2,}", 0.9),
    ("jp_ocr_duplicate_fw_punct", "[．，]{2,}", 0.9),
    ("en_ocr_digit_in_word", "[a-zA-Z]+[0-9]+[a-zA-Z]+", 0.85),
    ("en_ocr_rn_as_m", "(?<![\\p{L}\\p{N}_])rn(?![\\p{L}\\p{N}_])", 0.8),
    ("en_ocr_cl_as_d", "(?<![\\p{L}\\p{N}_])cl(?![\\p{L}\\p{N}_])", 0.75),
    ("en_ocr_vv_as_w", "(?<![\\p{L}\\p{N}_])vv(?![\\p{L}\\p{N}_])", 0.8),
    ("en_ocr_ambiguous_il1", "[Il1]{3,}", 0.85),
    ("en_ocr_ambiguous_o0", "[O0]{3,}", 0.85),
    ("en_ocr_random_caps", "(?<![\\p{L}\\p{N}_])[a-z][A-Z][a-z]+(?![\\p{L}\\p{N}_])", 0.7),
    ("en_ocr_mixed_caps", "(?<![\\p{L}\\p{N}_])[A-Z]{2,}[a-z][A-Z]+(?![\\p{L}\\p{N}_])", 0.75),
    ("struct_broken_suffix", "[\\p{L}\\p{N}_]+[\\s\\p{Z}]+(?:ing|ed|tion|ment|ness|ly|able|ible)(?![\\p{L}\\p{N}_])", 0.9),
    ("struct_broken_prefix", "(?<![\\p{L}\\p{N}_])(?:un|re|pre|dis|mis|non)[\\s\\p{Z}]+[\\p{L}\\p{N}_]+", 0.9),
    ("struct_hyphen_break", "[\\p{L}\\p{N}_]+-[\\s\\p{Z}]*\\n[\\s\\p{Z}]*[\\p{L}\\p{N}_]+", 0.85),
    ("struct_excess_space", "[\\s\\p{Z}]{3,}", 0.95),
    ("struct_no_space_words", "[a-zA-Z]{15,}", 0.8),
    ("struct_double_jp_punct", "[。、][\\s\\p{Z}]*[。、]", 0.9),
    ("struct_empty_parens", "[（(][\\s\\p{Z}]*[)）]", 0.85),
]


def issue_spans(df: DataFrame, keys: list[str], text: str, patterns: list[tuple[str, str]] = ISSUE_PATTERNS, context: int = 100) -> DataFrame:
    """A row for each match of each pattern: issue_type, pattern_no, position, original_text and the text around it."""
    scans = F.array(*(F.struct(F.lit(name).alias("issue_type"), F.lit(k).alias("pattern_no"), F.lit(p).alias("pattern"), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)).alias("found")) for k, (name, p) in enumerate(patterns)))
    each = df.where(F.length(text) > 0).select(*keys, text, F.explode(F.filter(scans, lambda s: F.size(s["found"]) > 0)).alias("_s"))
    # Only texts that have a match are split.
    starts = match_starts(F.col(text), F.col("_s.pattern"), F.col("_s.found"))
    spots = each.withColumn("_hits", F.arrays_zip(starts.alias("position"), F.col("_s.found").alias("original_text")))
    placed = spots.select(*keys, text, "_s.issue_type", "_s.pattern_no", F.explode("_hits").alias("_h")).select(*keys, text, "issue_type", "pattern_no", "_h.position", "_h.original_text")
    start = F.greatest(F.col("position") - context, F.lit(0))
    return placed.select(
        *keys,
        "issue_type",
        "pattern_no",
        "position",
        "original_text",
        F.substring(F.col(text), start + 1, F.col("position") - start).alias("context_before"),
        F.substring(F.col(text), F.col("position") + F.length("original_text") + 1, F.lit(context)).alias("context_after"),
    )


def enhanced_issues(df: DataFrame, keys: list[str], text: str, least: float = 0.6) -> DataFrame:
    """The longer scan: a confidence by pattern, match and the 50 characters on either side; those of `least` and more."""
    found = issue_spans(df, keys, text, [(name, p) for name, p, _ in ENHANCED_PATTERNS], 150)
    base = F.element_at(F.array(*(F.lit(c) for _, _, c in ENHANCED_PATTERNS)), F.col("pattern_no") + 1)
    around = F.concat(F.substring("context_before", -50, 50), F.col("original_text"), F.substring("context_after", 1, 50))
    n = F.length("original_text")
    sure = base + F.when(around.rlike("[一-龯ぁ-んァ-ヶa-zA-Z]"), 0.05).otherwise(0.0) - F.when(around.rlike(r"[{}\[\]<>=/\\]"), 0.1).otherwise(0.0) - F.when(n < 2, 0.1).otherwise(0.0) + F.when(n > 5, 0.05).otherwise(0.0)
    return found.withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)), 6)).where(F.col("confidence") >= least)


def issue_confidence(issue_type: Column, original: Column) -> Column:
    """The confidence of an issue by its type and text."""
    return (
        F.when(issue_type == "ocr_digit_in_word", F.when(original.rlike("^[A-Z]+[0-9]+$"), 0.3).otherwise(0.85))
        .when(issue_type == "ocr_ambiguous_il1", 0.75)
        .when(issue_type == "broken_suffix", 0.9)
        .when(issue_type == "broken_prefix", 0.85)
        .when(issue_type.startswith("format"), 0.8)
        .otherwise(0.7)
    )


def resolve_overlaps(issues: DataFrame, keys: list[str], surest_first: bool = False) -> DataFrame:
    """Of overlapping issues of a text the surest: by position, an issue that overlaps the kept one takes its place only if it is surer.

    At one position issues come in the order of their patterns, or with `surest_first` the surest first.
    Issues that touch none before them begin a group; only groups, which are short, are folded.
    """
    first = (-F.col("confidence")) if surest_first else F.lit(0.0)
    ranked = issues.withColumn("_first", first)
    order = Window.partitionBy(*keys).orderBy("position", "_first", "pattern_no")
    reach = F.max(F.col("position") + F.length("original_text")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    grouped = ranked.withColumn("_g", F.sum(F.when(F.col("position") < reach, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct("position", "_first", "pattern_no", "issue_type", "original_text", "confidence")
    ordered = grouped.groupBy(*keys, "_g").agg(F.array_sort(F.collect_list(item)).alias("_i"))
    start = F.array().cast("array<struct<position:int,_first:double,pattern_no:int,issue_type:string,original_text:string,confidence:double>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        apart = (F.size(acc) == 0) | (x["position"] >= last["position"] + F.length(last["original_text"]))
        better = x["confidence"] > last["confidence"]
        replaced = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(x))
        return F.when(apart, F.concat(acc, F.array(x))).when(better, replaced).otherwise(acc)

    return ordered.select(*keys, F.explode(F.aggregate("_i", start, step)).alias("_x")).select(*keys, "_x.*").drop("_first")


def correction(issue_type: Column, original: Column) -> Column:
    """What a deterministic corrector makes of an issue; digits between letters become the letters they look like."""
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(original, "(?<=[a-z])1(?=[a-z])", "i"), "(?<=[a-z])0(?=[a-z])", "o"), "(?<=[a-z])5(?=[a-z])", "s")
    return F.when(issue_type == "ocr_digit_in_word", digits).when(issue_type.isin("broken_suffix", "broken_prefix"), F.regexp_replace(original, "[\\s\\p{Z}]+", "")).when(issue_type == "format_excess_spaces", "  ").otherwise(original)


def fallback_correction(original: Column) -> Column:
    """struct<corrected, confidence> of the corrector that stands in for an external one: broken suffixes and prefixes joined, long blanks to one, digits in words to letters."""
    blank, word = "[\\s\\p{Z}]", "(?![\\p{L}\\p{N}_])"
    suffix, prefix = f"{blank}+(ing|ed|tion|ment|ness|ly){word}", f"(?<![\\p{{L}}\\p{{N}}_])(un|re|pre|dis){blank}+"
    made = lambda c, sure: F.struct(c.alias("corrected"), F.lit(sure).alias("confidence"))
    return (
        F.when(original.rlike(suffix), made(F.regexp_replace(original, suffix, "$1"), 0.8))
        .when(original.rlike(prefix), made(F.regexp_replace(original, prefix, "$1"), 0.8))
        .when(original.rlike(f"{blank}{{3,}}"), made(F.regexp_replace(original, f"{blank}{{3,}}", " "), 0.9))
        .when(original.rlike("[a-zA-Z]+[0-9]+[a-zA-Z]+"), made(F.translate(original, "10", "io"), 0.7))
        .otherwise(made(original, 0.5))
    )


def apply_corrections(texts: DataFrame, issues: DataFrame, keys: list[str], text: str, least: float = 0.7) -> DataFrame:
    """The texts with their changed corrections of `least` confidence or more spliced in.

    `issues` must not overlap (resolve_overlaps) and have position, original_text, corrected and confidence.
    The text is joined once from the untouched gaps and the corrections, so no offset shifts.
    """
    used = issues.where((F.col("corrected") != F.col("original_text")) & (F.col("confidence") >= least))
    spliced = used.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", (F.col("position") + F.length("original_text")).alias("end"), "corrected"))).alias("_c"))
    joined = texts.join(spliced, keys, "left")
    before = F.concat(F.array(F.lit(0)), F.transform(F.slice("_c", F.lit(1), F.size("_c") - 1), lambda c: c["end"]))
    parts = F.zip_with("_c", before, lambda c, at: F.concat(F.substring(F.col(text), at + 1, c["position"] - at), c["corrected"]))
    last = F.element_at("_c", -1)["end"]
    whole = F.when(F.size("_c") > 0, F.concat(F.array_join(parts, ""), F.substring(F.col(text), last + 1, F.length(text))))
    return joined.select(*keys, F.coalesce(whole, F.col(text)).alias("corrected_text"), F.coalesce(F.size("_c"), F.lit(0)).alias("n_corrections"))


def issue_priority(issue_type: Column, confidence: Column) -> Column:
    """Priority by kind (broken words before mixed and digits before blanks), less twice the confidence's whole part."""
    base = (
        F.when(issue_type.contains("broken_suffix") | issue_type.contains("broken_prefix"), 1)
        .when(issue_type.contains("mixed_kana") | issue_type.contains("digit_in_word"), 2)
        .when(issue_type.contains("excess_space"), 3)
        .otherwise(5)
    )
    return base - F.floor(2 * confidence).cast("int")


# ---- consistency -------------------------------------------------------------------------

# Kinds and patterns of text that no page holds, by line, in upper and lower case.
INVENTED = [
    ("generated_heading", "(?im)^#{1,6}\\s+(?:目次|概要|はじめに|結論|まとめ)$"),
    ("generated_title", "(?im)^(?:Table of Contents|Summary|Introduction|Conclusion)$"),
    ("markdown_bold", "(?im)\\*\\*[^*]+\\*\\*"),
    ("markdown_underline", "(?im)__[^_]+__"),
    ("markdown_italic", "(?im)\\*[^*]+\\*(?![0-9])"),
    ("markdown_italic_line", "(?im)_[^_]+_"),
    ("html_open", "(?im)<[a-z]+[^>]*>"),
    ("html_close", "(?im)</[a-z]+>"),
    ("explains_itself", "(?im)This (?:section|document|page) (?:describes|contains|shows)"),
    ("points_out", "(?im)(?:As shown|As seen|Note that|Please note)"),
    ("announces", "(?im)(?:The following|Below is|Above is)"),
]


def invented_passages(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Per text the number of passages of each kind that look invented; a row for each kind that occurs."""
    counts = F.array(*(F.struct(F.lit(k).alias("kind"), F.size(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))).alias("n_found")) for k, p in INVENTED))
    return df.where(F.length(text) > 0).select(*keys, F.explode(counts).alias("_c")).select(*keys, "_c.*").where("n_found > 0")


def without_invented(text: Column) -> Column:
    """The text without such passages, one kind after another; three line feeds or more become two."""
    for _, pattern in INVENTED:
        text = F.regexp_replace(text, pattern, "")
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def element_check(expected: Column, extracted: Column) -> tuple[Column, Column]:
    """(ratio capped at 1, verdict) of extracted to expected elements."""
    ratio = F.when(expected > 0, extracted / expected).otherwise(1.0)
    verdict = F.when(ratio < 0.5, "issue").when((ratio < 0.7) | (ratio > 1.5), "warning").otherwise("ok")
    return F.least(ratio, F.lit(1.0)), verdict


# ---- quality -----------------------------------------------------------------------------

WEIGHTS = {"completeness": 0.30, "structure": 0.25, "accuracy": 0.20, "footnotes": 0.15, "readability": 0.10}


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def quality_dimensions(df: DataFrame, text: str, pages: str, coverage: str | None = None, match_rate: str | None = None, tables: str | None = None) -> DataFrame:
    """Adds the five dimensions of quality of a text; null texts count as empty.

    With columns of reports at hand completeness is the `coverage` in percent and footnotes the
    `match_rate` (100 where there are no markers); where they are null or not given, completeness is
    estimated from the words a page and footnotes are neutral. `tables` is the number of tables found.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    p = F.coalesce(F.col(pages), F.lit(1))
    share = n_words(t) / (300.0 * F.greatest(p, F.lit(1)))
    given = F.col(coverage).cast("double") if coverage else F.lit(None).cast("double")
    found = F.coalesce(F.col(tables), F.lit(0)) if tables else F.lit(0)
    guessed = F.when(share < 0.5, 50.0).when(share < 0.7, 70.0).otherwise(90.0)
    complete = F.coalesce(F.when(given > 100, 100.0).otherwise(given), guessed) - F.when(F.lower(t).rlike("\\[(?:page [0-9]+ )?extraction error"), 10.0).otherwise(0.0)
    structure = (
        100.0
        - F.when(F.lower(t).contains("page"), 0.0).otherwise(10.0)
        - F.when(~t.rlike("[0-9]+\\.[0-9]+") & (p > 3), 10.0).otherwise(0.0)
        + F.when((found == 0) & (p > 5), -5.0).when(t.contains("[TABLE"), 5.0).otherwise(0.0)
        - F.when(t.rlike("\n{5,}"), 5.0).otherwise(0.0)
    )
    many = lambda pattern: F.when(F.size(F.regexp_extract_all(t, F.lit(pattern), F.lit(0))) > 5, 10.0).otherwise(0.0)
    accuracy = 100.0 - many("[a-z][0-9][a-z]") - many("\\?\\?\\?+") - many("□+") - F.least(F.lit(20.0), F.size(F.regexp_extract_all(t, F.lit("\\x{FFFD}"), F.lit(0))).cast("double"))
    rate = F.coalesce(F.col(match_rate).cast("double"), F.lit(80.0)) if match_rate else F.lit(80.0)
    lines = F.filter(F.transform(F.split(t, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    n = F.size(lines)
    mean = F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x)) / n
    long = F.size(F.filter(lines, lambda x: F.length(x) > 200))
    # Blocks of 100 characters, the last whole one left out where nothing follows it.
    blocks = F.regexp_extract_all(t, F.lit("(?s).{100}"), F.lit(0))
    blocks = F.slice(blocks, F.lit(1), F.greatest(F.size(blocks) - F.when(F.length(t) % 100 == 0, 1).otherwise(0), F.lit(0)))
    repeated = let(blocks, lambda b: (F.size(b) > 0) & (F.size(F.array_distinct(b)) * 2 < F.size(b)))
    readable = 100.0 - F.when((n > 0) & (mean < 20), 10.0).otherwise(0.0) - F.when((n > 0) & (long > 0.1 * n), 5.0).otherwise(0.0) - F.when(repeated, 15.0).otherwise(0.0) + F.when(t.contains("[DOCUMENT FILENAME:"), 5.0).otherwise(0.0)
    return df.select("*", clamp(complete).alias("completeness"), clamp(structure).alias("structure"), clamp(accuracy).alias("accuracy"), clamp(rate).alias("footnotes"), clamp(readable).alias("readability"))


def quality_overall() -> Column:
    """The weighted sum of the dimensions."""
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + F.col(name) * weight
    return total


def grade(score: Column) -> Column:
    """The grade of a score; null for null and NaN."""
    return F.when(score.isNull() | F.isnan(score), F.lit(None)).when(score >= 90, "Excellent").when(score >= 80, "Good").when(score >= 70, "Fair").when(score >= 60, "Poor").otherwise("Failed")


def quality_confidence() -> Column:
    """1 less the population variance of the dimensions over 1000 (.5 at most), kept within .3 and 1."""
    dims = [F.col(d) for d in WEIGHTS]
    mean = sum(dims[1:], dims[0]) / len(dims)
    variance = sum(((d - mean) * (d - mean) for d in dims[1:]), (dims[0] - mean) * (dims[0] - mean)) / len(dims)
    return F.greatest(F.lit(0.3), F.least(F.lit(1.0), 1 - F.least(F.lit(0.5), variance / 1000)))


def lowest_dimensions(k: int = 2) -> Column:
    """The names of the `k` lowest dimensions, ties in alphabetical order."""
    items = F.array_sort(F.array(*(F.struct(F.col(d).alias("score"), F.lit(d).alias("name")) for d in WEIGHTS)))
    return F.transform(F.slice(items, 1, k), lambda x: x["name"])


def recommendations(k: int = 2) -> Column:
    """One line for each of the lowest dimensions under 70."""
    items = F.array_sort(F.array(*(F.struct(F.col(d).alias("score"), F.lit(d).alias("name")) for d in WEIGHTS)))
    return F.transform(F.filter(F.slice(items, 1, k), lambda x: x["score"] < 70), lambda x: F.concat(F.lit("Improve "), x["name"], F.lit(": "), F.format_number(x["score"], 1)))


def best_variant(variants: DataFrame, keys: list[str]) -> DataFrame:
    """The variant of the highest score; of a tie that of the earliest attempt."""
    others = [c for c in variants.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct("score", (-F.col("attempt")).alias("_a"))).alias("_b")
    return variants.groupBy(*keys).agg(best).select(*keys, "_b.*")


def undefined_markers(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Star markers of each text that stand nowhere as a definition, that is before a colon or blank."""
    found = df.where(F.length(text) > 0).select(*keys, text, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit("\\*[0-9]+"), F.lit(0)))).alias("marker"))
    defined = F.lit(False)
    for sign in (":", "：", " ", "\n", "\t"):
        defined = defined | F.col(text).contains(F.concat("marker", F.lit(sign)))
    return found.where(~defined).select(*keys, "marker")


def position_score(bottom_words: Column, text: Column) -> Column:
    """.8 where a document has words at the bottom but no footnote marker in its text, else 1."""
    return F.when((bottom_words > 0) & ~F.coalesce(text, F.lit("")).rlike("\\*[0-9]+|※[0-9]+|\\[[0-9]+\\]|[†‡]"), 0.8).otherwise(1.0)
