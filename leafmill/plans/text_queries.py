"""Queries over whole texts and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import textops as X
from leafmill.sources.tables import read_table, spread

DOC = ["doc_id"]


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(read_table(spark, d, "documents"))


def doc_stats(spark: SparkSession, d: str) -> DataFrame:
    return X.text_stats(documents(spark, d), DOC, "text")


def stats_by_language(spark: SparkSession, d: str) -> DataFrame:
    """Rolled up by language and source, with their totals."""
    stats = X.text_stats(documents(spark, d), ["doc_id", "lang", "source"], "text")
    return stats.rollup("lang", "source").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.sum("n_words").alias("n_words"), F.grouping_id().cast("long").alias("level"))


def cleanup_text(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", X.cleanup(F.col("text")).alias("clean_text"))


def join_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = documents(spark, d).where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return X.join_lines(lines, DOC, "line_no", "line")


def encoding_errors(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).where("text IS NOT NULL").select("doc_id", X.encoding_errors(F.col("text")).alias("n_errors"), X.has_encoding_issues(F.col("text")).alias("has_issues"))


def encoding_fixed(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).where("text IS NOT NULL").select("doc_id", F.length(X.drop_encoding_errors(F.col("text"))).alias("n_chars"), F.md5(X.drop_encoding_errors(F.col("text"))).alias("digest"))


def issues(spark: SparkSession, d: str) -> DataFrame:
    found = X.issue_spans(documents(spark, d), DOC, "text")
    return found.withColumn("confidence", X.issue_confidence(F.col("issue_type"), F.col("original_text")))


def issue_scan(spark: SparkSession, d: str) -> DataFrame:
    return issues(spark, d).select("doc_id", "issue_type", "position", "original_text", "confidence", X.issue_priority(F.col("issue_type"), F.col("confidence")).alias("priority"))


def issue_counts(spark: SparkSession, d: str) -> DataFrame:
    return issues(spark, d).groupBy("issue_type").agg(F.count("*").alias("n_issues"), F.countDistinct("doc_id").alias("n_docs"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def issue_scan_unbounded(spark: SparkSession, d: str) -> DataFrame:
    """As issue_scan, of the patterns that have no word boundaries."""
    return issue_scan(spark, d).where(F.col("issue_type").isin([name for name, p in X.ISSUE_PATTERNS if "(?" not in p]))


def issue_context(spark: SparkSession, d: str) -> DataFrame:
    """The surroundings of the issues of patterns without word boundaries."""
    return issues(spark, d).where(F.col("issue_type").isin([name for name, p in X.ISSUE_PATTERNS if "(?" not in p])).select("doc_id", "issue_type", "position", "context_before", "context_after")


def resolved(spark: SparkSession, d: str) -> DataFrame:
    kept = X.resolve_overlaps(issues(spark, d), DOC)
    return kept.withColumn("corrected", X.correction(F.col("issue_type"), F.col("original_text")))


def issue_resolved(spark: SparkSession, d: str) -> DataFrame:
    return resolved(spark, d).select("doc_id", "position", "issue_type", "original_text", "confidence")


def mock_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Distinct issues are corrected once and joined back."""
    return issues(spark, d).select("issue_type", "original_text").distinct().withColumn("corrected", X.correction(F.col("issue_type"), F.col("original_text")))


def corrected_texts(spark: SparkSession, d: str) -> DataFrame:
    return X.apply_corrections(documents(spark, d).select("doc_id", "text"), resolved(spark, d), DOC, "text")


def verification_report(spark: SparkSession, d: str) -> DataFrame:
    """Issues, changed corrections and those applied, of all documents."""
    r = resolved(spark, d)
    changed = F.col("corrected") != F.col("original_text")
    return r.agg(F.count("*").alias("total_issues"), F.count_if(changed).alias("total_changed"), F.count_if(changed & (F.col("confidence") >= 0.7)).alias("total_applied"), F.round(F.coalesce(F.avg("confidence"), F.lit(1.0)), 6).alias("average_confidence"))


def enhanced(spark: SparkSession, d: str) -> DataFrame:
    return X.enhanced_issues(documents(spark, d), DOC, "text")


def issue_scan_enhanced(spark: SparkSession, d: str) -> DataFrame:
    """The longer scan by type, with the priorities in which its issues are looked at."""
    found = enhanced(spark, d).withColumn("priority", X.issue_priority(F.col("issue_type"), F.col("confidence")))
    return found.groupBy("issue_type", "priority").agg(F.count("*").alias("n_issues"), F.countDistinct("doc_id").alias("n_docs"), F.sum(F.length("original_text")).alias("n_chars"))


def issue_enhanced_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Of the longer scan's overlapping issues the surest."""
    kept = X.resolve_overlaps(enhanced(spark, d), DOC, surest_first=True)
    return kept.select("doc_id", "position", "issue_type", "original_text", "confidence")


def fallback_corrections(spark: SparkSession, d: str) -> DataFrame:
    """What the stand-in corrector makes of each distinct issue."""
    distinct = issues(spark, d).select("original_text").distinct()
    return distinct.withColumn("_c", X.fallback_correction(F.col("original_text"))).select("original_text", "_c.corrected", "_c.confidence")


def hallucination_scan(spark: SparkSession, d: str) -> DataFrame:
    return X.invented_passages(documents(spark, d), DOC, "text")


def hallucination_removed(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", X.without_invented(F.col("text")).alias("text"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    found = X.quality_dimensions(documents(spark, d), "text", "page_count")
    return found.withColumn("overall", X.quality_overall())


def quality_text(spark: SparkSession, d: str) -> DataFrame:
    """The texts of the corpus, for which there are no reports."""
    return quality_columns(scored(spark, d))


def quality_columns(s: DataFrame) -> DataFrame:
    return s.select("doc_id", *X.WEIGHTS, F.round("overall", 6).alias("overall"), X.grade(F.round("overall", 6)).alias("grade"), F.round(X.quality_confidence(), 6).alias("confidence"))


def quality_grades(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy(X.grade(F.round("overall", 6)).alias("grade")).agg(F.count("*").alias("n_docs"), F.round(F.avg("overall"), 6).alias("mean_score"))


def quality_low_dimensions(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("doc_id", F.array_join(X.lowest_dimensions(), ",").alias("lowest"), F.size(X.recommendations()).alias("n_recommendations"))


QUERIES = [
    doc_stats, stats_by_language, cleanup_text, join_lines, encoding_errors, encoding_fixed, issue_scan, issue_scan_unbounded, issue_counts, issue_context, issue_resolved, mock_corrections, corrected_texts, verification_report,
    hallucination_scan, hallucination_removed, quality_grades, quality_low_dimensions, quality_text, issue_scan_enhanced, issue_enhanced_resolved, fallback_corrections,
]

JP = "[\\x{3040}-\\x{30FF}\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}]"
BL = "[ \\t\\x{3000}]+"


def words_sql(t: str) -> str:
    trimmed = f"trim(regexp_replace(coalesce({t}, ''), '[ \\t\\r\\n\\f\\x0B\\x{{3000}}]+', ' ', 'g'))"
    return f"CASE WHEN {trimmed} = '' THEN 0 ELSE len(string_split({trimmed}, ' ')) END"


# RE2 has no lookahead: a star before a digit, which may open but not close, is written as chr(1) beforehand.
STARRED = "regexp_replace({t}, '[*]([0-9])', chr(1) || '\\1', 'g')"
INVENTED_SQL = [(kind, "[*\\x{01}][^*\\x{01}]+[*]" if kind == "markdown_italic" else p) for kind, p in X.INVENTED]


def invented_sql(t: str) -> str:
    for kind, p in INVENTED_SQL:
        t = f"replace(regexp_replace({STARRED.format(t=t)}, '{p}', '', 'g'), chr(1), '*')" if kind == "markdown_italic" else f"regexp_replace({t}, '{p}', '', 'g')"
    return f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


def invented_count_sql(kind: str, pattern: str) -> str:
    text = STARRED.format(t="text") if kind == "markdown_italic" else "text"
    return f"SELECT doc_id, '{kind}' AS kind, len(regexp_extract_all({text}, '{pattern}'))::INT AS n_found FROM documents WHERE length(text) > 0"


def cleanup_sql(t: str) -> str:
    for p, to in [(f"({JP}){BL}({JP})", "\\1\\2"), (f"{BL}([）」』】、。，．])", "\\1"), (f"([（「『【]){BL}", "\\1"), (f"({JP})([A-Za-z0-9])", "\\1 \\2"), (f"([A-Za-z0-9])({JP})", "\\1 \\2"), ("。+", "。"), ("、+", "、"), ("\\.{3,}", "…"), ("・{3,}", "…"), ("\\n{4,}", "\n\n\n")]:
        t = f"regexp_replace({t}, '{p}', '{to}', 'g')"
    return f"trim({t})"


WORD_RE = "[\\p{L}\\p{N}_]"
#: Patterns with word boundaries, as consuming groups over texts in which every other character stands twice.
BOUNDED_SQL = {"ocr_ambiguous_il1": "[Il1][Il1]+", "ocr_ambiguous_o0": "[O0][O0]+"}


def found_sql() -> str:
    """The texts of the matches by pattern."""
    parts = []
    for name, p in X.ISSUE_PATTERNS:
        source, pattern, group = "text", p, 0
        if name in BOUNDED_SQL:
            source, pattern, group = "regexp_replace(text, '([^\\p{L}\\p{N}_])', '\\1\\1', 'g')", f"(?:^|[^\\p{{L}}\\p{{N}}_])({BOUNDED_SQL[name]})(?:[^\\p{{L}}\\p{{N}}_]|$)", 1
        elif name == "ocr_rn_as_m":  # what follows is left to the next match by doubling every letter
            source, pattern, group = "regexp_replace(text, '([a-z])', '\\1\\1', 'g')", "rrnn[a-z]", -1
        elif name == "broken_suffix":
            pattern, group = "(" + p.removesuffix("(?![\\p{L}\\p{N}_])") + ")(?:[^\\p{L}\\p{N}_]|$)", 1
        elif name == "broken_prefix":
            pattern, group = "(?:^|[^\\p{L}\\p{N}_])(" + p.removeprefix("(?<![\\p{L}\\p{N}_])") + ")", 1
        made = f"unnest(regexp_extract_all({source}, '{pattern}', {max(group, 0)}))"
        parts.append(f"SELECT doc_id, '{name}' AS issue_type, {'left(' + made + ', 0) || ' + chr(39) + 'rn' + chr(39) if group < 0 else made} AS original_text FROM documents")
    return " UNION ALL ".join(parts)


CONFIDENCE_SQL = "CASE issue_type WHEN 'ocr_digit_in_word' THEN CASE WHEN regexp_matches(original_text, '^[A-Z]+[0-9]+$') THEN 0.3 ELSE 0.85 END WHEN 'ocr_ambiguous_il1' THEN 0.75 WHEN 'broken_suffix' THEN 0.9 WHEN 'broken_prefix' THEN 0.85 ELSE CASE WHEN issue_type LIKE 'format%' THEN 0.8 ELSE 0.7 END END"


def quality_sql(source: str, t: str, p: str = "page_count", coverage: str = "NULL::DOUBLE", match_rate: str = "NULL::DOUBLE", tables: str = "0") -> str:
    text, pages = f"coalesce({t}, '')", f"coalesce({p}, 1)"
    share = f"({words_sql(t)}) / (300.0 * greatest({pages}, 1))"
    many = lambda pattern: f"(CASE WHEN len(regexp_extract_all({text}, '{pattern}')) > 5 THEN 10.0 ELSE 0.0 END)"
    clamp = lambda x: f"greatest(0.0, least(100.0, {x}))::DOUBLE"
    lines = f"list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
    complete = f"coalesce(CASE WHEN {coverage} > 100 THEN 100.0 ELSE {coverage} END, CASE WHEN {share} < 0.5 THEN 50.0 WHEN {share} < 0.7 THEN 70.0 ELSE 90.0 END) - (CASE WHEN regexp_matches(lower({text}), '\\[(?:page [0-9]+ )?extraction error') THEN 10.0 ELSE 0.0 END)"
    structure = f"100.0 - (CASE WHEN contains(lower({text}), 'page') THEN 0.0 ELSE 10.0 END) - (CASE WHEN NOT regexp_matches({text}, '[0-9]+\\.[0-9]+') AND {pages} > 3 THEN 10.0 ELSE 0.0 END) + (CASE WHEN coalesce({tables}, 0) = 0 AND {pages} > 5 THEN -5.0 WHEN contains({text}, '[TABLE') THEN 5.0 ELSE 0.0 END) - (CASE WHEN regexp_matches({text}, '\\n{{5,}}') THEN 5.0 ELSE 0.0 END)"
    accuracy = f"100.0 - {many('[a-z][0-9][a-z]')} - {many(chr(92) + '?' + chr(92) + '?' + chr(92) + '?+')} - {many('□+')} - least(20.0, len(regexp_extract_all({text}, '\\x{{FFFD}}')))"
    blocks = f"regexp_extract_all({text}, '(?s).{{100}}')"
    whole = f"{blocks}[1:greatest(0, len({blocks}) - (length({text}) % 100 = 0)::INT)]"
    readable = f"100.0 - (CASE WHEN n > 0 AND total / n < 20 THEN 10.0 ELSE 0.0 END) - (CASE WHEN n > 0 AND long > 0.1 * n THEN 5.0 ELSE 0.0 END) - (CASE WHEN len({whole}) > 0 AND len(list_distinct({whole})) * 2 < len({whole}) THEN 15.0 ELSE 0.0 END) + (CASE WHEN contains({text}, '[DOCUMENT FILENAME:') THEN 5.0 ELSE 0.0 END)"
    inner = f"SELECT *, {lines} AS ls FROM {source}"
    counted = f"SELECT *, len(ls) AS n, coalesce(list_sum(list_transform(ls, lambda x: length(x))), 0)::DOUBLE AS total, len(list_filter(ls, lambda x: length(x) > 200)) AS long FROM ({inner})"
    dims = f"SELECT *, {clamp(complete)} AS completeness, {clamp(structure)} AS structure, {clamp(accuracy)} AS accuracy, {clamp(f'coalesce({match_rate}, 80.0)')} AS footnotes, {clamp(readable)} AS readability FROM ({counted})"
    return f"SELECT *, completeness * 0.30::DOUBLE + structure * 0.25::DOUBLE + accuracy * 0.20::DOUBLE + footnotes * 0.15::DOUBLE + readability * 0.10::DOUBLE AS overall FROM ({dims})"


QUALITY_COLUMNS = "doc_id, completeness, structure, accuracy, footnotes, readability, round(overall, 6) AS overall, {grade} AS grade, round(greatest(0.3, least(1.0, 1 - least(0.5, list_var_pop([completeness, structure, accuracy, footnotes, readability]) / 1000))), 6) AS confidence"
GRADE_SQL = "CASE WHEN round(overall, 6) >= 90 THEN 'Excellent' WHEN round(overall, 6) >= 80 THEN 'Good' WHEN round(overall, 6) >= 70 THEN 'Fair' WHEN round(overall, 6) >= 60 THEN 'Poor' ELSE 'Failed' END"
LOWEST_SQL = "list_sort([{'s': completeness, 'n': 'completeness'}, {'s': structure, 'n': 'structure'}, {'s': accuracy, 'n': 'accuracy'}, {'s': footnotes, 'n': 'footnotes'}, {'s': readability, 'n': 'readability'}])[1:2]"
ENDS_JOIN = "NOT regexp_matches(line, '[。！？」』】）：；;]$') AND NOT regexp_matches(after, '^(?:[・•●○■□◆◇※*-]|[0-9]+[.)、．）]|第?[0-9一二三四五六七八九十]+[章条項節])') AND regexp_matches(line, '[はがをにでとのへからもや、，]$')"

ORACLES = {
    "doc_stats": f"SELECT doc_id, length(coalesce(text, ''))::INT AS n_chars, ({words_sql('text')})::INT AS n_words, len(string_split(coalesce(text, ''), chr(10)))::INT AS n_lines FROM documents",
    "stats_by_language": f"SELECT lang, source, count(*) AS n_docs, sum(length(coalesce(text, '')))::BIGINT AS n_chars, sum({words_sql('text')})::BIGINT AS n_words, grouping(lang, source)::BIGINT AS level FROM documents GROUP BY ROLLUP (lang, source)",
    "cleanup_text": f"SELECT doc_id, {cleanup_sql('text')} AS clean_text FROM documents",
    "join_lines": f"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL),
        f AS (SELECT *, coalesce({ENDS_JOIN}, false) AS joins FROM (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS after FROM l)),
        s AS (SELECT doc_id, line_no, line, after, joins, false AS taken FROM f WHERE line_no = 0
            UNION ALL SELECT f.doc_id, f.line_no, f.line, f.after, f.joins, s.joins AND NOT s.taken FROM s JOIN f ON f.doc_id = s.doc_id AND f.line_no = s.line_no + 1)
        SELECT doc_id, line_no::INT AS line_no, CASE WHEN joins THEN line || after ELSE line END AS line FROM s WHERE NOT taken""",
    "encoding_errors": "WITH e AS (SELECT doc_id, text, len(regexp_extract_all(text, '\\x{FFFD}|\\x00|\\\\x[0-9a-f]{2}|\\\\u[0-9a-f]{4}')) AS n_errors FROM documents WHERE text IS NOT NULL) SELECT doc_id, n_errors::INT AS n_errors, n_errors > 0.05 * length(text) AS has_issues FROM e",
    "issue_counts": f"WITH i AS ({found_sql()}) SELECT issue_type, count(*) AS n_issues, count(DISTINCT doc_id) AS n_docs, round(avg({CONFIDENCE_SQL}), 6) AS mean_confidence FROM i GROUP BY issue_type",
    "mock_corrections": f"""WITH i AS (SELECT DISTINCT issue_type, original_text FROM ({found_sql()}))
        SELECT issue_type, original_text, CASE WHEN issue_type = 'ocr_digit_in_word' THEN list_reduce(list_transform(range(1, length(original_text) + 1), lambda k: CASE WHEN k > 1 AND regexp_matches(original_text[k - 1], '[a-z]') AND regexp_matches(original_text[k + 1], '[a-z]') AND original_text[k] IN ('0', '1', '5') THEN translate(original_text[k], '015', 'ois') ELSE original_text[k] END), lambda a, b: a || b)
            WHEN issue_type IN ('broken_suffix', 'broken_prefix') THEN regexp_replace(original_text, '[\\s\\p{{Z}}]+', '', 'g') WHEN issue_type = 'format_excess_spaces' THEN '  ' ELSE original_text END AS corrected FROM i""",
    "hallucination_scan": f"WITH k AS ({' UNION ALL '.join(invented_count_sql(*p) for p in INVENTED_SQL)}) SELECT * FROM k WHERE n_found > 0",
    "hallucination_removed": f"SELECT doc_id, {invented_sql('text')} AS text FROM documents",
    "quality_text": f"SELECT {QUALITY_COLUMNS.format(grade=GRADE_SQL)} FROM ({quality_sql('documents', 'text')})",
    "quality_grades": f"SELECT {GRADE_SQL} AS grade, count(*) AS n_docs, round(avg(overall), 6) AS mean_score FROM ({quality_sql('documents', 'text')}) GROUP BY ALL",
    "quality_low_dimensions": f"SELECT doc_id, array_to_string(list_transform({LOWEST_SQL}, lambda x: x.n), ',') AS lowest, len(list_filter({LOWEST_SQL}, lambda x: x.s < 70))::INT AS n_recommendations FROM ({quality_sql('documents', 'text')})",
}
# Positions, as the running lengths of what stands between the matches of patterns without word boundaries.
POSITIONED = [(k, name, p) for k, (name, p) in enumerate(X.ISSUE_PATTERNS) if "(?" not in p]


def positions_sql() -> str:
    parts = [f"SELECT doc_id, text, '{name}' AS issue_type, {k} AS pattern_no, regexp_extract_all(text, '{p}') AS m, list_transform(string_split_regex(text, '{p}'), lambda x: length(x)) AS b FROM documents WHERE length(text) > 0" for k, name, p in POSITIONED]
    return f"""SELECT doc_id, text, issue_type, pattern_no, m[k] AS original_text, (list_sum(b[1:k]) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0))::INT AS position
        FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM ({' UNION ALL '.join(parts)}) WHERE len(m) > 0)"""


ORACLES["issue_scan_unbounded"] = f"WITH i AS ({positions_sql()}), c AS (SELECT *, {CONFIDENCE_SQL}::DOUBLE AS confidence FROM i) SELECT doc_id, issue_type, position, original_text, confidence, ((CASE WHEN contains(issue_type, 'digit_in_word') THEN 2 WHEN contains(issue_type, 'excess_space') THEN 3 ELSE 5 END) - floor(2 * confidence))::INT AS priority FROM c"
ORACLES["issue_context"] = f"SELECT doc_id, issue_type, position, substr(text, greatest(0, position - 100) + 1, position - greatest(0, position - 100)) AS context_before, substr(text, position + length(original_text) + 1, 100) AS context_after FROM ({positions_sql()})"
ORACLES["encoding_fixed"] = """WITH t AS (SELECT doc_id, regexp_replace(text, '[\\x{FFFD}\\x00]', '', 'g') AS t FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, string_split(regexp_replace(t, '\\\\x([0-9a-f]{2})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS p FROM t),
    d AS (SELECT doc_id, array_to_string(list_transform(p, lambda x: CASE WHEN contains(x, chr(2)) THEN chr(('0x' || substr(x, 1, 2))::INT) || substr(x, 4) ELSE x END), '') AS t FROM s) SELECT doc_id, length(t)::INT AS n_chars, md5(t) AS digest FROM d"""
