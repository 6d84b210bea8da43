"""Reports: flags, page errors, batches, verification, consensus, inventories."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import similarity as S

SEVERITIES = ("critical", "high", "medium", "low")


def clean_flags(flags: DataFrame) -> DataFrame:
    """Each flag once; a null resolved counts as open."""
    return flags.dropDuplicates(["flag_id"]).withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def flag_summary(flags: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers of flags, of open ones and by severity (also the resolved)."""
    return flags.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(~F.col("resolved")).alias("unresolved"), *(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))


def open_flags(flags: DataFrame, severity: str | None = None) -> DataFrame:
    """Unresolved flags, of one severity if given."""
    kept = flags.where(~F.col("resolved"))
    return kept if severity is None else kept.where(F.col("severity") == severity)


def first_flags(flags: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """The first `k` flags of each group, by severity and time."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    order = Window.partitionBy(*keys).orderBy(rank, "created_at", "flag_id")
    return flags.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def resolved_flags(flags: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Flags with `resolutions` (flag_id, note) applied: an update by join, as a merge would do it."""
    joined = flags.join(resolutions.select("flag_id", F.col("note").alias("_note"), F.lit(True).alias("_done")), "flag_id", "left")
    return joined.withColumn("resolved", F.coalesce("_done", "resolved")).withColumn("resolution_note", F.coalesce("_note", "resolution_note")).drop("_note", "_done")


def flag_report(flags: DataFrame) -> DataFrame:
    """A line for each open flag and its JSON form, contexts cut at 200."""
    line = F.format_string("[%s] %s p.%s: %s", F.upper("severity"), F.col("flag_type"), F.coalesce(F.col("page").cast("int").cast("string"), F.lit("-")), F.col("message"))
    return open_flags(flags).select("flag_id", line.alias("line"), F.to_json(F.struct("flag_id", "flag_type", "severity", "message", F.substring("context", 1, 200).alias("context"))).alias("json"))


def clean_pages(analysis: DataFrame) -> DataFrame:
    """Each analysed page once; null flags count as false."""
    flags = ["is_rotated", "is_scanned", "has_overlapping_text", "has_encoding_issues"]
    once = analysis.dropDuplicates(["doc_id", "page_number"])
    return once.withColumns({c: F.coalesce(c, F.lit(False)) for c in flags})


def page_errors(pages: DataFrame) -> DataFrame:
    """A row for each error of a page: error_type and severity, from its flags."""
    kinds = [("is_rotated", "rotated_page", "medium"), ("is_scanned", "scanned_page", "high"), ("has_overlapping_text", "overlapping_text", "low"), ("has_encoding_issues", "encoding_error", "medium")]
    found = F.array(*(F.when(F.col(c), F.struct(F.lit(t).alias("error_type"), F.lit(s).alias("severity"))) for c, t, s in kinds))
    return pages.select("doc_id", "page_number", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("_e")).select("doc_id", "page_number", "_e.*")


def error_report(errors: DataFrame) -> DataFrame:
    """Per document: errors by type and severity as maps, pages affected in order."""
    by_type = errors.groupBy("doc_id", "error_type").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("error_type", "n")))).alias("by_type"))
    by_severity = errors.groupBy("doc_id", "severity").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("by_severity"))
    totals = errors.groupBy("doc_id").agg(F.count("*").alias("total_errors"), F.array_sort(F.collect_set(F.when(F.col("page_number") > 0, F.col("page_number")))).alias("pages_affected"))
    return totals.join(by_type, "doc_id").join(by_severity, "doc_id")


# What is recommended for each type of error, in this order.
RECOMMENDATIONS = [
    ("scanned_page", "Consider using OCR for scanned pages"),
    ("rotated_page", "Enable rotation correction for rotated pages"),
    ("encoding_error", "Try different encoding fallbacks (UTF-8, Shift-JIS, EUC-JP)"),
    ("overlapping_text", "Review overlapping text - may need manual cleanup"),
    ("corruption", "PDF may be corrupted - try re-saving or repairing"),
]


def recovery_report(errors: DataFrame, recovered: DataFrame) -> DataFrame:
    """Per document with errors: how many were recovered (their page stands in `recovered`), the share, and what is recommended, a line each.

    A critical or, else, a high severity comes first among the recommendations.
    """
    pages = recovered.select("doc_id", F.col("page").alias("page_number"), F.lit(True).alias("_ok")).distinct()
    joined = errors.join(pages, ["doc_id", "page_number"], "left")
    has = lambda c, v: F.max(F.when(F.col(c) == v, 1).otherwise(0)) > 0
    lines = [F.when(has("error_type", kind), text) for kind, text in RECOMMENDATIONS]
    urgent = F.when(has("severity", "critical"), "Critical errors found - manual intervention required").when(has("severity", "high"), "Some pages may have incomplete extraction")
    advice = F.filter(F.array(urgent, *lines), lambda x: x.isNotNull())
    n, ok = F.count("*"), F.count_if("_ok")
    return joined.groupBy("doc_id").agg(n.alias("total_errors"), ok.alias("recovered"), F.round(ok / n, 2).alias("recovery_rate"), F.array_join(F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit("No significant issues found"))), "\n").alias("recommendations"))


def clean_results(results: DataFrame) -> DataFrame:
    """Each document's delivery that was loaded last, and `success`: it has text."""
    newest = Window.partitionBy("doc_id").orderBy(F.desc("loaded_at"), "filename")
    once = results.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")
    return once.withColumn("success", F.col("raw_text").isNotNull())


def sound_score(score: Column) -> Column:
    """A score within 0 and 100; null and NaN stay null."""
    return F.when(score.isNull() | F.isnan(score), F.lit(None)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))


def batch_summary(results: DataFrame) -> DataFrame:
    """Totals of a batch, the mean score of its successes, best and worst file (the first by name on a tie)."""
    score = sound_score(F.col("quality_score"))
    ok = F.col("success") & score.isNotNull()
    return results.agg(
        F.count("*").alias("total_files"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
        F.coalesce(F.sum("page_count"), F.lit(0)).alias("total_pages"),
        F.coalesce(F.sum("word_count"), F.lit(0)).alias("total_words"),
        F.coalesce(F.sum(F.when(ok, score.cast("decimal(18,6)"))).cast("double") / F.nullif(F.count_if(ok), F.lit(0)), F.lit(0.0)).alias("mean_quality"),
        F.min(F.when(ok, F.struct((-score).alias("s"), "filename")))["filename"].alias("best_file"),
        F.min(F.when(ok, F.struct(score.alias("s"), "filename")))["filename"].alias("worst_file"),
    )


def batch_issues(results: DataFrame, coverage: str | None = None) -> DataFrame:
    """At most one issue a file: failed, else low quality, else a coverage under 80 percent (where it is known), else low confidence."""
    score = sound_score(F.col("quality_score"))
    covered = F.col(coverage) if coverage else F.lit(None).cast("double")
    kind = F.when(~F.col("success"), "failed").when(score < 60, "low_quality").when(covered < 80, "low_coverage").when(F.col("confidence") < 0.5, "low_confidence")
    severity = F.when(kind.startswith("low_co"), "medium").otherwise("high")
    return results.select("doc_id", "filename", kind.alias("issue"), F.when(kind.isNotNull(), severity).alias("severity")).where("issue IS NOT NULL")


def batch_table(results: DataFrame) -> DataFrame:
    """The rows of a report, best first: place, file, score with one decimal, css class."""
    score = sound_score(F.col("quality_score"))
    css = F.when(score >= 80, "good").when(score >= 60, "ok").otherwise("bad")
    rows = results.select("filename", score.alias("_s"), F.format_number(score, 1).alias("score"), css.alias("css"), F.coalesce("word_count", F.lit(0)).alias("words"))
    return rows.orderBy(F.desc_nulls_last("_s"), "filename").drop("_s")


def consensus_pairs(engines: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of engines' texts of a document with their exact sequence similarity.

    The similarity (twice the matched over the total length, as the standard library gives it) has no SQL form.
    """
    a, b = engines.alias("a"), engines.alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    pairs = a.join(b, same & (F.col("a.engine") < F.col("b.engine"))).select(*(F.col(f"a.{k}").alias(k) for k in keys), F.col("a.engine").alias("engine_a"), F.col("b.engine").alias("engine_b"), F.col("a.text").alias("text_a"), F.col("b.text").alias("text_b"))

    @F.pandas_udf("double")
    def ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series([S.ratio(x or "", y or "") for x, y in zip(left, right)])

    return pairs.select(*keys, "engine_a", "engine_b", ratio("text_a", "text_b").alias("similarity"))


def consensus(pairs: DataFrame, engines: DataFrame, keys: list[str]) -> DataFrame:
    """Per document the mean similarity and the engine with the longest text, the first by name on a tie."""
    mean = pairs.groupBy(*keys).agg(F.avg("similarity").alias("consensus_score"))
    base = engines.groupBy(*keys).agg(F.min(F.struct((-F.length(F.coalesce("text", F.lit("")))).alias("_n"), "engine"))["engine"].alias("base_engine"))
    return base.join(mean, keys, "left").na.fill(1.0, ["consensus_score"])


def consensus_at_once(engines: DataFrame, keys: list[str]) -> DataFrame:
    """As `consensus` of all `consensus_pairs`, of texts that are brought together once.

    They are grouped by a struct of the keys, for which Spark always exchanges: it takes a union of tables that are split by
    the keys as split too, and joins of two such can fail ("Can't zip RDDs with unequal numbers of partitions"). Rows
    without a key have no pairs.
    """
    one = F.struct("engine", F.coalesce("text", F.lit("")).alias("text"))
    e = engines.groupBy(F.struct(*keys).alias("_k")).agg(F.array_sort(F.collect_list(one)).alias("_e")).select("_k.*", "_e")
    base = F.array_min(F.transform("_e", lambda x: F.struct((-F.length(x["text"])).alias("_n"), x["engine"].alias("engine"))))["engine"]

    @F.pandas_udf("double")
    def mean(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for names, texts in batches:
            pairs = ([S.ratio(a, b) for (x, a), (y, b) in combinations(zip(n, t), 2) if x is not None and x != y] for n, t in zip(names, texts))
            yield pd.Series([sum(p) / len(p) if p else 1.0 for p in pairs], dtype="float64")

    known = reduce(Column.__and__, (F.col(k).isNotNull() for k in keys))
    score = F.when(known, mean(F.col("_e")["engine"], F.col("_e")["text"])).otherwise(1.0)
    return e.select(*keys, base.alias("base_engine"), score.alias("consensus_score"))


def extraction_confidence(quality: Column, coverage: Column, match_rate: Column) -> Column:
    """Half the quality, .3 of the coverage, .2 of the match rate, each in percent."""
    return 0.5 * quality / 100 + 0.3 * coverage / 100 + 0.2 * match_rate / 100
