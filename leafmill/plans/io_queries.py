"""Queries over report sinks, resumption and event windows, and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.plans.report_queries import ORACLES as REPORT_ORACLES
from leafmill.plans.report_queries import RESULTS, batch_summary, batch_table, results
from leafmill.sources import sinks
from leafmill.sources.decoders import not_yet_done, recovered
from leafmill.sources.tables import read_table
from leafmill.streaming.files import windowed_counts


def report_json(spark: SparkSession, d: str) -> DataFrame:
    return sinks.json_report(results(spark, d))


def report_html(spark: SparkSession, d: str) -> DataFrame:
    return sinks.html_report(batch_table(spark, d))


def report_csv(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the batch report's file."""
    return sinks.csv_report(results(spark, d))


def report_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.key_value_lines(batch_summary(spark, d).select("total_files", "successful", "failed", "best_file"))


def files_left(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the corpus's folders that no extraction has been delivered for, by file name."""
    r = results(spark, d)
    return not_yet_done(r.select(F.col("filename").alias("path")), r.where("success").select(F.col("filename").alias("path")))


def pages_recovered(spark: SparkSession, d: str) -> DataFrame:
    pages = results(spark, d).select("doc_id", F.posexplode("pages").alias("_p", "text")).select("doc_id", (F.col("_p") + 1).alias("page"), "text")
    return recovered(pages, "text").select("doc_id", "page", "recovery_method")


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return windowed_counts(read_table(spark, d, "events"), "ts", "event_type").select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n")


QUERIES = [report_json, report_csv, report_html, report_lines, files_left, pages_recovered, event_windows]

ORACLES = {
    "report_json": f"""WITH {RESULTS}, n AS (SELECT count(*) AS n, count(*) FILTER (success) AS ok, coalesce(list(filename ORDER BY filename) FILTER (NOT success), []) AS bad FROM r)
        SELECT '{{"total":' || n || ',"successful":' || ok || ',"failed":' || (n - ok) || ',"success_rate":"' || format('{{:.1f}}', 100.0 * ok / n) || '%","failure_rate":"' || format('{{:.1f}}', 100.0 * (n - ok) / n) || '%","failed_files":[' || array_to_string(list_transform(bad, lambda x: '"' || x || '"'), ',') || ']}}' AS report FROM n""",
    "report_csv": f"""WITH {RESULTS}, s AS (SELECT *, CASE WHEN isnan(quality_score) THEN 0.0 ELSE coalesce(quality_score, 0.0) END AS q FROM r) SELECT filename, CASE WHEN success THEN 'ok' ELSE 'failed' END AS status, format('{{:.1f}}', round(q, 1)) AS score, coalesce(quality_grade, '') AS grade, format('{{:.1f}}', round(100 * coalesce(confidence, 0.0), 1)) AS confidence,
        coalesce(page_count, 0) AS pages, coalesce(word_count, 0) AS words, coalesce(corrections_made, 0) AS corrections, format('{{:.1f}}', round(coalesce(extraction_time, 0.0), 1)) AS seconds FROM s""",
    "report_html": f"""SELECT '<table>' || chr(10) || string_agg('<tr class="' || css || '"><td>' || replace(replace(filename, '&', '&amp;'), '<', '&lt;') || '</td><td>' || coalesce(score, '-') || '</td><td>' || words || '</td></tr>', chr(10) ORDER BY -coalesce(score::DOUBLE, -1), filename) || chr(10) || '</table>' AS html FROM ({REPORT_ORACLES['batch_table']})""",
    "report_lines": f"""WITH {RESULTS} SELECT unnest(['total_files: ' || count(*), 'successful: ' || count(*) FILTER (success), 'failed: ' || count(*) FILTER (NOT success),
        'best_file: ' || (SELECT filename FROM r WHERE success AND score IS NOT NULL ORDER BY score DESC, filename LIMIT 1)]) AS line FROM r""",
    "files_left": f"WITH {RESULTS} SELECT filename AS path FROM r WHERE filename NOT IN (SELECT filename FROM r WHERE success)",
    "pages_recovered": f"WITH {RESULTS}, rp AS (SELECT doc_id, unnest(pages) AS text, generate_subscripts(pages, 1) AS page FROM r) SELECT doc_id, page::INT AS page, CASE WHEN trim(coalesce(text, ''), ' ') <> '' THEN 'text' ELSE 'none' END AS recovery_method FROM rp",
    "event_windows": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
