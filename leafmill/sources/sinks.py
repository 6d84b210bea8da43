"""Sinks: text files per document, CSV, JSON and HTML reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_texts(texts: DataFrame, key: str, text: str, folder: str, files: int = 200) -> None:
    """Texts as `files` files of JSON lines with key and text, a key's rows in the file of its hash: as many texts to a file as need be, so the number of files stays bounded."""
    rows = texts.select(texts[key], F.coalesce(texts[text], F.lit("")).alias("text"))
    rows.repartition(files, key).sortWithinPartitions(key).write.mode("overwrite").option("compression", "none").json(folder)


def write_text_tree(texts: DataFrame, path: str, text: str, folder: str) -> None:
    """Each text as `<stem>.txt` in a tree that mirrors the documents' paths (relative ones), written by the tasks that hold them.

    For moderate numbers of documents, as readers of single files want them; a file is written under another name first, so a task run again leaves no half of one.
    """

    def write(rows) -> None:
        import os
        from pathlib import Path, PurePosixPath

        for row in rows:
            to = Path(folder) / PurePosixPath(row[0].lstrip("/")).with_suffix(".txt")
            if ".." in to.parts:
                raise ValueError(f"a path must stay below the folder: {row[0]}")
            to.parent.mkdir(parents=True, exist_ok=True)
            part = to.with_name(f".{to.name}.{os.getpid()}")
            part.write_text(row[1], encoding="utf-8")
            os.replace(part, to)

    texts.select(texts[path], F.coalesce(texts[text], F.lit(""))).where(texts[path].isNotNull()).foreachPartition(write)


def csv_report(results: DataFrame) -> DataFrame:
    """The nine columns of the batch report, numbers with one decimal, best score first."""
    score = F.when(F.isnan("quality_score"), F.lit(None)).otherwise(F.col("quality_score"))
    one = lambda c: F.coalesce(F.format_string("%.1f", c.cast("double")), F.lit(""))
    return results.select(
        "filename", F.when(F.col("success"), "ok").otherwise("failed").alias("status"), one(F.coalesce(score, F.lit(0.0))).alias("score"), F.coalesce("quality_grade", F.lit("")).alias("grade"), one(100 * F.coalesce("confidence", F.lit(0.0))).alias("confidence"),
        F.coalesce("page_count", F.lit(0)).alias("pages"), F.coalesce("word_count", F.lit(0)).alias("words"), F.coalesce("corrections_made", F.lit(0)).alias("corrections"), one(F.coalesce("extraction_time", F.lit(0.0))).alias("seconds"), F.coalesce(score, F.lit(0.0)).alias("_s"),
    ).orderBy(F.desc("_s"), "filename").drop("_s")


def write_csv_report(rows: DataFrame, folder: str) -> None:
    """A report with a header, in the order of its rows: files are numbered in that order."""
    rows.write.mode("overwrite").option("header", True).csv(folder)


def json_report(results: DataFrame, ok: str = "success") -> DataFrame:
    """One JSON document: totals, rates with one decimal and the failed files in order."""
    n, good = F.count("*"), F.count_if(F.col(ok))
    rate = lambda x: F.when(n > 0, F.concat(F.format_number(100.0 * x / n, 1), F.lit("%"))).otherwise("0.0%")
    failed = F.array_sort(F.collect_list(F.when(~F.col(ok), F.col("filename"))))
    return results.agg(F.struct(n.alias("total"), good.alias("successful"), (n - good).alias("failed"), rate(good).alias("success_rate"), rate(n - good).alias("failure_rate"), failed.alias("failed_files")).alias("r")).select(F.to_json("r").alias("report"))


def html_report(rows: DataFrame) -> DataFrame:
    """One HTML table of a batch table (filename, score, css, words)."""
    cell = F.format_string('<tr class="%s"><td>%s</td><td>%s</td><td>%d</td></tr>', F.col("css"), F.regexp_replace(F.regexp_replace("filename", "&", "&amp;"), "<", "&lt;"), F.coalesce("score", F.lit("-")), F.col("words").cast("long"))
    ordered = rows.select((-F.coalesce(F.col("score").cast("double"), F.lit(-1.0))).alias("s"), "filename", cell.alias("cell"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "filename", "cell"))), lambda x: x["cell"]), "\n")
    return ordered.agg(F.concat(F.lit("<table>\n"), body, F.lit("\n</table>")).alias("html"))


def key_value_lines(row: DataFrame) -> DataFrame:
    """A one-row frame as lines of `name: value`."""
    pairs = F.array(*(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in row.columns))
    return row.select(F.explode(pairs).alias("line"))
