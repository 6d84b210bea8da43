"""The catalogue of queries over the engine's operators and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmill.plans import detail_queries, io_queries, layout_queries, report_queries, text_queries

MODULES = (layout_queries, text_queries, report_queries, io_queries, detail_queries)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's five quality dimensions, weighted score, grade and confidence."""
    return detail_queries.quality_score(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for m in MODULES for q in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
