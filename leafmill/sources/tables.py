"""Parquet relations, addressed by folder and table name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of `folder`; pruning and pushdown are left to Catalyst."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores where the files of a small table give less than half as many partitions.

    Work on whole texts is bound by the CPU, and a table of one row group is one task. A
    large table has partitions enough and is left as it is, so nothing big is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df
