"""How many rows of a table hold the same text, so that copies can weigh once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.checkpoints import cut_lineage

#: Hashes of repeated texts up to which they are broadcast; beyond, those of most copies are, and the others are shuffled.
BROADCAST_ROWS = 500_000

#: Bytes of texts up to which a table is broadcast.
BROADCAST_BYTES = 64 << 20


def small_side(df: DataFrame, text_columns: list[str], rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """`df`, to be broadcast in a join if it has `rows` rows and `size` bytes of text at most, else as it is. It should be a written table."""
    held = df.agg(F.count("*").alias("n"), *(F.sum(F.octet_length(c)).alias(f"b{k}") for k, c in enumerate(text_columns))).first()
    return F.broadcast(df) if held[0] <= rows and sum(b or 0 for b in held[1:]) <= size else df


def with_copies(df: DataFrame, text: str, at_once: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with _copies, the number of rows of a text that stands in several, null for others.

    Texts are compared by 64-bit hashes, which tasks count before they shuffle them. Beyond
    `at_once` repeated texts, what is shuffled holds no hot one: those have been broadcast.
    """
    hashed = df.withColumn("_hash", F.xxhash64(text))
    repeated = cut_lineage(hashed.groupBy("_hash").agg(F.count("*").alias("_copies")).where("_copies > 1"))
    if repeated.count() <= at_once:
        return hashed.join(F.broadcast(repeated), "_hash", "left").drop("_hash")
    most = cut_lineage(repeated.orderBy(F.desc("_copies"), "_hash").limit(at_once))
    first = hashed.join(F.broadcast(most), "_hash", "left")
    others = repeated.join(F.broadcast(most.select("_hash")), "_hash", "left_anti")
    rest = first.where("_copies IS NULL").drop("_copies").join(others, "_hash", "left")
    return first.where("_copies IS NOT NULL").unionByName(rest).drop("_hash")


def one_of_each(df: DataFrame, keys: list[str], at_once: int = BROADCAST_ROWS) -> DataFrame:
    """A row for each value of `keys` (not null). Only rows of keys that stand in several are brought together; all others stay where they are.

    Beyond `at_once` such keys all rows are shuffled.
    """
    repeated = cut_lineage(df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    if repeated.count() > at_once:
        return df.dropDuplicates(keys)
    named = F.broadcast(repeated)
    return df.join(named, keys, "left_anti").unionByName(df.join(named, keys, "left_semi").dropDuplicates(keys))
