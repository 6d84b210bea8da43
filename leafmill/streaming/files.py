"""File streams: a folder's pages in batches with exactly-once progress, and windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.lineage import cut_lineage


def file_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 50, pattern: str = "*.parquet") -> DataFrame:
    """New parquet files of a folder as a stream, `files_per_batch` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).parquet(folder)


def run_available(stream: DataFrame, checkpoint: str, process: Callable[[DataFrame], DataFrame], target: str) -> int:
    """Runs a stream over what is there: each batch is processed and appended to `target` once; the number of batches.

    The checkpoint holds what is done, so a run that was cut off goes on with the next batch; a batch
    that was cut off itself is written again under its own number, over what it left.
    """
    done = []

    def write(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")
        done.append(number)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(done)


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of a key in tumbling windows, with a watermark that lets events be `late`; works on streams and on tables."""
    kept = events.withWatermark(time, late) if events.isStreaming else events
    return kept.groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), key, "n")


def iterate(state: DataFrame, step: Callable[[DataFrame], tuple[DataFrame, float]], least: float = 0.02, most: int = 3) -> tuple[DataFrame, int]:
    """Repeats a step until its score gains less than `least`, `most` times at the outside; the last state and the number of steps.

    Each step's state is checkpointed, so its plan doesn't grow with the rounds.
    """
    before, rounds = float("-inf"), 0
    while rounds < most:
        state, score = step(state)
        state = cut_lineage(state)
        rounds += 1
        if score - before < least:
            break
        before = score
    return state, rounds
