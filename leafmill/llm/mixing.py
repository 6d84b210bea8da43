"""Sources mixed to target shares by weighted pivotal rounding along a reduction tree.

A source's records get the same real number of copies, in sum the source's planned
size. Its whole part is certain; the fractions are rounded in pairs: mass is
moved at random from one record to the other, in proportion to their sizes, until one
of them is whole, so that the expected copies of each and the sum of sizes stay.
Each partition leaves at most one unfinished record a source; these are
combined level by level, FAN partitions at a time, until a source has one left.
A source of any size thus loads no task more than another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.checkpoints import cut_lineage

#: Unfinished records that one task combines at each level of the tree, for each source.
FAN = 256
#: Rows up to which a table of targets is one.
MAX_TARGETS = 10_000


def planned_sizes(available: Mapping[str, int], shares: Mapping[str, float], repeats: Mapping[str, int], total: float) -> dict[str, float]:
    """The size of each source: its share of `total` if its repeats allow, the rest spread over the others by their shares."""
    caps = {s: float(available.get(s, 0) * max(0, repeats[s])) for s in shares}
    open_ = {s for s in shares if caps[s] > 0 and shares[s] > 0}
    sizes = dict.fromkeys(shares, 0.0)
    left = min(float(total), sum(caps[s] for s in open_))
    while open_ and left > 0:
        scale = left / sum(shares[s] for s in open_)
        full = {s for s in open_ if caps[s] <= shares[s] * scale}
        if not full:
            sizes |= {s: shares[s] * scale for s in open_}
            break
        sizes |= {s: caps[s] for s in full}
        left -= sum(caps[s] for s in full)
        open_ -= full
    return sizes


def _chance(seed: int, *parts: object) -> float:
    """A number in [0, 1) that only its arguments decide, so that a task run again decides alike."""
    return xxhash.xxh3_64_intdigest(repr(parts), seed) / 2**64


def pivot(a: tuple[int, float, int], b: tuple[int, float, int], seed: int) -> tuple[tuple[int, float, int], tuple[int, float, int]]:
    """One step on two records (id, fraction, size): moves mass until one fraction is 0 or 1; expectations and the sum of sizes stay."""
    (i, p, n), (j, q, m) = a, b
    up = min((1 - p) * n, q * m)  # mass that can go from b to a
    down = min(p * n, (1 - q) * m)
    moved = up if _chance(seed, i, j) * (up + down) < down else -down
    p, q = p + moved / n, q - moved / m

    def whole(x: float) -> float:
        return 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x

    p, q = whole(p), whole(q)
    return (i, p, n), (j, q, m)


ROUNDED = T.StructType([T.StructField("doc", T.LongType()), T.StructField("source", T.StringType()), T.StructField("n", T.LongType()), T.StructField("base", T.LongType()), T.StructField("p", T.DoubleType()), T.StructField("part", T.LongType())])


def _reduce(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, tuple[tuple[int, float, int], int, int]] = {}
        for batch in batches:
            done = []
            for doc, source, n, base, p, part in zip(*(c.to_pylist() for c in batch.columns)):
                if p in (0.0, 1.0) or n == 0:
                    done.append((doc, source, n, base, 0.0 if n == 0 else p, part))
                    continue
                item = (doc, p, n)
                if source not in waiting:
                    waiting[source] = (item, base, part)
                    continue
                other, other_base, other_part = waiting.pop(source)
                for kept, kept_base, kept_part in zip(pivot(other, item, seed), (other_base, base), (other_part, part)):
                    if kept[1] in (0.0, 1.0):
                        done.append((kept[0], source, kept[2], kept_base, kept[1], kept_part))
                    else:
                        waiting[source] = (kept, kept_base, min(other_part, part))
            yield _batch(done)
        yield _batch([(doc, source, n, base, p, part) for source, ((doc, p, n), base, part) in waiting.items()])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 6
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=ROUNDED.names)


def mix(sized: DataFrame, targets: DataFrame, doc: str, source: str, size: str, total: float | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Copies of records, and the shares they make.

    `sized` has a row for each record; `targets` source, target_share and
    max_repeats, a bounded table (MAX_TARGETS). `total` is the size to reach,
    by default that of all records of the targets' sources. A source whose
    repeats can't fill its share is taken whole max_repeats times, and what it lacks is spread
    over the others by their shares. Returns (doc, source, n_tokens, copies) for every
    record of a target's source, also those of 0 copies, and (source, target_share,
    max_repeats, n_docs, available_tokens, planned_tokens, mixed_tokens, actual_share) for every
    target, also those without records. Records of null or other sources and targets of a null source
    are left out; null or negative sizes count as 0; records without size get
    the whole part of their source's copies. Of repeated targets the first by share and repeats counts.
    """
    rows = targets.select("source", "target_share", "max_repeats").where("source IS NOT NULL").limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    wanted = {r["source"]: (max(0.0, r["target_share"] or 0.0), max(0, r["max_repeats"] or 0)) for r in sorted(rows, key=lambda r: (r["source"], r["target_share"] or 0.0, r["max_repeats"] or 0), reverse=True)}
    spark = sized.sparkSession
    plan = spark.createDataFrame([(s, *w) for s, w in wanted.items()], "source string, target_share double, max_repeats int")
    n = F.greatest(F.coalesce(sized[size].cast("long"), F.lit(0)), F.lit(0))
    records = sized.select(sized[doc].cast("long").alias("doc"), sized[source].alias("source"), n.alias("n")).join(F.broadcast(plan.select("source")), "source").select("doc", "source", "n")
    records = cut_lineage(records)
    # One row a target: bounded as the targets are.
    sums = {r["source"]: r["n"] for r in records.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    sizes = planned_sizes(sums, {s: w[0] for s, w in wanted.items()}, {s: w[1] for s, w in wanted.items()}, sum(sums.values()) if total is None else total)
    copies = []
    for s, planned in sizes.items():
        each = min(float(wanted[s][1]), planned / sums[s]) if sums.get(s) else 0.0
        base = math.floor(each + 1e-12)
        copies.append((s, base, 0.0 if each - base < 1e-12 else each - base, planned))
    rates = spark.createDataFrame(copies, "source string, base long, p double, planned double")
    started = records.join(F.broadcast(rates.drop("planned")), "source").select("doc", "source", "n", "base", "p", F.spark_partition_id().cast("long").alias("part"))
    level = cut_lineage(started.mapInArrow(_reduce(seed), ROUNDED))
    finished, unfinished = level.where("p IN (0.0, 1.0)"), level.where("p NOT IN (0.0, 1.0)")
    parts = records.rdd.getNumPartitions()
    while parts > 1:
        grouped = unfinished.withColumn("part", F.floor(F.col("part") / FAN)).repartition(max(1, -(-parts // FAN)), "part", "source").sortWithinPartitions("source", "doc")
        level = cut_lineage(grouped.mapInArrow(_reduce(seed), ROUNDED))
        finished, unfinished = finished.unionByName(level.where("p IN (0.0, 1.0)")), level.where("p NOT IN (0.0, 1.0)")
        parts = -(-parts // FAN)
    # The last record of a source is rounded alone.
    chance = F.pmod(F.xxhash64(F.lit(seed), "doc"), F.lit(1 << 30)) / float(1 << 30)
    last = unfinished.withColumn("p", F.when(chance < F.col("p"), 1.0).otherwise(0.0))
    mixed = finished.unionByName(last).select("doc", "source", F.col("n").alias("n_tokens"), (F.col("base") + F.col("p").cast("long")).alias("copies"))
    got = mixed.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("available_tokens"), F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"))
    report = plan.join(F.broadcast(rates.select("source", F.col("planned").alias("planned_tokens"))), "source").join(got, "source", "left").na.fill(0, ["n_docs", "available_tokens", "mixed_tokens"])
    everything = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))  # over one row a target
    shares = report.select("source", "target_share", "max_repeats", "n_docs", "available_tokens", "planned_tokens", "mixed_tokens", F.coalesce(F.col("mixed_tokens") / F.nullif(everything, F.lit(0)), F.lit(0.0)).alias("actual_share"))
    return mixed, shares
