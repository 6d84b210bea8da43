"""A Bloom filter of hashes of bounded size, built on the cluster and sent to every task.

It thins what is looked up in a table of any size; what passes still meets the table. Its size
grows with the table up to MAX_BITS, beyond which more passes in vain, but nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most that a filter takes: 32 MB.
MAX_BITS = 1 << 28
MIN_BITS = 1 << 16
#: Parts that are built apart, and bits that stand for a hash.
BLOCKS, PLACES = 64, 4


class Filter:
    """`bits` as rows of BLOCKS; a hash's block is by its top bits, its places in it by the others."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits.reshape(-1)
        self.size = len(self.bits) * 8 // BLOCKS

    def __contains__(self, _: object) -> bool:
        raise TypeError("ask for arrays by `has`")

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Which of these hashes (uint64) may be in the table; those in it always are."""
        left = np.arange(len(hashes))
        for k in range(PLACES):  # most hashes that aren't there fail at the first place
            h = hashes[left]
            at = (h >> np.uint64(58)) * np.uint64(self.size) + _place(h, k, self.size)
            left = left[((self.bits[(at >> np.uint64(3)).view(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).view(bool)]
        found = np.zeros(len(hashes), bool)
        found[left] = True
        return found


def _place(hashes: np.ndarray, k: int, size: int) -> np.ndarray:
    low, step = hashes & np.uint64(0xFFFFFFFF), ((hashes >> np.uint64(26)) & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return (((low + np.uint64(k) * step) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(29)) & np.uint64(size - 1)


def bits_for(n: int) -> int:
    """Sixteen bits a hash and more, in powers of two within the limits."""
    return min(MAX_BITS, max(MIN_BITS, 1 << (16 * max(n, 1) - 1).bit_length()))


def filter_of(hashes: DataFrame, column: str, n: int) -> Filter:
    """The filter of a column of 64-bit hashes (null left out), about `n` of them.

    A block is built by one task, which holds its bits alone (MAX_BITS / BLOCKS); the blocks, of bounded size
    together, come to the driver.
    """
    size = bits_for(n) // BLOCKS

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            h = batch.column("_h").to_numpy().view(np.uint64)
            blocks = (h >> np.uint64(58)).astype(np.int64)
            for block in np.unique(blocks).tolist():
                bits = parts.setdefault(block, np.zeros(size, bool))
                for k in range(PLACES):
                    bits[_place(h[blocks == block], k, size).view(np.int64)] = True
        for block, bits in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    rows = hashes.select(hashes[column].alias("_h")).where("_h IS NOT NULL").repartition(BLOCKS, F.shiftrightunsigned("_h", 58))
    held = np.zeros((BLOCKS, size // 8), np.uint8)
    for row in rows.mapInArrow(build, "block int, bits binary").collect():
        held[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return Filter(held)
