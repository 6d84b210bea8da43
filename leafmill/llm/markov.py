"""A hidden Markov model over lines, each of which shows several discrete statistics.

The emission of a line is the product of one table for each statistic. Paths of many
sequences are found at once, step by step; training by Viterbi passes runs on the
cluster over all sequences, of which only counts come back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class LineModel:
    """Log start, moves (from, to) and stop of the states, and for each statistic the log emissions (state, value)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, stop: np.ndarray, emit: Sequence[np.ndarray]) -> None:
        self.start, self.move, self.stop = (np.log(np.asarray(m, float) + 1e-12) for m in (start, move, stop))
        self.emit = [np.log(np.asarray(m, float) + 1e-12) for m in emit]

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """The log emission of each line (rows of `codes`) in each state."""
        total = np.zeros((len(codes), len(self.start)))
        for k, table in enumerate(self.emit):
            total += table.T[codes[:, k]]
        return total

    def paths(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The likeliest state of each line, `lengths` giving how many lines each sequence has; of a tie the earlier state."""
        emit = self.emissions(codes)
        states = np.zeros(len(codes), np.int64)
        order = np.argsort(-lengths, kind="stable")
        sizes, begins = lengths[order], (np.cumsum(lengths) - lengths)[order]
        open_at = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), "left")  # sequences longer than t
        back = np.zeros((len(codes), len(self.start)), np.int8)
        score = np.empty((len(sizes), len(self.start)))
        for t, k in enumerate(open_at):
            at = begins[:k] + t
            if t == 0:
                score[:k] = self.start + emit[at]
            else:
                ways = score[:k, :, None] + self.move
                back[at] = ways.argmax(1)
                score[:k] = ways.max(1) + emit[at]
        last = (score + self.stop).argmax(1) if len(sizes) else np.zeros(0, np.int64)
        now = np.zeros(len(sizes), np.int64)
        for t in range(len(open_at) - 1, -1, -1):
            k, later = open_at[t], open_at[t + 1] if t + 1 < len(open_at) else 0
            at = begins[:later] + t + 1
            now[:later] = back[at, now[:later]]
            now[later:k] = last[later:k]
            states[begins[:k] + t] = now[:k]
        return states

    def counts(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """How often the paths start, move, stop and emit, as one flat array."""
        states, n = self.paths(codes, lengths), len(self.start)
        ends = np.cumsum(lengths[lengths > 0])
        first, last = np.append(0, ends[:-1])[: len(ends)], ends - 1
        inner = np.ones(len(states), bool)
        inner[first] = False
        at = np.flatnonzero(inner)
        parts = [np.bincount(states[first], minlength=n), np.bincount(states[at - 1] * n + states[at], minlength=n * n), np.bincount(states[last], minlength=n)]
        parts += [np.bincount(states * t.shape[1] + codes[:, k], minlength=t.size) for k, t in enumerate(self.emit)]
        return np.concatenate(parts).astype(float)

    def estimated(self, counts: np.ndarray, weight: float) -> "LineModel":
        """The model of these counts, `weight` times the present probabilities standing as earlier ones."""
        n, at, made = len(self.start), 0, []
        for table in (self.start, self.move, self.stop, *self.emit):
            made.append(counts[at : at + table.size].reshape(table.shape))
            at += table.size
        stays = np.exp(self.move).sum(1) + np.exp(self.stop)
        start = made[0] + weight * np.exp(self.start)
        move, stop = (m + weight * np.exp(old) / (stays[:, None] if old.ndim == 2 else stays) for m, old in zip(made[1:3], (self.move, self.stop)))
        both = move.sum(1) + stop
        emit = [m + weight * np.exp(old) for m, old in zip(made[3:], self.emit)]
        assert len(start) == n
        return LineModel(start / start.sum(), move / both[:, None], stop / both, [m / m.sum(1, keepdims=True) for m in emit])

    def without_path(self, codes: np.ndarray) -> np.ndarray:
        """The state that emits each line best, whatever stands around it: what the path is measured against."""
        return self.emissions(codes).argmax(1)


def packed(codes: np.ndarray) -> bytes:
    """Codes as bytes; their lines repeat much."""
    return zlib.compress(np.ascontiguousarray(codes, np.uint8).tobytes(), 1)


def unpacked(packs: Sequence[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, lines of each) of packs."""
    parts = [np.frombuffer(zlib.decompress(p), np.uint8).reshape(-1, width) for p in packs]
    return np.concatenate(parts) if parts else np.zeros((0, width), np.uint8), np.array([len(p) for p in parts], np.int64)


def trained(model: LineModel, sequences: DataFrame, column: str, rounds: int, weight: float, lengths: str | None = None) -> LineModel:
    """The model after Viterbi passes over every sequence of `sequences`, packed codes in `column`.

    A row is a sequence, or as many as the array of integers in `lengths` says.

    Each task sends the sums of its counts, one number for each entry of the model, and these are
    added on the cluster, so what comes to the driver is of the model's size.
    """
    width = len(model.emit)
    packs = sequences.select(sequences[column].alias("_codes"), (sequences[lengths] if lengths else F.lit(None).cast("array<int>")).alias("_parts")).where("_codes IS NOT NULL")
    for _ in range(rounds):

        def count(batches: Iterator[pa.RecordBatch], model: LineModel = model) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                codes, sizes = unpacked(batch.column("_codes").to_pylist(), width)
                if lengths:
                    sizes = batch.column("_parts").flatten().to_numpy().astype(np.int64)
                if len(codes):
                    found = model.counts(codes, sizes)
                    total = found if total is None else total + found
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["k", "n"])

        sums = packs.mapInArrow(count, "k int, n double").groupBy("k").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros(sum(t.size for t in (model.start, model.move, model.stop, *model.emit)))
        for row in sums:
            counts[row["k"]] = row["n"]
        model = model.estimated(counts, weight)
    return model
