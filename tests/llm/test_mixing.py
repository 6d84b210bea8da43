import random
from collections import defaultdict

import pytest

from leafmill.llm.mixing import mix, pivot, planned_sizes


def test_planned_sizes():
    assert planned_sizes({"a": 100, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1}, 200) == {"a": 100, "b": 100}
    got = planned_sizes({"a": 10, "b": 100, "c": 100}, {"a": 0.5, "b": 0.25, "c": 0.25, "d": 0.0}, {"a": 2, "b": 3, "c": 3, "d": 1}, 210)
    assert got == pytest.approx({"a": 20, "b": 95, "c": 95, "d": 0})
    assert planned_sizes({}, {"a": 1.0}, {"a": 3}, 0) == {"a": 0.0}


def test_pivot_keeps_sums_and_expectations():
    up = [0.0, 0.0]
    for seed in range(4000):
        a, b = pivot((1, 0.3, 10), (2, 0.6, 40), seed)
        assert a[1] * 10 + b[1] * 40 == pytest.approx(27)
        assert a[1] in (0.0, 1.0) or b[1] in (0.0, 1.0)
        up[0] += a[1] / 4000
        up[1] += b[1] / 4000
    assert up == pytest.approx([0.3, 0.6], abs=0.02)


def test_mix(spark):
    rng = random.Random(5)
    rows = [(i, "big" if i % 3 else "mid", rng.randint(1, 900)) for i in range(1500)] + [(2000 + i, "small", 50) for i in range(10)]
    rows += [(3000, None, 10), (3001, "other", 10), (3002, "mid", None), (3003, "mid", 0)]
    docs = spark.createDataFrame(rows, "copies long, source string, n_tokens long").repartition(7)
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.4, 3), ("small", 0.1, 2), ("none", 0.1, 9), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    mixed, shares = mix(docs, targets, "copies", "source", "n_tokens")
    made = mixed.collect()
    assert sorted(r.doc for r in made) == sorted(r[0] for r in rows if r[1] in ("big", "mid", "small"))
    repeats = {"big": 1, "mid": 3, "small": 2}
    sums = defaultdict(int)
    for r in made:
        assert 0 <= r.copies <= repeats[r.source]
        sums[r.source] += r.copies * r.n_tokens
    report = {r.source: r for r in shares.collect()}
    assert set(report) == {"big", "mid", "small", "none"}
    assert sums["small"] == 1000 and report["none"].actual_share == 0
    for s in ("big", "mid"):
        assert abs(sums[s] - report[s].planned_tokens) <= 900
        assert report[s].mixed_tokens == sums[s]
    assert sum(r.actual_share for r in report.values()) == pytest.approx(1)
    assert {(r.doc, r.copies) for r in mix(docs, targets, "copies", "source", "n_tokens")[0].collect()} == {(r.doc, r.copies) for r in made}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc long, source string, n long")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    mixed, shares = mix(docs, targets, "doc", "source", "n")
    assert mixed.collect() == [] and [r.actual_share for r in shares.collect()] == [0.0]
    assert mix(docs, targets.limit(0), "doc", "source", "n")[1].collect() == []
