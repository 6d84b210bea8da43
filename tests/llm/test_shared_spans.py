import random
from collections import defaultdict

import numpy as np

from leafmill.llm.filters import MAX_BITS, MIN_BITS, bits_for, filter_of
from leafmill.llm.shared_spans import COVER, PERIOD, SURE_ANCHOR, _anchors, _candidate_spans, merged, mixed, shared_runs

LENGTH = 200


def brute_force(rows):
    seen = defaultdict(set)
    for key, text in rows:
        for p in range(len(text or "") - LENGTH + 1):
            seen[text[p : p + LENGTH]].add(key)
    runs = set()
    for key, text in rows:
        marked = [False] * (len(text or "") + 1)
        for p in range(len(text or "") - LENGTH + 1):
            if len(seen[text[p : p + LENGTH]]) > 1:
                marked[p : p + LENGTH] = [True] * LENGTH
        start = None
        for p, mark in enumerate(marked):
            if mark and start is None:
                start = p
            if not mark and start is not None:
                runs.add((key, start, p))
                start = None
    return runs


def test_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def made_rows(seed, n):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("ab é日🧪") for _ in range(k))
    pool = [text(rng.choice([150, 199, 200, 201, 260, 700])) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            piece = rng.choice(pool)
            parts.append(rng.choice([text(rng.randint(0, 300)), piece, piece[rng.randint(0, 40) :]]))
        rows.append((i, "".join(parts)))
    return rows


def test_equals_brute_force(spark):
    rows = made_rows(7, 60) + [(100, None), (101, ""), (102, "x" * 500), (103, "x" * 250), (104, "yz" * 400)]
    df = spark.createDataFrame(rows, "start_pos long, text string").repartition(5)
    got = [tuple(r) for r in shared_runs(df, "start_pos", "text", LENGTH).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_force(rows)


def test_hot_copies_and_repeats(spark):
    rng = random.Random(3)
    copied = "".join(rng.choice("abcdef ") for _ in range(600))
    rows = [(i, copied) for i in range(300)] + [(i, "q" + copied[:230] + "q") for i in range(300, 310)] + [(999, copied[5:100])]
    df = spark.createDataFrame(rows + rows[:20], "doc_id long, text string").repartition(6)
    got = set(map(tuple, shared_runs(df, "doc_id", "text", LENGTH).collect()))
    assert got == {(i, 0, 600) for i in range(300)} | {(i, 0, 232) for i in range(300, 310)}


def test_one_key_alone_and_empty(spark):
    df = spark.createDataFrame([(1, "ab" * 300), (1, "ab" * 300), (None, "ab" * 300)], "doc_id long, text string")
    assert shared_runs(df, "doc_id", "text", LENGTH).collect() == []
    assert shared_runs(df.limit(0), "doc_id", "text", LENGTH).collect() == []


def test_repeats_are_one_row(spark):
    """Two texts of 20,000 points send one span row each, though every window of theirs is the same."""
    rows = [(1, "." * 20_000), (2, "ab" * 300 + "." * 20_000), (3, "ab" * 150)]
    df = spark.createDataFrame(rows, "_doc long, _text string").coalesce(1)
    anchors = list(_anchors(LENGTH)(iter(df.toArrow().to_batches())))
    assert sum(b.num_rows for b in anchors) < 1000
    hashes = np.unique(np.concatenate([b.column("h").to_numpy() for b in anchors]) & ~SURE_ANCHOR)
    known = filter_of(spark.createDataFrame([(int(h),) for h in hashes], "h long"), "h", len(hashes))
    owners = filter_of(spark.createDataFrame([(int(h),) for h in mixed(np.array([1, 2], np.uint64)).view(np.int64)], "h long"), "h", 2)
    one = [list(_candidate_spans(LENGTH, Held((known, owners)))(iter(df.where(f"_doc = {k}").toArrow().to_batches()))) for k in (1, 2)]
    assert [sum(b.num_rows for b in made) for made in one][0] == 1 and sum(b.num_rows for b in one[1]) < 300
    got = set(map(tuple, shared_runs(df.repartition(3), "_doc", "_text", LENGTH).collect()))
    assert got == {(1, 0, 20_000), (2, 600, 20_600), (2, 0, 600), (3, 0, 300)} - {(2, 0, 600), (2, 600, 20_600)} | {(2, 0, 20_600)}


class Held:
    def __init__(self, value):
        self.value = value


def test_filter(spark):
    rng = np.random.default_rng(2)
    inside, outside = rng.integers(0, 2**63, (2, 20_000)).astype(np.int64)
    inside[::2] *= -1
    df = spark.createDataFrame([(int(h),) for h in inside] + [(None,)], "h long")
    held = filter_of(df, "h", len(inside))
    assert held.has(inside.view(np.uint64)).all() and held.has(outside.view(np.uint64)).mean() < 0.01
    assert not filter_of(df.limit(0), "h", 0).has(outside.view(np.uint64)).any()
    assert bits_for(0) == MIN_BITS and bits_for(10**12) == MAX_BITS and bits_for(100_000) == 1 << 21


def test_merged():
    doc, a, b = merged(np.array([2, 1, 1, 1, 2]), np.array([5, 0, 10, 3, 0]), np.array([9, 4, 12, 10, 5]))
    assert list(zip(doc, a, b)) == [(1, 0, 12), (2, 0, 9)]
