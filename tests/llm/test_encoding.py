import base64
import random

import numpy as np
import pytest

from leafmill.llm.encoding import PATTERN, TOKENIZERS, encoder_of, read_ranks, token_counts, token_ids

PATH = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
ALPHABET = ["a", "B", " ", "\n", "é", "日", "本", "の", "ก", "ำ", "½", "²", "7", "٣", "_", "-", "ing", "'s", "'", "\x1c", "\x85", "　", "🧪", "﻿", "न", "्", "Ⅷ", "𝟘", "<|endoftext|>"]


@pytest.fixture(scope="module")
def known():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library(known):
    rng = random.Random(1)
    encoder = encoder_of(read_ranks(PATH))
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 80))) for _ in range(5000)]
    texts += ["a" * 5000, "日本の" * 3000, " " * 1000, "x1_" * 500, "バイアルのラベルを記載している" * 20]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<i4").tolist() == known.encode_ordinary(text)


def test_rows(spark, known):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "Hello wörld", 7), (3, "Hello wörld", 7)], "ids int, text string, _text int")
    rows = token_ids(df, ["ids"], "text", PATH).collect()
    hello = known.encode_ordinary("Hello wörld")
    assert sorted((r.ids_key, r.ids) for r in rows) == [(1, []), (2, []), (3, hello), (3, hello)]
    counts = token_counts(df, ["ids"], "text", PATH).collect()
    assert sorted((r.ids, r.n_tokens) for r in counts) == [(1, 0), (2, 0), (3, len(hello)), (3, len(hello))]
    assert token_ids(df.limit(0), ["ids"], "text", PATH).collect() == []
