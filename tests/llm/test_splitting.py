from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm.splitting import piece_spans, split_oversized


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .,\n。！é日", max_size=200), st.integers(1, 40), st.integers(0, 45))
def test_pieces_hold_the_text(text, limit, overlap):
    spans = piece_spans(text, limit, overlap)
    lap = min(overlap, limit - 1)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b - a <= limit for a, b in spans)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert c == b - lap and d > b and c > a
    assert "".join(text[a if k == 0 else a + lap : b] for k, (a, b) in enumerate(spans)) == text


def test_cuts_at_sentence_ends():
    text = "One two three. Four five six. Seven eight nine."
    assert [text[a:b] for a, b in piece_spans(text, 32, 0)] == ["One two three. Four five six. ", "Seven eight nine."]


def test_weighted_sizes():
    assert piece_spans("aaaa", 4, 0, lambda c: 2) == [(0, 2), (2, 4)]


def test_edge_rows(spark):
    df = spark.createDataFrame(
        [(1, None, 10, 2, "x"), (2, "", 10, 2, "x"), (3, "abc def ghi", None, 1, "x"), (4, "abcdefghijk", 5, None, None), (4, "abcdefghijk", 5, None, None)],
        "piece int, content string, max int, lap int, piece_no string",
    )
    rows = split_oversized(df, ["piece"], "content", "max", "lap").collect()
    got = sorted((r.piece_key, r.piece_no, r.n_pieces, r.piece) for r in rows)
    assert got == sorted([(1, 1, 1, ""), (2, 1, 1, ""), (3, 1, 1, "abc def ghi")] + 2 * [(4, 1, 3, "abcde"), (4, 2, 3, "fghij"), (4, 3, 3, "k")])
    assert split_oversized(df.limit(0), ["piece"], "content", "max", "lap").count() == 0
