"""Files in and out, decoders, resumption and streams."""

import pytest

from leafmill.sources import decoders as D
from leafmill.sources import sinks as S
from leafmill.streaming import files as Z


def test_decoding(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("one two\nthree\ffour")
    (tmp_path / "sub/b.txt").write_text(" ")
    files = D.discover(spark, str(tmp_path), "*.txt")
    words = D.decoded(files, "text").orderBy("word_ix").collect()
    assert [(w.page, w.text, w.x0, w.top) for w in words] == [(1, "one", 0, 0), (1, "two", 24, 0), (1, "three", 0, 20), (2, "four", 0, 0)]
    assert D.discover(spark, str(tmp_path), "*.txt", recursive=False).count() == 1
    manifest = files.where("path LIKE '%a.txt'").select("path")
    assert [r.path.rsplit("/", 1)[1] for r in D.not_yet_done(files, manifest).collect()] == ["b.txt"]


def test_decoders_in_turn(spark, tmp_path):
    def broken(content):
        raise ValueError("bad file")

    (tmp_path / "a.txt").write_text("one")
    D.register("broken", broken)
    files = D.discover(spark, str(tmp_path), "*.txt")
    assert [r.text for r in D.decoded(files, "broken", "text").collect()] == ["one"]
    assert "bad file" in D.decoded(files, "broken").first().error


def test_recovery(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, " ", "b"), (3, None, "")], "page int, words string, chars string")
    assert [(r.recovery_method, r.page_text) for r in D.recovered(df, "words", "chars").orderBy("page").collect()] == [("words", "a"), ("chars", "b"), ("none", "[EXTRACTION ERROR: Page 3]")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "x\ny", True), ("b", None, False)], "filename string, text string, success boolean")
    S.write_texts(df, "filename", "text", str(tmp_path / "t"))
    assert {(r.filename, r.text) for r in spark.read.json(str(tmp_path / "t")).collect()} == {("a", "x\ny"), ("b", "")}
    assert S.json_report(df).first().report == '{"total":2,"successful":1,"failed":1,"success_rate":"50.0%","failure_rate":"50.0%","failed_files":["b"]}'
    S.write_csv_report(df.select("filename"), str(tmp_path / "c"))
    assert [r.filename for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()] == ["a", "b"]


def test_stream_resumes(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: Z.run_available(Z.file_stream(spark, str(tmp_path / "in"), "id long", 1), str(tmp_path / "ck"), lambda b: b.selectExpr("id * 2 AS v"), str(tmp_path / "out"))
    assert run() == 3
    assert run() == 0
    spark.range(30, 40).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == 1
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2 * i for i in range(40)]


def test_windows(spark):
    df = spark.createDataFrame([("2026-01-01 10:05:00", "a"), ("2026-01-01 10:59:59", "a"), ("2026-01-01 11:00:00", "a")], "t string, k string").selectExpr("CAST(t AS timestamp) AS t", "k")
    assert sorted(r.n for r in Z.windowed_counts(df, "t", "k").collect()) == [1, 2]


@pytest.mark.parametrize("scores, rounds", [([0.5, 0.51, 0.9], 2), ([0.1, 0.5, 0.9], 3)])
def test_iteration(spark, scores, rounds):
    left = list(scores)
    assert Z.iterate(spark.range(1), lambda s: (s, left.pop(0)))[1] == rounds
