"""Files as sources: discovery, pluggable decoders into words, and the recovery ladder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = "path string, page int, word_ix int, text string, x0 double, top double, x1 double, bottom double, fontname string, size double, height double, error string"

#: A decoder turns a file's bytes into rows of (page, word_ix, text, x0, top, x1, bottom, fontname, size, height).
Decoder = Callable[[bytes], Iterator[tuple]]

_decoders: dict[str, Decoder] = {}


def register(name: str, decoder: Decoder) -> None:
    """Makes a decoder known by a name."""
    _decoders[name] = decoder


def plain_text(content: bytes) -> Iterator[tuple]:
    """A decoder of text files: pages at form feeds, words on a grid of 6 x 20 points by their place in the line."""
    ix = 0
    for page, text in enumerate(content.decode("utf-8", "replace").split("\f"), 1):
        for row, line in enumerate(text.split("\n")):
            at = 0
            for word in line.split():
                at = line.index(word, at)
                yield page, ix, word, 6.0 * at, 20.0 * row, 6.0 * (at + len(word)), 20.0 * row + 10, None, 10.0, 10.0
                at += len(word)
                ix += 1


def pdf_words(content: bytes) -> Iterator[tuple]:
    """A decoder of PDF files by a library that may not be installed."""
    import io

    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        ix = 0
        for page in pdf.pages:
            for w in page.extract_words(x_tolerance=3, y_tolerance=3, extra_attrs=["fontname", "size", "height"]):
                yield page.page_number, ix, w["text"], w["x0"], w["top"], w["x1"], w["bottom"], w.get("fontname"), w.get("size"), w.get("height")
                ix += 1


register("text", plain_text)
register("pdf", pdf_words)


def discover(spark: SparkSession, folder: str, pattern: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """The files below a folder: path, length, modificationTime; contents are read only if asked for."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)


def decoded(files: DataFrame, *names: str) -> DataFrame:
    """Words of every file by the first of the named decoders that succeeds; a row with `error` alone where none does.

    The decoders are shipped as functions; each batch holds one file after the other, and files are
    tasks' units, so one broken file costs no other.
    """
    tried = [(n, _decoders[n]) for n in names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in WORDS.split(", ")]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                errors = []
                for name, decoder in tried:
                    try:
                        rows = [(path, *row, None) for row in decoder(bytes(content))]
                        break
                    except Exception as e:  # a decoder may fail in any way
                        errors.append(f"{name}: {type(e).__name__}: {e}")
                else:
                    rows = [(path, *[None] * 10, "; ".join(errors)[:500])]
                yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(run, WORDS)


def recovered(pages: DataFrame, *ladder: str) -> DataFrame:
    """Page texts from the first column of the ladder that holds text, with recovery_method; an error mark where none does."""
    method = F.coalesce(*(F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.lit(c)) for c in ladder), F.lit("none"))
    text = F.coalesce(*(F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.col(c)) for c in ladder), F.concat(F.lit("[EXTRACTION ERROR: Page "), F.col("page").cast("string"), F.lit("]")))
    return pages.withColumn("recovery_method", method).withColumn("page_text", text)


def not_yet_done(files: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """Files that the manifest of earlier runs doesn't name."""
    return files.join(manifest.select(key).distinct(), key, "left_anti")


# What a page dump holds beside its words; a table finder's settings are those it was run with.
DUMP = "path string, page int, rotation int, raw_text string, words array<struct<text:string,x0:double,top:double,x1:double,bottom:double,fontname:string,size:double,height:double>>, chars array<struct<text:string,x0:double,top:double,x1:double,bottom:double,size:double>>, rects array<struct<x0:double,top:double,x1:double,bottom:double>>, tables array<struct<method:string,x0:double,top:double,x1:double,bottom:double,rows:array<array<string>>>>"

# How tables are looked for, by method: strategy, snap, join, least edge length, least words across and down.
TABLE_FINDERS = {
    "strict": {"strategy": "lines_strict", "snap_tolerance": 3, "join_tolerance": 3, "edge_min_length": 10, "min_words_vertical": 3, "min_words_horizontal": 1, "confidence": 0.95},
    "relaxed": {"strategy": "lines", "snap_tolerance": 5, "join_tolerance": 5, "edge_min_length": 15, "confidence": 0.85},
    "text": {"strategy": "text", "snap_tolerance": 8, "join_tolerance": 8, "confidence": 0.75},
}


def page_dumps(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that a decoder elsewhere wrote as JSON lines (DUMP); a broken line is left out."""
    return spark.read.schema(DUMP).option("mode", "DROPMALFORMED").json(folder)


def dumped(pages: DataFrame, part: str) -> DataFrame:
    """One part of page dumps as rows: words, chars, rects or tables, numbered as `<part>_ix` from 0; tables with the confidence of their method."""
    rows = pages.select("path", "page", F.posexplode(part).alias(f"{part}_ix", "_p")).select("path", "page", f"{part}_ix", "_p.*")
    if part != "tables":
        return rows
    sure = F.create_map(*(F.lit(x) for name, s in TABLE_FINDERS.items() for x in (name, s["confidence"])))
    return rows.withColumn("confidence", F.coalesce(sure[F.col("method")], F.lit(0.0)))


def dump_ladder(pages: DataFrame) -> DataFrame:
    """The texts that a page can be recovered from, in order: its words joined by blanks, its characters, its raw text."""
    joined = lambda c, sep: F.array_join(F.transform(c, lambda w: w["text"]), sep)
    return pages.select("path", "page", joined("words", " ").alias("simple_extraction"), joined("chars", "").alias("char_extraction"), F.col("raw_text").alias("raw_extraction"))
