"""Chunks of pages: packing, overlaps, lookup, reassembly and context windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.columns import match_starts

# What begins a section, by line.
SECTION_STARTS = "(?m)^(?:#{1,6}\\s+|[0-9]+\\.\\s+|[0-9]+\\.[0-9]+\\s+|第[0-9]+[章条節項]|[一二三四五六七八九十]+[、.]|={3,}|-{3,})"


def packed(pages: DataFrame, keys: list[str], page: str, text: str, most: int, least: int, unit: str = "characters") -> DataFrame:
    """Pages packed in order into chunks: a chunk is closed before a page that would exceed `most`, if it has `least`.

    Whether a chunk closes depends on all before it, so a document's page sizes
    (not its texts) are folded; the texts are joined afterwards.
    """
    size = F.length(text) if unit == "characters" else F.size(F.filter(F.split(text, "[ \\t\\n]+"), lambda w: w != ""))
    sep = 2 if unit == "characters" else 0
    sized = pages.withColumn("_n", F.coalesce(size, F.lit(0)))
    ordered = sized.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col("_n").alias("n")))).alias("_p"))
    start = F.struct(F.lit(0).alias("k"), F.lit(-1).alias("held"), F.array().cast("array<struct<p:int,k:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        closes = (acc["held"] >= least) & (acc["held"] + x["n"] > most)
        k = acc["k"] + closes.cast("int")
        held = F.when(closes | (acc["held"] < 0), x["n"]).otherwise(acc["held"] + sep + x["n"])
        return F.struct(k.alias("k"), held.alias("held"), F.concat(acc["out"], F.array(F.struct(x["p"].alias("p"), k.alias("k")))).alias("out"))

    placed = ordered.select(*keys, F.explode(F.aggregate("_p", start, step, lambda a: a["out"])).alias("_o")).select(*keys, F.col("_o.p").alias(page), F.col("_o.k").alias("chunk_id"))
    return _joined(pages.join(placed, [*keys, page]), keys, page, text)


def packed_by_count(pages: DataFrame, keys: list[str], page: str, text: str, per_chunk: int) -> DataFrame:
    """Chunks of `per_chunk` pages."""
    return _joined(pages.withColumn("chunk_id", F.floor((F.col(page) - 1) / per_chunk).cast("int")), keys, page, text)


def _joined(placed: DataFrame, keys: list[str], page: str, text: str) -> DataFrame:
    chunk = placed.groupBy(*keys, "chunk_id").agg(F.min(page).alias("page_start"), F.max(page).alias("page_end"), F.array_sort(F.collect_list(F.struct(page, F.coalesce(text, F.lit("")).alias("t")))).alias("_t"))
    content = F.array_join(F.transform("_t", lambda x: x["t"]), "\n\n")
    return chunk.select(*keys, "chunk_id", "page_start", "page_end", content.alias("content")).withColumn("char_count", F.length("content"))


def section_positions(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Where sections begin in each text."""
    found = df.where(F.length(text) > 0).select(*keys, text, F.regexp_extract_all(F.col(text), F.lit(SECTION_STARTS), F.lit(0)).alias("_m")).where(F.size("_m") > 0)
    spots = found.select(*keys, F.explode(F.arrays_zip(match_starts(F.col(text), F.lit(SECTION_STARTS), F.col("_m")).alias("position"), F.col("_m").alias("start_text"))).alias("_s"))
    return spots.select(*keys, "_s.position", "_s.start_text")


def packed_by_sections(df: DataFrame, keys: list[str], text: str, most: int = 5000, least: int = 1000) -> DataFrame:
    """Texts in chunks that end where sections begin: keys, chunk_id, start_pos, end_pos, content.

    A chunk is closed before a section that would take it beyond `most`, if it holds `least`; what follows the last
    begin of a section stays with its chunk. Only the sections' sizes are folded. A text without sections has no row (pack its pages instead).
    """
    starts = section_positions(df, keys, text).groupBy(*keys).agg(F.array_sort(F.collect_set("position")).alias("_p"))
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("held"), F.array(F.lit(0)).alias("cuts"))

    def step(acc: Column, p: Column) -> Column:
        size = p - acc["at"]
        closes = (acc["held"] + size > most) & (acc["held"] >= least)
        return F.struct(p.alias("at"), F.when(closes, size).otherwise(acc["held"] + size).alias("held"), F.when(closes, F.concat(acc["cuts"], F.array(acc["at"]))).otherwise(acc["cuts"]).alias("cuts"))

    cut = df.join(starts, keys).select(*keys, F.col(text).alias("_text"), F.aggregate("_p", begin, step, lambda a: a["cuts"]).alias("_c"))
    ends = F.concat(F.slice("_c", F.lit(2), F.size("_c")), F.array(F.length("_text")))
    each = cut.select(*keys, "_text", F.posexplode(F.arrays_zip(F.col("_c").alias("start_pos"), ends.alias("end_pos"))).alias("chunk_id", "_s"))
    return each.select(*keys, "chunk_id", "_s.start_pos", "_s.end_pos", F.expr("substring(_text, _s.start_pos + 1, _s.end_pos - _s.start_pos)").alias("content"))


def with_overlaps(chunks: DataFrame, keys: list[str], size: int = 500) -> DataFrame:
    """Adds overlap_start_text, the end of the chunk before, and overlap_end_text, the own end unless the chunk is the last."""
    order = Window.partitionBy(*keys).orderBy("chunk_id")
    tail = F.substring("content", -size, size)
    cut = F.when(F.length("content") > size, tail).otherwise(F.col("content"))
    with_tail = chunks.withColumn("_tail", cut)
    before, after = F.lag("_tail").over(order), F.lead("chunk_id").over(order)
    return with_tail.select("*", F.coalesce(before, F.lit("")).alias("overlap_start_text"), F.when(after.isNotNull(), F.col("_tail")).otherwise("").alias("overlap_end_text")).drop("_tail")


def page_to_chunk(pages: DataFrame, chunks: DataFrame, keys: list[str], page: str) -> DataFrame:
    """The first chunk that holds each page: an equality join on the document with the range as residual condition."""
    c = chunks.select(*keys, "chunk_id", "page_start", "page_end")
    joined = pages.select(*keys, page).distinct().join(c, keys).where(F.col(page).between(F.col("page_start"), F.col("page_end")))
    return joined.groupBy(*keys, page).agg(F.min("chunk_id").alias("chunk_id"))


def pages_of_chunk(chunks: DataFrame, pages: DataFrame, keys: list[str], page: str, text: str, edge: int = 100) -> DataFrame:
    """Pages whose first or last `edge` characters occur in a chunk's content; page 1 where none does."""
    ends = pages.select(*keys, F.col(page).alias("_page"), F.substring(text, 1, edge).alias("_first"), F.substring(text, -edge, edge).alias("_last")).where(F.length("_first") > 0)
    hit = F.col("content").contains(F.col("_first")) | F.col("content").contains(F.col("_last"))
    found = chunks.join(ends, keys, "left").groupBy(*keys, "chunk_id").agg(F.array_sort(F.collect_set(F.when(hit, F.col("_page")))).alias("pages"))
    return found.withColumn("pages", F.when(F.size("pages") == 0, F.array(F.lit(1))).otherwise(F.col("pages")))


def reassembled(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Documents from their chunks in order, a content that begins with the overlap before it without it: text and duplicates_removed."""
    starts = (F.coalesce(F.length("overlap_start_text"), F.lit(0)) > 0) & F.col("content").startswith(F.col("overlap_start_text"))
    bare = F.when(starts, F.substring(F.col("content"), F.length("overlap_start_text") + 1, F.length("content"))).otherwise(F.col("content"))
    joined = chunks.withColumn("_bare", F.coalesce(bare, F.lit(""))).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("chunk_id", "_bare"))).alias("_c"), F.count("*").alias("n_chunks"), F.count_if(starts).alias("duplicates_removed"))
    text = F.regexp_replace(F.array_join(F.transform("_c", lambda x: x["_bare"]), "\n\n"), "\n{4,}", "\n\n\n")
    return joined.select(*keys, "n_chunks", "duplicates_removed", text.alias("full_text"))


def context_text(chunks: DataFrame, keys: list[str], size: int = 200) -> DataFrame:
    """Each chunk between the end of the one before and the begin of the one after, marked."""
    order = Window.partitionBy(*keys).orderBy("chunk_id")
    lag, lead = F.lag("content").over(order), F.lead("content").over(order)
    before = F.when(lag.isNotNull(), F.concat(F.lit("[...previous context...]\n"), F.substring(lag, -size, size), F.lit("\n"))).otherwise("")
    after = F.when(lead.isNotNull(), F.concat(F.lit("\n"), F.substring(lead, 1, size), F.lit("\n[...continues...]"))).otherwise("")
    return chunks.select(*keys, "chunk_id", F.concat(before, F.col("content"), after).alias("context_text"))


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(text) / 4).cast("int")


def fitted(text: Column, max_tokens: int, edge: int = 500) -> Column:
    """The text if it fits four characters a token, else its two ends around a note."""
    short = F.concat(F.substring(text, 1, edge), F.lit("\n[... content omitted ...]\n"), F.substring(text, -edge, edge))
    return F.when(F.length(text) <= max_tokens * 4, text).otherwise(short)


def memory_estimate(chars: Column, chunk: int) -> Column:
    """Bytes that a document of `chars` characters needs in chunks of `chunk`."""
    return (chars * 2 + F.greatest(F.lit(1), F.floor(chars / chunk)) * 1000) * 1.5


def context_pieces(df: DataFrame, keys: list[str], text: str, most: int = 4000, overlap: int = 200) -> DataFrame:
    """Texts in pieces of at most `most` characters: keys, piece_no, start_pos, end_pos.

    A piece ends behind the last blank line of its last quarter, else behind the last sentence of
    its last eighth, else hard; the next begins `overlap` before, but always further on. Each
    end depends on the one before, so Arrow batches walk over the texts. Null texts have no piece.
    """
    if not 0 <= overlap < most:
        raise ValueError("the overlap must be under the size of a piece")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, t in enumerate(batch["_text"]):
                start, n = 0, 0
                while True:
                    end = min(len(t), start + most)
                    if end < len(t):
                        blank, stop = t.rfind("\n\n", end - most // 4, end), t.rfind(". ", end - most // 8, end)
                        found = blank + 2 if blank >= 0 else stop + 2 if stop >= 0 else end
                        end = found if start < found <= end else end
                    rows.append((i, n, start, end))
                    if end >= len(t):
                        break
                    start, n = max(end - overlap, start + 1), n + 1
            made = pd.DataFrame(rows, columns=["_row", "piece_no", "start_pos", "end_pos"]).astype("int32")
            yield pd.concat([batch[keys].iloc[made["_row"]].reset_index(drop=True), made[["piece_no", "start_pos", "end_pos"]]], axis=1)

    texts = df.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.select(*keys).schema)
    return texts.mapInPandas(cut, f"{fields}, piece_no int, start_pos int, end_pos int")


def processed(chunks: DataFrame, keys: list[str], process: Callable[[Column, Column], Column], size: int = 500) -> DataFrame:
    """Each chunk's content through `process(content, context)`, the context being the end of the chunk before."""
    before = F.coalesce(F.substring(F.lag("content").over(Window.partitionBy(*keys).orderBy("chunk_id")), -size, size), F.lit(""))
    return chunks.select(*keys, "chunk_id", process(F.col("content"), before).alias("content"))
