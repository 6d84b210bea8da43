"""The pN_ queries: each operator over its whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.copies import one_of_each
from leafmill.llm.encoding import TOKENIZERS, token_counts, token_ids
from leafmill.llm.encodings import garbled_tokens, put_right
from leafmill.llm.lookalikes import consistent_text, lookalike_terms
from leafmill.llm.mixing import mix
from leafmill.llm.prose import text_statistics
from leafmill.llm.scan_noise import continuous_text, scan_noise
from leafmill.llm.sentences import sentences
from leafmill.llm.shared_spans import shared_runs
from leafmill.llm.splitting import split_oversized
from leafmill.sources.tables import read_table, spread

CHUNK = ["doc_id", "chunk_id"]
VOCABULARY = os.environ.get("LEAFMILL_TOKENIZERS", TOKENIZERS) + "/byte_bpe_50k.tiktoken"


def chunks_with_strategy(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks with the settings of their strategy; a null strategy_id means 1.

    chunking_strategies is a settings table of a fixed handful of rows, so its broadcast is bounded.
    """
    chunks = spread(read_table(spark, folder, "chunks")).select("doc_id", "chunk_id", F.coalesce("strategy_id", F.lit(1)).alias("strategy_id"), "content")
    settings = read_table(spark, folder, "chunking_strategies").select("strategy_id", "max_chunk_size", "overlap_size", "chunk_by")
    return chunks.join(F.broadcast(settings), "strategy_id")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Ends of the sentence units of chunks cut by sections; repeated chunks are dropped after they shrank to offsets."""
    chunks = chunks_with_strategy(spark, folder).where(F.col("chunk_by") == "sections")
    return sentences(chunks, CHUNK, "content").select(*CHUNK, "end_pos").distinct()


def p1_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """The sentence units of every raw_text and every content."""
    chunks = one_of_each(read_table(spark, folder, "chunks").select(*CHUNK, "content"), CHUNK)
    results = one_of_each(spread(read_table(spark, folder, "extraction_results")).select("doc_id", F.col("raw_text").alias("content")), ["doc_id"])
    return sentences(chunks.unionByName(results.select("doc_id", F.lit(None).cast("int").alias("chunk_id"), "content")), CHUNK, "content")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in whose raw_text at least half of the characters stand outside of sentences."""
    measured = text_statistics(spread(read_table(spark, folder, "extraction_results")), ["doc_id"], "raw_text", language="lang")
    return measured.where("verdict = 'not prose'").select("doc_id").distinct()


def p2_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics and the verdict of every raw_text; repeated rows are dropped after they shrank to numbers."""
    return text_statistics(spread(read_table(spark, folder, "extraction_results")), ["doc_id"], "raw_text", language="lang").dropDuplicates(["doc_id"])


def p2_words(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics of every raw_text that SQL can express; repeated rows are dropped after they shrank to numbers."""
    rows = text_statistics(spread(read_table(spark, folder, "extraction_results")), ["doc_id"], "raw_text", language="lang")
    return rows.select("doc_id", "word_count", "mean_word_length", "symbol_ratio", "end_punctuation_share").distinct()


def result_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of extraction_results as (doc_id, page_number, page), numbered from 1."""
    pages = spread(read_table(spark, folder, "extraction_results")).select("doc_id", F.posexplode("pages").alias("_at", "page"))
    return pages.select("doc_id", (F.col("_at") + 1).alias("page_number"), "page")


def scanned_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with is_scanned true on at least one page."""
    return read_table(spark, folder, "page_analysis").where("is_scanned").select("doc_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Noisy lines of scanned documents."""
    lines = scan_noise(spread(read_table(spark, folder, "extraction_results")), "doc_id", "pages", scanned_documents(spark, folder))
    return lines.withColumnsRenamed({"doc": "doc_id", "page": "page_number", "line": "line_no"})


def p3_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Scanned documents as continuous paragraphs."""
    return continuous_text(spread(read_table(spark, folder, "extraction_results")), "doc_id", "pages", scanned_documents(spark, folder)).withColumnRenamed("doc", "doc_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of which any part was decoded wrongly."""
    hits = garbled_tokens(result_pages(spark, folder), "doc_id", "page_number", "page")
    return hits.select(F.col("doc").alias("doc_id"), F.col("page").alias("page_number")).distinct()


def p4_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every page in its original characters."""
    pages = one_of_each(result_pages(spark, folder), ["doc_id", "page_number"])
    return put_right(pages, "doc_id", "page_number", "page").withColumnsRenamed({"doc": "doc_id", "page": "page_number"})


def p5_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Cells, footnotes and documents as (src, item_id, text)."""
    entries = [("cell", "table_cells", "cell_id", "text"), ("footnote", "footnote_definitions", "footnote_id", "text"), ("document", "extraction_results", "doc_id", "raw_text")]
    parts = [spread(read_table(spark, folder, table)).select(F.lit(src).alias("src"), F.col(item).alias("item_id"), F.col(text).alias("text")) for src, table, item, text in entries]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Entries that look like a glossary term in other characters; repeated rows are dropped after they shrank to ids."""
    entries, terms = p5_entries(spark, folder), read_table(spark, folder, "glossary")
    whole = lookalike_terms(entries.where("src <> 'document'"), ["src", "item_id"], "text", terms)
    within = lookalike_terms(entries.where("src = 'document'"), ["src", "item_id"], "text", terms, whole=False)
    return whole.unionByName(within).distinct()


def p5_text(spark: SparkSession, folder: str) -> DataFrame:
    """Every cell, footnote and raw_text in its one form."""
    entries = one_of_each(p5_entries(spark, folder), ["src", "item_id"])
    return consistent_text(entries, ["src", "item_id"], "text", read_table(spark, folder, "glossary"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that come out in more than one piece."""
    pieces = split_oversized(chunks_with_strategy(spark, folder), CHUNK, "content", "max_chunk_size", "overlap_size")
    return pieces.where("n_pieces > 1 AND piece_no = 1").select(*CHUNK).distinct()


def p6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk in pieces within its limit."""
    chunks = one_of_each(chunks_with_strategy(spark, folder), CHUNK)
    return split_oversized(chunks, CHUNK, "content", "max_chunk_size", "overlap_size")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return token_ids(spread(read_table(spark, folder, "documents")), ["doc_id"], "text", VOCABULARY)


def mixed_documents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The mix of documents by mix_targets, sized in tokens, and its shares."""
    documents, targets = spread(read_table(spark, folder, "documents")), read_table(spark, folder, "mix_targets")
    sized = token_counts(documents.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi"), ["doc_id", "source"], "text", VOCABULARY)
    return mix(sized, targets, "doc_id", "source", "n_tokens")


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the targets' sources with its number of copies."""
    return mixed_documents(spark, folder)[0].withColumnRenamed("doc", "doc_id")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The target and the actual share of each source."""
    return mixed_documents(spark, folder)[1]


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Maximal runs of positions shared with another document."""
    return shared_runs(spread(read_table(spark, folder, "documents")), "doc_id", "text", 200)


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Of every document, how many of its code points are shared, and their share of the text (null for an empty text)."""
    shared = p9_found(spark, folder).groupBy("doc_id").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("n_shared"))
    sizes = spread(read_table(spark, folder, "documents")).select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_points"))
    n = F.coalesce("n_shared", F.lit(0))
    return sizes.join(shared, "doc_id", "left").select("doc_id", "n_points", n.alias("n_shared"), (n / F.nullif("n_points", F.lit(0))).alias("share"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_sentences": p1_sentences,
        "p2_found": p2_found,
        "p2_statistics": p2_statistics,
        "p2_words": p2_words,
        "p3_found": p3_found,
        "p3_paragraphs": p3_paragraphs,
        "p4_found": p4_found,
        "p4_pages": p4_pages,
        "p5_found": p5_found,
        "p5_text": p5_text,
        "p6_found": p6_found,
        "p6_pieces": p6_pieces,
        "p7_ids": p7_ids,
        "p8_mix": p8_mix,
        "p8_shares": p8_shares,
        "p9_found": p9_found,
        "p9_shares": p9_shares,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB statements for the queries that SQL can express."""
    return {
        "p2_words": """
            WITH t AS (
                SELECT doc_id, raw_text, regexp_extract_all(regexp_replace(raw_text, '([\\x{0E01}-\\x{0E30}\\x{0E32}\\x{0E33}\\x{0E40}-\\x{0E46}\\x{3005}\\x{3006}\\x{3041}-\\x{3096}\\x{309D}-\\x{309F}\\x{30A1}-\\x{30FA}\\x{30FC}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}]\\p{M}*)', ' \\1 ', 'g'), '\\p{L}[\\p{L}\\p{M}]*(?:[’''\\-‐‑]\\p{L}[\\p{L}\\p{M}]*)*') AS words,
                    regexp_replace(raw_text, '[\\s\\x{0B}\\x{85}\\p{Z}]', '', 'g') AS bare,
                    list_filter(string_split(raw_text, chr(10)), lambda x: length(regexp_replace(x, '[\\s\\x{0B}\\x{85}\\p{Z}]', '', 'g')) > 0) AS lines
                FROM extraction_results)
            SELECT DISTINCT doc_id, coalesce(len(words), 0)::BIGINT AS word_count,
                length(array_to_string(words, '')) / nullif(len(words), 0)::DOUBLE AS mean_word_length,
                length(regexp_replace(bare, '[\\p{L}\\p{M}\\p{N}]', '', 'g')) / nullif(length(bare), 0)::DOUBLE AS symbol_ratio,
                len(list_filter(lines, lambda x: regexp_matches(x, '[.!?…。！？．।॥؟][\"''”’»“)\\]」』）】›\\[0-9¹²³†‡*※]{0,3}[\\s\\x{0B}\\x{85}\\p{Z}]*$'))) / nullif(len(lines), 0)::DOUBLE AS end_punctuation_share
            FROM t""",
        "p6_found": """
            SELECT DISTINCT c.doc_id, c.chunk_id
            FROM chunks c JOIN chunking_strategies s ON s.strategy_id = coalesce(c.strategy_id, 1)
            WHERE length(c.content) > s.max_chunk_size""",
    }
