"""The text of pages as settings ask for it: switches and thresholds decide the plan when it is built."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators import layout as L
from leafmill.operators import textops as X
from leafmill.settings import Settings


def kept_words(words: DataFrame, settings: Settings) -> DataFrame:
    """The words that the settings' filters leave: all, those of the metadata filter, or those within the legacy margins that aren't numbers."""
    if not settings.remove_headers:
        return words
    if settings.legacy_margins:
        inside = F.col("top").between(settings.top_margin * F.col("page_height"), (1 - settings.bottom_margin) * F.col("page_height"))
        number = F.col("text").rlike(r"^\d+$") & F.lit(settings.remove_page_numbers)
        return L.sized(words, None).where(inside & ~number).drop("width", "page_height")
    repeated = L.repeating_zones(L.zone_strings(words, None), words)
    return L.metadata_filter(words, None, repeated, settings.remove_page_numbers).where("keep").drop("keep", "rule")


def page_texts(words: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, page, page_text of the words that are kept, repaired as far as the settings say."""
    lined = L.lines(L.columns(kept_words(words, settings), settings.column_gap), settings.line_gap)
    texts = L.page_texts(L.line_texts(lined))
    text = F.col("page_text")
    if settings.fix_spacing:
        text = X.fix_spacing(text)
    if settings.fix_punctuation:
        text = X.fix_punctuation(text)
    return texts.withColumn("page_text", text)
