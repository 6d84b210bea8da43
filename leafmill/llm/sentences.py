"""Sentence units of texts in many scripts, in SQL expressions alone.

Marks that end nothing (in decimals, URLs, initials, abbreviations, numbered
headings, omissions and quotations that go on) are masked, one for one, with a
private-use placeholder; a cut sign is put behind each remaining terminator with
its closing quotes, brackets and footnote marks; the text is split at the cut
signs. As no mask changes a length, the units are then cut from the original
text by their offsets, which restores every masked character.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.columns import keyed, text_or_empty

MASK, CUT, FOREIGN = "", "", ""

# Abbreviations whose full stop never ends a sentence.
ABBREVIATIONS = "Dr|Dra|Prof|Sr|Sra|Mr|Mrs|Ms|Mme|Mlle|Nr|núm|Abb|vgl|cf|vs|bzw|ca|ggf|approx|aprox|env|al|p|pp|z|d|см|рис|стр|табл|डॉ|श्री|प्रो|St|Ste|Mt|Rev|Hon|Gen|Capt|Lt|Sgt|Gov|Sen|Messrs|Drs|Profs|Srta|Dipl|Ing|evtl|inkl|sog|viz|e[.]g|i[.]e|z[.]B|d[.]h|p[.]ej|гл|ул|проф|акад"
# Abbreviations that need a number behind them.
BEFORE_NUMBER = "No|Fig|Tab|Art|Vol|Abs|Ref|Eq|S|n|fig|no|г"
# German months, after an ordinal number.
MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
# Verbs that go on with a sentence after its quotation, also in capitals.
SPEECH = "asked|said|wrote|demande|demanda|écrit|fragte|schrieb|preguntó|escribió|спросил|спрашивает|пишет|पूछा"

CLOSERS = "[\"”’'»)\\]}›]|[ \\u00A0\\u202F]»|“(?=[\\s,.;]|$)"
CJK_CLOSERS = "[」』”’）)】〉》］\"]"
MARKS = "[*＊※]\\p{N}{1,3}|[¹²³⁰⁴-⁹]+|[†‡]+|\\[\\p{N}{1,3}\\]|注\\p{N}{1,2}|\\(\\*?\\p{N}{1,3}\\)|（\\p{N}{1,3}）"
BLANK = "[ \\t\\u00A0\\u202F\\u3000]"
WRAP = f"(?:{BLANK}+(?:\\n{BLANK}*)?|\\n{BLANK}*)"
NO_LETTER = "(?<![\\p{L}\\p{M}\\p{N}])"
THAI = "[\\u0E01-\\u0E5B]"
QUOTE_END = "[\"”’'»“›]"
ALL_BLANKS = " \t\n\r\x0b\f\u00a0\u202f\u2009\u3000\u200b\ufeff"

#: What keeps a terminator from ending a unit. Each begins with the terminator itself and looks
#: around from there, so that one pass over the text tries them at terminators only.
MASKS: list[str] = [
    # Decimals, section numbers, URLs, file names, and the inner stops of "i.e." and "p.m.".
    "[.](?<=[\\p{L}\\p{N}_][.])(?=[\\p{Ll}\\p{N}_])",
    "[.．](?<=\\p{N}[.．])(?=\\n?\\p{N})",
    # Initials.
    f"[.](?<={NO_LETTER}(?<!°)\\p{{Lu}}[.])(?={WRAP}?\\p{{Lu}})",
    # Abbreviations.
    f"[.](?<={NO_LETTER}(?iu:{ABBREVIATIONS})[.])(?={WRAP}?\\S)",
    f"[.](?<={NO_LETTER}(?:{BEFORE_NUMBER})[.])(?={WRAP}?[\\p{{N}}№])",
    # Ordinal days, numbered headings.
    f"[.](?<=\\p{{N}}[.])(?={WRAP}(?iu:{MONTHS}))",
    "[.](?<=(?:^|\\n)[ \\t]{0,8}\\p{N}{1,3}[.])(?=[ \\u3000\\u00A0]\\S)",
    # Omissions.
    "[.](?=[.])|[.](?<=[.][.])|…",
    # Quotations that the sentence goes on after.
    "[。．！？!?](?=[」』”’]{1,2}(?:と|って|[、，,]))",
    "[。．！？!?](?=[”’」』][^，。！？“”「」\\n]{0,12}(?:问|说|道|答|称)[，,：:])",
    f"[.!?](?=(?:{CLOSERS}){{1,3}}\\s?[,;:—–])",
    f"[.!?](?=[\\u00A0\\u202F ]?{QUOTE_END}{WRAP}(?:[—–]\\s?)?(?iu:{SPEECH}))",
    # A lower-case letter goes on with the sentence.
    f"[.!?](?=(?:{CLOSERS}|{MARKS}){{0,4}}{WRAP}\\p{{Ll}})",
]
MASKED = f"(?=[.．…。！？!?])(?:{'|'.join(MASKS)})"

#: What a cut sign is put behind.
CUTS: list[str] = [
    f"[。！？．｡]+(?:{CJK_CLOSERS})*(?:{MARKS})*",
    f"[.!?]+(?:{CLOSERS})*(?:{MARKS})*(?=\\s|$|\\p{{Lu}}|[“«„\"(¿¡‹\\[]|[\\p{{IsHan}}\\p{{IsHiragana}}\\p{{IsKatakana}}])",
    f"[।॥؟۔።։]+(?:{CLOSERS})*(?:{MARKS})*",
    "\\n(?=[ \\t\\r\\u00A0\\u3000]*\\n)",
    f"{THAI}(?=(?:{BLANK}+(?:\\n{BLANK}*)?|\\n{BLANK}+){THAI})",
]
CUT_AFTER = f"(?=[。！？．｡.!?।॥؟۔።։\\n\\u0E01-\\u0E5B])({'|'.join(CUTS)})"


def masked_text(text: Column) -> Column:
    """`text` with masks and cut signs; without its cut signs as long as `text`."""
    out = F.translate(text, MASK + CUT, FOREIGN * 2)
    return F.regexp_replace(F.regexp_replace(out, MASKED, MASK), CUT_AFTER, f"$1{CUT}")


def unit_spans(text: Column) -> Column:
    """array<struct<start_pos, end_pos>> of the sentence units of `text`, blanks at either end left out."""
    pieces = F.split(masked_text(text), CUT)
    measured = F.transform(
        pieces,
        lambda p: F.struct(
            F.length(p).alias("n"),
            (F.length(p) - F.length(F.ltrim(p, F.lit(ALL_BLANKS)))).alias("lead"),
            F.length(F.rtrim(p, F.lit(ALL_BLANKS))).alias("kept"),
        ),
    )
    return _let(measured, lambda m: F.when(F.size(m) <= BLOCK, _block_spans(m, F.lit(0))).otherwise(_blockwise(m)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blockwise(measured: Column) -> Column:
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(measured) - 1) / BLOCK).cast("int")), lambda b: F.slice(measured, b * BLOCK + 1, BLOCK))
    sizes = lambda bl: F.transform(bl, lambda b: F.aggregate(b, F.lit(0), lambda n, p: n + p["n"]))
    bases = lambda bl: F.aggregate(sizes(bl), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    return _let(blocks, lambda bl: F.flatten(F.zip_with(bl, F.slice(bases(bl), F.lit(1), F.size(bl)), _block_spans)))


#: Pieces whose offsets are summed in one fold. A fold copies its array at each step, so the pieces of a
#: long text are folded in blocks, and the blocks' begins in a fold of their own.
BLOCK = 256


def _block_spans(block: Column, base: Column) -> Column:
    """The spans of one block of measured pieces that begins at `base`."""
    start = F.struct(base.alias("at"), F.array().cast("array<struct<start_pos:int,end_pos:int>>").alias("spans"))
    return F.aggregate(
        block,
        start,
        lambda acc, p: F.struct(
            (acc["at"] + p["n"]).alias("at"),
            F.when(p["kept"] > 0, F.concat(acc["spans"], F.array(F.struct((acc["at"] + p["lead"]).alias("start_pos"), (acc["at"] + p["kept"]).alias("end_pos"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )


def sentences(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """The sentence units of every text: keys, sentence_no (from 1), start_pos, end_pos, sentence.

    Offsets count code points from 0, end_pos is exclusive; blanks around a unit
    belong to none, so units and the blanks between them hold the whole text.
    Null, empty and blank texts give no row. Repeated input rows give repeated
    output rows. Other columns of `df` are left out; a key named like an output
    is passed on as `<key>_key`. Texts of any length are taken whole.
    """
    out = ["sentence_no", "start_pos", "end_pos", "sentence"]
    narrow, names = keyed(df, keys, out, _text=text)
    spans = narrow.select(*names, "_text", F.posexplode(unit_spans(text_or_empty("_text"))).alias("_n", "_span"))
    return spans.select(
        *names,
        (F.col("_n") + 1).alias("sentence_no"),
        F.col("_span.start_pos").alias("start_pos"),
        F.col("_span.end_pos").alias("end_pos"),
        F.expr("substring(_text, _span.start_pos + 1, _span.end_pos - _span.start_pos)").alias("sentence"),
    )
