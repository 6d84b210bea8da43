"""Helpers on column lists shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed(df: DataFrame, keys: Sequence[str], outputs: Sequence[str], **inputs: str) -> tuple[DataFrame, list[str]]:
    """Narrow `df` to its keys and the named inputs, so that no other column can clash.

    `inputs` maps an internal name to a column of `df`. A key that bears the
    name of an output column is passed on as `<key>_key`. Returns the narrowed
    frame and the names its keys now have.
    """
    names = [f"{k}_key" if k in outputs or k in inputs else k for k in keys]
    cols = [df[k].alias(n) for k, n in zip(keys, names)]
    return df.select(*cols, *(df[c].alias(n) for n, c in inputs.items())), names


def text_or_empty(col: Column | str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Numbers that one fold adds up.
BLOCK = 64


def starts_of(sizes: Column) -> Column:
    """For each of an array of sizes the sum of those before it, added up in blocks, so that long arrays don't cost their square."""

    def in_blocks(values: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, BLOCK))
        total = lambda x: F.aggregate(x, F.lit(0), lambda a, n: a + n)
        bases = lambda bl: let(F.transform(bl, total), lambda sums: F.transform(sums, lambda _, k: total(F.slice(sums, F.lit(1), k))))
        inner = lambda block, base: F.transform(block, lambda _, k: base + total(F.slice(block, F.lit(1), k)))
        return let(blocks, lambda bl: F.flatten(F.zip_with(bl, bases(bl), inner)))

    return F.when(F.size(sizes) > 0, let(sizes, in_blocks)).otherwise(F.array().cast("array<int>"))


def match_starts(text: Column, pattern: Column, found: Column) -> Column:
    """The offsets of the matches `found` of `pattern`: the text between them is measured, so no UDF is needed."""
    between = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda n, m: n + F.length(m))
    return let(F.struct(between.alias("b"), starts_of(sizes).alias("s")), lambda x: F.zip_with(F.slice(x["b"], F.lit(1), F.size(found)), x["s"], lambda n, at: n + at))
