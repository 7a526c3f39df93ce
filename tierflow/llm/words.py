"""Expressions on words, lines and arrays that the operators without Python code share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A word: characters other than space and the control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def aside(df: DataFrame) -> list[Column]:
    """All columns under names that clash with none (`_c0`, `_c1`, ...), to be carried along."""
    return [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(df.columns)]


def back(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """The columns carried along, by their names again."""
    return [df[f"_c{i}"].alias(c) for i, c in enumerate(names)]


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running_sums(values: Column, chunk: int = 256) -> Column:
    """Sum of all values before each one. In chunks, since an array that grows is copied at each step."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)

    def sums(a: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("all"))
        step = lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["all"], F.array(s["sum"])).alias("all"))
        return F.aggregate(a, start, step)["all"]

    def joined(chunks: Column) -> Column:
        before = sums(F.transform(chunks, total))
        parts = F.zip_with(chunks, before, lambda c, s: F.transform(sums(c), lambda x: x + s))
        return F.flatten(parts)

    def chunked(a: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), F.lit(chunk))
        return F.transform(starts, lambda at: F.slice(a, at, chunk))

    return let(values.cast("array<bigint>"), lambda a: let(chunked(a), joined))
