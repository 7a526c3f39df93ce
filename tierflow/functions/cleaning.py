"""Cleaning expressions for delimited text fields; all built-in, so code generation holds."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Hook = Callable[[DataFrame], DataFrame]

# Markers for "no value" in the delivered reports.
UNKNOWN_TOKENS = ("unknown",)
NULL_MARKERS = ("-", "")


def strip_tokens(column: Column, tokens: Iterable[str] = UNKNOWN_TOKENS) -> Column:
    """Remove every occurrence of each token (plain substring, case-sensitive)."""
    for token in tokens:
        column = F.replace(column, F.lit(token), F.lit(""))
    return column


def null_markers(column: Column, markers: Iterable[str] = NULL_MARKERS) -> Column:
    """NULL where the whole value is one of the markers."""
    return F.when(~column.isin(*markers), column)


def clean_text(
    column: Column,
    tokens: Iterable[str] = UNKNOWN_TOKENS,
    markers: Iterable[str] = NULL_MARKERS,
) -> Column:
    """Token removal first, then markers: a value made of tokens alone ends as NULL."""
    return null_markers(strip_tokens(column, tokens), markers)


def list_to_json(column: Column, separator: str = ",") -> Column:
    """Separated list to JSON-array text, without empty elements. NULL stays NULL."""
    parts = F.split(column, f"\\Q{separator}\\E")
    return F.to_json(F.filter(parts, lambda item: item != ""))


def cleaning_hook(
    clean: Iterable[str],
    lists: Iterable[str] = (),
    tokens: Iterable[str] = UNKNOWN_TOKENS,
    markers: Iterable[str] = NULL_MARKERS,
) -> Hook:
    """A preprocessing hook: clean some columns, then turn some of them into JSON arrays.

    Any `DataFrame -> DataFrame` callable can stand in its place.
    """
    clean, lists = list(clean), list(lists)

    def value(name: str) -> Column:
        column = F.col(name)
        if name in clean:
            column = clean_text(column, tokens, markers)
        return list_to_json(column) if name in lists else column

    def hook(df: DataFrame) -> DataFrame:
        return df.withColumns({name: value(name) for name in dict.fromkeys(clean + lists)})

    return hook
