"""Hashed keys: computed from the row alone, so no lookup and no shuffle."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: separator between the hashed parts; stored ids depend on it.
HASH_SEPARATOR = "||"


def hash_key(columns: Iterable[str | Column]) -> Column:
    """md5 over the parts in the given order; a NULL part counts as empty text."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws(HASH_SEPARATOR, *parts))
