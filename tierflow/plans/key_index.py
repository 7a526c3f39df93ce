"""Unique keys across batches: an index of every key and the batch that first delivered it.

The index is a table kept by key. A batch is held against the parts of it that its keys fall into,
bucket by bucket, so what earlier batches delivered is not read again and not shuffled. The keys
of the batch are reduced to one row each before they meet the index, so a key that fills a batch
is no burden either.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierflow.operators.skew import HOT_ROWS, SMALL_ROWS, lookup_join
from tierflow.session import materialize
from tierflow.sources.tables import KEY_PART, Tables

FIRST_BATCH = "first_batch"


@dataclass(frozen=True)
class KeyIndex:
    """The index `name` of the columns `key`. Keys with a NULL part are not unique and not indexed."""

    tables: Tables
    name: str
    key: Sequence[str]

    def create(self, schema: T.StructType, parts: int = 64, buckets: int = 64) -> None:
        fields = [schema[k] for k in self.key]
        self.tables.create_keyed(self.name, T.StructType([*fields, T.StructField(FIRST_BATCH, T.StringType())]), self.key, parts, buckets)

    def _keys(self, rows: DataFrame, batch: str) -> DataFrame:
        """One row per key of `rows`, with the least of its batches."""
        return rows.dropna(subset=list(self.key)).groupBy(*self.key).agg(F.min(F.col(batch).cast("string")).alias(FIRST_BATCH))

    def repeats(self, rows: DataFrame, batch: str, hot_rows: int = HOT_ROWS, small_rows: int = SMALL_ROWS) -> DataFrame:
        """The rows whose key another batch delivered first, with that batch as `first_batch`."""
        keys = rows.dropna(subset=list(self.key)).select(*self.key).distinct()
        touched = self.tables.touched_parts(self.name, keys, self.key)
        known = self.tables.read(self.name).where(F.col(KEY_PART).isin(touched)).drop(KEY_PART)
        buckets = self.tables.key_layout(self.name)[1]
        found = materialize(known.join(keys.repartition(buckets, *self.key), list(self.key)), "known-keys")
        joined = lookup_join(rows, found, self.key, "inner", hot_rows, small_rows=small_rows)
        return joined.where(F.col(FIRST_BATCH) != F.col(batch).cast("string"))

    def add(self, rows: DataFrame, batch: str) -> None:
        """Enter the keys of `rows`; a known key keeps its batch, so adding a batch again changes nothing."""
        self.tables.merge(self.name, self._keys(rows, batch), self.key, update_columns=[])
