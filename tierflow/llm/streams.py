"""Sorted rows as streams: partitions that are read batch by batch, never gathered."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dealt(rows: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """Rows of one key in one partition, in order. Sorting spills, so a key may have any number of rows."""
    return rows.repartition(F.col(key)).sortWithinPartitions(key, *order)


def runs(keys: pa.Array) -> list[tuple[int, int]]:
    """Begin and end of each run of equal keys (none is NULL)."""
    if not len(keys):
        return []
    changes = pc.not_equal(keys[1:], keys[:-1])
    borders = (np.flatnonzero(changes.to_numpy(zero_copy_only=False)) + 1).tolist()
    return list(zip([0, *borders], [*borders, len(keys)], strict=True))


def turn_order(columns: Sequence[str]) -> list[Column]:
    """Ascending, NULL first."""
    return [F.col(c).asc_nulls_first() for c in columns]


def record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema)
