"""Integer surrogate keys for small dimensions, looked up or assigned for many rows at once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tierflow.functions.hashing import hash_key
from tierflow.session import materialize
from tierflow.operators.skew import HOT_ROWS, SMALL_ROWS, lookup_join

# New keys are numbered in this many parts by hash prefix (three hex digits).
PREFIX_DIGITS = 3


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def require_base_values(df: DataFrame, base: Sequence[str]) -> DataFrame:
    """`df`, failing the job at a NULL or blank base value. No extra scan."""
    blank = reduce(lambda a, b: a | b, [F.coalesce(F.trim(_text(c)), F.lit("")) == "" for c in base])
    error = F.raise_error(F.lit(f"Key part without a value: {', '.join(base)}")).cast("boolean")
    return df.where(F.when(blank, error).otherwise(F.lit(True)))


def _by_base(dimension: DataFrame, base: Sequence[str]) -> DataFrame:
    """(_b0..., _id, _n): one row per base value combination of a dimension, values as text."""
    return dimension.select("_id", *[_text(c).alias(f"_b{i}") for i, c in enumerate(base)]).groupBy(
        *[f"_b{i}" for i in range(len(base))]
    ).agg(F.min("_id").alias("_id"), F.count("*").alias("_n"))


def _single_id(id_type: T.DataType, base: Sequence[str]) -> Column:
    """The id found by a lookup; a combination that the dimension holds twice fails the job."""
    error = F.raise_error(F.lit(f"The dimension holds a key more than once: {', '.join(base)}"))
    return F.when(F.col("_n") > 1, error.cast(id_type)).otherwise(F.col("_id"))


def lookup_ids(
    df: DataFrame,
    dimension: DataFrame,
    base: Sequence[str],
    id_column: str,
    required: bool = False,
    hot_rows: int = HOT_ROWS,
    small_rows: int = SMALL_ROWS,
) -> DataFrame:
    """`df` with the dimension's id for its base values (compared trimmed, as text), else NULL.

    With `required`, a combination that the dimension does not hold fails the job.
    """
    base = list(base)
    keys = [f"_b{i}" for i in range(len(base))]
    valid = require_base_values(df, base).withColumns({k: F.trim(_text(c)) for k, c in zip(keys, base)})
    ids = _by_base(dimension.withColumn("_id", F.col(id_column)), base)
    found = lookup_join(valid, ids, keys, "left", hot_rows, small_rows=small_rows)
    value = _single_id(dimension.schema[id_column].dataType, base)
    if required:
        error = F.raise_error(F.concat(F.lit(f"No {id_column} for "), F.to_json(F.struct(*base))))
        value = F.coalesce(value, error.cast(dimension.schema[id_column].dataType))
    return found.select(*df.columns, value.alias(id_column))


def max_value(df: DataFrame, column: str) -> DataFrame:
    """One row with the largest value of a column."""
    return df.agg(F.max(column).alias("max_value"))


def assign_ids(
    df: DataFrame,
    dimension: DataFrame,
    base: Sequence[str],
    id_column: str,
    group: Column | None = None,
    order: Sequence[str | Column] | None = None,
) -> DataFrame:
    """(base..., id, is_new): the id of every distinct base value combination in `df`.

    Known combinations keep their id; new ones get the next free numbers, without gaps. Rows
    are numbered within groups (by default a hash prefix, so the work is spread) in the given
    order, and each group starts where the one before ends; only one row per group passes
    through a single task. A group of one's own must be small enough for one task.
    """
    base = list(base)
    carried = [c for c in df.columns if c not in base] if order or group is not None else []
    trimmed = require_base_values(df, base).withColumns({c: F.trim(_text(c)) for c in base})
    if carried:
        distinct = trimmed.groupBy(*base).agg(*[F.min(c).alias(c) for c in carried])
    else:
        distinct = trimmed.select(*base).distinct()
    known = _by_base(dimension.withColumn("_id", F.col(id_column)), base)
    known = known.withColumnsRenamed({f"_b{i}": c for i, c in enumerate(base)})
    prefix = F.substring(hash_key(base), 1, PREFIX_DIGITS)
    matched = distinct.join(known, base, "left").withColumns(
        {"is_new": F.col("_id").isNull(), "_group": prefix if group is None else group}
    )
    # Read twice below, for the ranks and for the sizes of the groups.
    matched = materialize(matched, "key-values")
    # Only new values are ranked; known ones, as a rule the most, are not sorted.
    in_group = Window.partitionBy("_group").orderBy(*(order or base))
    ranked = matched.where("is_new").withColumn("_rank", F.row_number().over(in_group))
    numbered = ranked.unionByName(matched.where("NOT is_new").withColumn("_rank", F.lit(None).cast("int")))
    # One row per group: the running total needs a single task, whatever the number of new keys.
    sizes = matched.where("is_new").groupBy("_group").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_group", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    id_type = dimension.schema[id_column].dataType
    highest = F.coalesce(max_value(dimension, id_column).scalar(), F.lit(0))
    next_id = (highest + F.col("_offset") + F.col("_rank")).cast(id_type)
    known_id = _single_id(id_type, base)
    return numbered.join(offsets, "_group", "left").select(
        *base, F.coalesce(known_id, next_id).alias(id_column), "is_new"
    )
