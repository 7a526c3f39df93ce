"""Upsert as a query: the next state of a keyed table from its current state and a source."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _any_null(columns: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def _one_per_key(source: DataFrame, keys: Sequence[str], allow_null_keys: bool) -> DataFrame:
    """(keys, _s, _n): the source row as a struct. A repeated or NULL key fails the job.

    Copies combine before the shuffle, and the result is already partitioned for the join, so
    the check adds no exchange and a repeated key cannot pile up in one task.
    """
    others = [c for c in source.columns if c not in keys]
    packed = F.struct(*others) if others else F.struct(F.lit(1).alias("_none"))
    grouped = source.groupBy(*keys).agg(F.any_value(packed).alias("_s"), F.count("*").alias("_n"))
    checks = []
    if not allow_null_keys:
        empty = F.raise_error(F.lit(f"NULL in a key column of the source: {', '.join(keys)}"))
        checks.append((_any_null(keys), empty))
    repeated = F.raise_error(F.concat(F.lit("Several source rows for one key: "), F.to_json(F.struct(*keys))))
    checks.append((F.col("_n") > 1, repeated))
    # Kept as a filter: a projected check could be pruned away together with its column.
    valid = F.lit(True)
    for broken, error in reversed(checks):
        valid = F.when(broken, error.cast("boolean")).otherwise(valid)
    return grouped.where(valid)


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update_columns: Sequence[str] | None = None,
    created_col: str | None = None,
    updated_col: str | None = None,
    at: datetime | str | None = None,
    allow_null_keys: bool = False,
    replace_null_keys: bool = False,
) -> DataFrame:
    """`target` after updating matched rows from `source` and inserting the others.

    A source value wins even when it is NULL. `update_columns` limits what an update changes
    (inserts always take the whole row). `created_col` is set on insert and `updated_col` on
    update, to `at`; each is left alone otherwise. The target holds each key at most once, the
    source must too. With `allow_null_keys`, source rows with a NULL key match nothing and are
    inserted; with `replace_null_keys` as well, they take the place of the target's rows with a
    NULL key, so that merging the same source again changes nothing.
    """
    keys = list(keys)
    extra = [c for c in source.columns if c not in target.columns]
    if extra:
        raise ValueError(f"Source columns not in the target: {', '.join(extra)}")
    unmatched = []
    if allow_null_keys:
        unmatched = [target.where(_any_null(keys)), source.where(_any_null(keys))]
        target, source = target.where(~_any_null(keys)), source.where(~_any_null(keys))

    given = set(source.columns) - set(keys)
    updated = given if update_columns is None else set(update_columns) & given
    stamp = F.lit(at).cast("timestamp")

    def inserted_value(name: str) -> Column:
        if name == created_col:
            return stamp
        return F.col(f"_s.{name}") if name in given else F.lit(None)

    def updated_value(name: str) -> Column:
        if name == updated_col:
            return stamp
        if name == created_col or name not in updated:
            return F.col(name)
        return F.col(f"_s.{name}")

    in_source, in_target = F.col("_n").isNotNull(), F.col("_t").isNotNull()
    joined = target.withColumn("_t", F.lit(True)).join(
        _one_per_key(source, keys, allow_null_keys), keys, "full"
    )
    types = dict(target.dtypes)
    result = joined.select(
        *[
            F.col(c)
            if c in keys
            else F.when(~in_source, F.col(c))
            .when(in_target, updated_value(c))
            .otherwise(inserted_value(c))
            .cast(types[c])
            .alias(c)
            for c in target.columns
        ]
    )
    if unmatched:
        old, new = unmatched
        added = new.select(
            *[
                (stamp if c == created_col else F.col(c) if c in new.columns else F.lit(None)).cast(types[c]).alias(c)
                for c in target.columns
            ]
        )
        result = result.unionByName(added if replace_null_keys else old.unionByName(added))
    return result
