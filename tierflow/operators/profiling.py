"""Column profile: value frequencies of many columns in one job, and what follows from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, value, n): how often each value occurs, NULL included, values as text.

    Columns are turned into rows and counted per task before the shuffle, so a frequent value
    travels as one partial count.
    """
    columns = list(columns or df.columns)
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return text.unpivot([], columns, "column_name", "value").groupBy("column_name", "value").agg(F.count("*").alias("n"))


def column_summary(counts: DataFrame) -> DataFrame:
    """Rows and distinct values per column (NULL counts as one value), from value counts."""
    return counts.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"),
        F.count("*").alias("n_distinct"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
    )


def key_summary(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows and distinct keys, as a whole or per group such as the file (NULL counts as a key)."""
    per_key = df.groupBy(*by, key).agg(F.count("*").alias("_n"))
    return per_key.groupBy(*by).agg(F.sum("_n").alias("n_rows"), F.count("*").alias("n_distinct"))


def approximate_key_summary(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Like `key_summary` with an estimated distinct count; shuffles sketches instead of keys."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        (F.approx_count_distinct(key) + F.max(F.col(key).isNull().cast("int"))).alias("n_distinct"),
    )


def key_frequencies(df: DataFrame, key: str, counted: str) -> DataFrame:
    """Non-null values of `counted` per key; sort it with `most_frequent`."""
    return df.dropna(subset=[key]).groupBy(key).agg(F.count(counted).alias("n"))


def most_frequent(frequencies: DataFrame, key: str) -> DataFrame:
    return frequencies.orderBy(F.desc("n"), F.asc(key))


def frequency_of_frequencies(frequencies: DataFrame) -> DataFrame:
    """How many keys occur n times."""
    return frequencies.groupBy("n").agg(F.count("*").alias("n_keys"))


# Sketches: 2^14 registers estimate distinct values with a standard error of 0.8 percent; a quantile
# sketch of this size is off by less than 1.7 percent of the rows' ranks, merged or not.
DISTINCT_LOG_K, QUANTILE_K = 14, 200


def profile_sketches(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """What each group of rows (a batch, a file) brings to the profile: a row per group and column.

    Holds counts, the least and greatest value as text, a sketch of the distinct values, and one of
    the quantiles of numbers. Rows like these, stored per batch, are merged by `merged_profile`
    over any batches: new batches are profiled alone. Columns are aggregated side by side in one
    pass; a group's sketches are partial before the shuffle and of bounded size.
    """
    columns = list(columns or [c for c in df.columns if c not in by])
    numbers = {c for c, kind in df.dtypes if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")}

    def sketched(c: str) -> Column:
        text = F.col(c).cast("string")
        number = F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(QUANTILE_K)) if c in numbers else F.lit(None).cast("binary")
        return F.struct(
            F.lit(c).alias("column_name"),
            F.count("*").alias("n_rows"),
            F.count_if(F.col(c).isNull()).alias("n_null"),
            F.min(text).alias("least"),
            F.max(text).alias("greatest"),
            F.hll_sketch_agg(text, DISTINCT_LOG_K).alias("distinct_sketch"),
            number.alias("quantile_sketch"),
        )

    rows = df.groupBy(*by).agg(F.array(*[sketched(c) for c in columns]).alias("profile"))
    return rows.select(*by, F.explode("profile").alias("p")).select(*by, "p.*")


def merged_profile(sketches: DataFrame, quantiles: Sequence[float] = (0.5,)) -> DataFrame:
    """The profile of all rows that went into the sketches: a row per column.

    `n_distinct` (without NULL) and `quantiles` are estimates, the rest is exact. Quantiles of
    columns without numbers are NULL.
    """
    ranks = F.array(*[F.lit(float(q)) for q in quantiles])
    merged = sketches.groupBy("column_name").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_null").alias("n_null"),
        F.min("least").alias("least"),
        F.max("greatest").alias("greatest"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("n_distinct"),
        F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
    )
    any_number = F.kll_sketch_get_n_double("quantile_sketch") > 0
    found = F.when(any_number, F.kll_sketch_get_quantile_double("quantile_sketch", ranks))
    return merged.select("column_name", "n_rows", "n_null", "least", "greatest", "n_distinct", found.alias("quantiles"))
