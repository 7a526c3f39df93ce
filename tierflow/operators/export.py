"""What one run has to hand over: the rows of each published table that its batches touch."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.operators.conform import BATCH, PASSED
from tierflow.operators.skew import HOT_ROWS, SMALL_ROWS, semi_join
from tierflow.plans.spec import TableSpec


def run_batches(metrics: DataFrame, rundate: str, spec: TableSpec) -> DataFrame:
    """Distinct batch ids that a run loaded into a table."""
    return (
        metrics.where(
            (F.col("rundate") == rundate)
            & (F.col("catalog_name") == spec.catalog_name)
            & (F.col("schema_name") == spec.schema_name)
            & (F.col("table_name") == spec.table_name)
        )
        .select("batch_id")
        .distinct()
    )


def of_batches(
    df: DataFrame, batches: DataFrame, batch_col: str = BATCH, small_rows: int = SMALL_ROWS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Rows of the given batches; with a table partitioned by batch only their files are read."""
    members = batches.select(F.col("batch_id").alias(batch_col))
    return semi_join(df, members, batch_col, small_rows, hot_rows)


def visitor_differential(
    visitor: DataFrame, audited: DataFrame, batches: DataFrame, key: str | Sequence[str], batch_col: str = BATCH
) -> DataFrame:
    """Summary rows of every key in the run's batches, whether its rows passed or not.

    The keys are made distinct before the join, so both sides hold each key once.
    """
    keys = [key] if isinstance(key, str) else list(key)
    touched = of_batches(audited.select(*keys, batch_col), batches, batch_col).select(*keys).distinct()
    if len(keys) == 1:
        return visitor.join(touched, keys, "left_semi")
    # A part of a composite key may be NULL.
    touched = touched.toDF(*[f"_k{i}" for i in range(len(keys))])
    return visitor.join(touched, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left_semi")


def statistic_differential(
    audited: DataFrame,
    batches: DataFrame,
    columns: Sequence[str],
    batch_col: str = BATCH,
    passed_col: str = PASSED,
) -> DataFrame:
    """Passed rows of the run's batches, published columns and batch only."""
    return of_batches(audited.where(F.col(passed_col)), batches, batch_col).select(*columns, batch_col)


def events_differential(events: DataFrame, batches: DataFrame, tables: Iterable[str] | None = None) -> DataFrame:
    """Error events of the run's batches, of all tables unless some are named."""
    wanted = events if tables is None else events.where(F.col("table_name").isin(*tables))
    return of_batches(wanted, batches, "batch_id").select(*events.columns)


def members(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    """Rows whose column is in a short literal list."""
    return df.where(F.col(column).isin(*values))
