"""Ingestion metrics per table and batch, and the batch control that reads them."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.functions.types import record
from tierflow.plans.spec import TableSpec

METRIC_SCHEMA = record(
    table_id="integer",
    catalog_name="string",
    schema_name="string",
    table_name="string",
    rundate="string",
    batch_id="string",
    loaded_at="timestamp",
    etl_module="string",
    write_mode="string",
    initial_rows="long",
    final_rows="long",
    accumulated_rows="long",
    quality="string",
)
METRIC_KEY = ["catalog_name", "schema_name", "table_name", "batch_id"]
# Batch id in the metrics of a table that is maintained as a whole.
ALL_BATCHES = "all"


def row_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def ingestion_metrics(
    before: DataFrame,
    after: DataFrame,
    target: DataFrame,
    batch_col: str,
    spec: TableSpec,
    rundate: str,
    loaded_at: datetime | str,
    batches: Iterable[str] = (),
) -> DataFrame:
    """One row per batch: rows read, rows written, and rows in the table afterwards.

    `batches` are counted as well if they have no rows, so that an empty delivery is recorded.
    Both counts come from one aggregate, which carries one row per batch and task.
    """
    batch = F.col(batch_col).cast("string")
    seen = before.select(batch.alias("batch_id"), F.lit(True).alias("_read"))
    written = after.select(batch.alias("batch_id"), F.lit(False).alias("_read"))
    listed = target.sparkSession.createDataFrame([(b, None) for b in sorted(set(batches))], "batch_id string, _read boolean")
    counted = (
        seen.unionByName(written)
        .unionByName(listed)
        .groupBy("batch_id")
        .agg(
            F.count_if("_read").alias("initial_rows"),
            F.count_if(~F.col("_read")).alias("final_rows"),
        )
    )
    constants = {
        "table_id": F.lit(spec.table_id).cast("int"),
        "catalog_name": F.lit(spec.catalog_name),
        "schema_name": F.lit(spec.schema_name),
        "table_name": F.lit(spec.table_name),
        "rundate": F.lit(rundate),
        "loaded_at": F.lit(loaded_at).cast("timestamp"),
        "etl_module": F.lit(spec.etl_module),
        "write_mode": F.lit(spec.write_mode),
        "quality": F.lit(spec.quality),
        "accumulated_rows": row_counts(target).scalar(),
    }
    return counted.withColumns(constants).select(*METRIC_SCHEMA.names)


def table_metrics(
    spark: SparkSession, spec: TableSpec, rundate: str, loaded_at: datetime | str, initial_rows: int, final_rows: int
) -> DataFrame:
    """The single metrics row of a table that is maintained as a whole."""
    values = {
        "table_id": spec.table_id,
        "catalog_name": spec.catalog_name,
        "schema_name": spec.schema_name,
        "table_name": spec.table_name,
        "rundate": rundate,
        "batch_id": ALL_BATCHES,
        "loaded_at": None,
        "etl_module": spec.etl_module,
        "write_mode": spec.write_mode,
        "initial_rows": initial_rows,
        "final_rows": final_rows,
        "accumulated_rows": final_rows,
        "quality": spec.quality,
    }
    row = spark.createDataFrame([tuple(values[n] for n in METRIC_SCHEMA.names)], METRIC_SCHEMA)
    return row.withColumn("loaded_at", F.lit(loaded_at).cast("timestamp"))


def pending_batches(found: DataFrame, metrics: DataFrame, spec: TableSpec, batch_col: str = "batch_id") -> DataFrame:
    """Found batches that this table has no metrics for. Two metrics rows for a batch fail the job."""
    done = (
        metrics.where(
            (F.col("catalog_name") == spec.catalog_name)
            & (F.col("schema_name") == spec.schema_name)
            & (F.col("table_name") == spec.table_name)
        )
        .groupBy(F.col("batch_id").alias(batch_col))
        .agg(F.count("*").alias("_n"))
    )
    error = F.raise_error(F.concat(F.lit(f"Several metrics rows for {spec.name}, batch "), F.col(batch_col)))
    done = done.where(F.when(F.col("_n") > 1, error.cast("boolean")).otherwise(F.lit(True)))
    return found.join(done, batch_col, "left_anti")
