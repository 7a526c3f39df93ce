"""The error-event log: one row per failing field, identified by a hash of what failed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.functions.hashing import hash_key
from tierflow.functions.types import record

# Parts of an event id in their hashed order, and the state of a new event.
EVENT_ID_PARTS = [
    "catalog_name",
    "schema_name",
    "table_name",
    "column_name",
    "batch_id",
    "record_identifier",
    "screen_code",
]
UNRESOLVED = "Sin Resolver"

EVENT_SCHEMA = record(
    error_event_id="string",
    batch_id="string",
    screen_code="string",
    catalog_name="string",
    schema_name="string",
    table_name="string",
    column_name="string",
    record_identifier="string",
    original_value="string",
    replaced_value="string",
    error_condition="string",
)


def error_events(failures: DataFrame, batch: str, catalog_name: str, schema_name: str, table_name: str) -> DataFrame:
    """Failures of one table as event rows, one per event id.

    Failures that share an id (same field, record, batch and screen) collapse to the one with
    the smallest original value. They combine before the shuffle, so copies cost nothing.
    """
    named = failures.withColumnRenamed(batch, "batch_id").withColumns(
        {
            "batch_id": F.col("batch_id").cast("string"),
            "catalog_name": F.lit(catalog_name),
            "schema_name": F.lit(schema_name),
            "table_name": F.lit(table_name),
        }
    )
    identified = named.withColumn("error_event_id", hash_key(EVENT_ID_PARTS))
    smallest = F.min(F.struct("original_value", "record_identifier", "batch_id", "column_name", "screen_code"))
    return (
        identified.groupBy("error_event_id")
        .agg(smallest.alias("e"))
        .select(
            "error_event_id",
            "e.*",
            F.lit(catalog_name).alias("catalog_name"),
            F.lit(schema_name).alias("schema_name"),
            F.lit(table_name).alias("table_name"),
            F.lit(None).cast("string").alias("replaced_value"),
            F.lit(UNRESOLVED).alias("error_condition"),
        )
        .select(*EVENT_SCHEMA.names)
    )
