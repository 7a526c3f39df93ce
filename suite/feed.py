"""Inputs of the query list: the driver's tables, and a visit feed with faults derived from them.

The feed turns every row of `events` into a report line and spoils some fields by a fixed rule,
in the same way on both engines; no row is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tierflow.plans.spec import ColumnSpec, TableSpec
from tierflow.functions.cleaning import cleaning_hook
from tierflow.session import configure

_FEED = """
SELECT event_id,
  CASE WHEN event_id % 211 = 0 THEN NULL
       WHEN event_id % 53 = 0 THEN concat('user', user_id, '.example.com')
       ELSE concat('user', user_id, '@example.com') END AS email,
  {batch} AS batch_id,
  CASE WHEN event_id % 89 = 0 THEN NULL WHEN event_id % 97 = 0 THEN {iso} ELSE {day_first} END AS fechaenvio,
  event_type AS baja,
  CAST(floor(value) AS INT) AS opens,
  CASE event_id % 7 WHEN 0 THEN '-' WHEN 1 THEN 'unknown' WHEN 2 THEN concat(event_type, ',,unknown')
       WHEN 3 THEN '' ELSE concat(event_type, ',', user_id) END AS links
FROM events
"""
SPARK_FEED = _FEED.format(
    batch="date_format(ts,'yyyyMMddHH')",
    iso="date_format(ts,'yyyy-MM-dd HH:mm')",
    day_first="date_format(ts,'dd/MM/yyyy HH:mm')",
).replace("FROM events", "FROM {events}")
DUCKDB_FEED = _FEED.format(
    batch="strftime(ts,'%Y%m%d%H')",
    iso="strftime(ts,'%Y-%m-%d %H:%M')",
    day_first="strftime(ts,'%d/%m/%Y %H:%M')",
)

BATCH = "batch_id"
DATE_PATTERN = "dd/MM/yyyy HH:mm"
CATALOG, SCHEMA = "domain_dev", "silver_analytics"
RUNDATE = "20240117_000000"
LOADED_AT = "2024-02-01 00:00:00"
ALLOWED = "click,view,purchase,signup"

RAW = TableSpec(
    CATALOG,
    "bronze_analytics",
    "raw_visits",
    etl_module="visits__load",
    quality="bronze",
    aliases={"jk": "links", "fgh": "links"},
    columns=(
        ColumnSpec("event_id", "long", is_nullable=False),
        ColumnSpec("email", is_primary_key=True, is_pii=True, comment="Visitor"),
        ColumnSpec("fechaenvio", comment="Time of the report line"),
        ColumnSpec("baja", comment="Kind of visit"),
        ColumnSpec("opens", "integer", comment="Number of opens"),
        ColumnSpec("links", comment="Visited links"),
    ),
)
AUDIT = TableSpec(
    CATALOG,
    SCHEMA,
    "audit_visits",
    etl_module="visits__audit",
    write_mode="merge_incremental",
    quality="silver",
    columns=(
        ColumnSpec("event_id", "long"),
        ColumnSpec(
            "Email",
            rename_from="email",
            is_primary_key=True,
            validations=({"validation": "is_not_null"}, {"validation": "is_email_format"}),
        ),
        ColumnSpec(
            "FechaEnvio",
            "timestamp",
            rename_from="fechaenvio",
            validations=({"validation": "is_date_format", "format": DATE_PATTERN},),
        ),
        ColumnSpec("Baja", rename_from="baja", validations=({"validation": "is_in_list", "allowed": ALLOWED},)),
        ColumnSpec(
            "Opens",
            "integer",
            rename_from="opens",
            validations=({"validation": "is_in_bounds", "min_allowed": 0, "max_allowed": 100},),
        ),
        ColumnSpec("Links", rename_from="links"),
    ),
)
HOOK = cleaning_hook(clean=["Links"], lists=["Links"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The injected visit feed over all events."""
    return spark.sql(SPARK_FEED, events=table(spark, sf_dir, "events"))
