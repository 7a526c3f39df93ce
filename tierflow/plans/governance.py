"""Governance tables: which catalogs, schemas, tables and columns exist, and what was ingested."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.functions.types import record
from tierflow.operators.events import EVENT_SCHEMA
from tierflow.operators.keys import assign_ids, lookup_ids
from tierflow.operators.metrics import METRIC_SCHEMA
from tierflow.plans.spec import LAYERS, OPEN_END, TableSpec, layer_attributes, resolve_layers, table_spec
from tierflow.session import materialize
from tierflow.sources.tables import Tables

GOVERNANCE = "governance_prod"
CATALOGS = f"{GOVERNANCE}.metadata.catalogs"
SCHEMAS = f"{GOVERNANCE}.metadata.schemas"
TABLES = f"{GOVERNANCE}.metadata.tables"
DETAILS = f"{GOVERNANCE}.metadata.tables_detail"
INGESTIONS = f"{GOVERNANCE}.metrics.ingestions"
EVENT_ERRORS = f"{GOVERNANCE}.metrics.event_errors"
# Batch control of history tables, which the metrics count as a whole.
HISTORY_BATCHES = f"{GOVERNANCE}.metrics.history_batches"

# The environments per domain, and the schemas of each kind of domain.
ENVIRONMENTS = {"governance": ["prod"], "domain": ["dev", "prod"]}
GOVERNANCE_SCHEMAS = ["metadata", "metrics"]
MEDALS = ["bronze", "silver", "gold"]

CATALOG_SCHEMA = record(
    catalog_id="integer",
    catalog_name="string",
    domain="string",
    environment="string",
    description="string",
    location="string",
    created_at="string",
    owner="string",
)
SCHEMA_SCHEMA = record(
    schema_id="integer",
    catalog_id="integer",
    schema_name="string",
    description="string",
    created_at="string",
    owner="string",
)
TABLE_SCHEMA = record(
    table_id="integer",
    schema_id="integer",
    table_name="string",
    etl_module="string",
    write_mode="string",
    quality="string",
    table_type="string",
    version="integer",
    current_flag="boolean",
    valid_from="timestamp",
    valid_to="timestamp",
    description="string",
    owner="string",
    retention_policy="string",
)
DETAIL_SCHEMA = record(
    table_id="integer",
    column_id="integer",
    column_name="string",
    rename_from="string",
    data_type="string",
    ordinal_position="integer",
    is_primary_key="boolean",
    is_nullable="boolean",
    is_partition="boolean",
    is_pii="boolean",
    validations="string",
    track_changes="boolean",
    comment="string",
)

HISTORY_BATCH_SCHEMA = record(
    catalog_name="string", schema_name="string", table_name="string", batch_id="string", rundate="string"
)

# New columns are numbered in groups of one table and this many positions.
COLUMNS_PER_GROUP = 1000

WRITE_MODES_USED = "How it is written: overwrite_partition, merge_incremental or historic"
MEDAL = "Layer: bronze, silver or gold"
NAMES = {
    "catalog_name": "Catalog, a domain and its environment",
    "schema_name": "Schema within the catalog",
    "table_name": "Table within the schema",
}
COMMENTS: dict[str, Mapping[str, str]] = {
    CATALOGS: {
        "catalog_id": "Catalog key",
        "catalog_name": "Domain and environment",
        "domain": "Business domain",
        "environment": "dev or prod",
        "description": "What the catalog is for",
        "location": "Where it is kept",
        "created_at": "When it was set up",
        "owner": "Who answers for it",
    },
    SCHEMAS: {
        "schema_id": "Schema key",
        "catalog_id": "Catalog the schema belongs to",
        "schema_name": "Schema within the catalog",
        "description": "What the schema holds",
        "created_at": "When it was set up",
        "owner": "Who answers for it",
    },
    TABLES: {
        "table_id": "Table key",
        "schema_id": "Schema the table belongs to",
        "table_name": "Table within the schema",
        "etl_module": "Module that fills the table",
        "write_mode": WRITE_MODES_USED,
        "quality": MEDAL,
        "table_type": "Kind of table",
        "version": "Number of this definition",
        "current_flag": "Whether this is the current entry",
        "valid_from": "When the entry came into force",
        "valid_to": "When it ends, far ahead while it is current",
        "description": "What the table holds",
        "owner": "Who answers for it",
        "retention_policy": "Whether rows are kept for good",
    },
    DETAILS: {
        "table_id": "Table the column belongs to",
        "column_id": "Column key",
        "column_name": "Column within the table",
        "rename_from": "Column name in the previous layer",
        "data_type": "Declared type",
        "ordinal_position": "Place in the table, from 1",
        "is_primary_key": "Whether it is part of the key",
        "is_nullable": "Whether it may be empty",
        "is_partition": "Whether the table is partitioned by it",
        "is_pii": "Whether it holds personal data",
        "validations": "Screens as JSON text",
        "track_changes": "Whether a change opens a new version",
        "comment": "What the column holds",
    },
    INGESTIONS: {
        "table_id": "Table key",
        **NAMES,
        "rundate": "Run that loaded the batch",
        "batch_id": "Batch, or all for a table kept as a whole",
        "loaded_at": "Load time of the run",
        "etl_module": "Module that fills the table",
        "write_mode": WRITE_MODES_USED,
        "initial_rows": "Rows read for the batch",
        "final_rows": "Rows written for the batch",
        "accumulated_rows": "Rows in the table after the run",
        "quality": MEDAL,
    },
    EVENT_ERRORS: {
        "error_event_id": "Hash of what failed",
        "batch_id": "Batch of the failing record",
        "screen_code": "Screen that failed",
        **NAMES,
        "column_name": "Column that failed",
        "record_identifier": "Key of the failing record",
        "original_value": "Value before it was set to NULL",
        "replaced_value": "Value put in its place",
        "error_condition": "State of the event",
    },
    HISTORY_BATCHES: {**NAMES, "batch_id": "Batch that the history holds", "rundate": "Run that applied it"},
}


def seed_rows(subdomain: str, owner: str, created_at: str, location: str) -> tuple[list[tuple], list[tuple]]:
    """Rows of the catalogs and of the schemas: governance, and each domain environment with its medals."""
    catalogs: list[tuple] = []
    schemas: list[tuple] = []
    for domain, environments in ENVIRONMENTS.items():
        for environment in environments:
            catalog_id = len(catalogs) + 1
            name = f"{domain}_{environment}"
            catalogs.append((catalog_id, name, domain, environment, f"{domain} data, {environment}", location, created_at, owner))
            names = GOVERNANCE_SCHEMAS if domain == "governance" else [f"{medal}_{subdomain}" for medal in MEDALS]
            for schema in names:
                schemas.append((len(schemas) + 1, catalog_id, schema, schema.replace("_", " "), created_at, owner))
    return catalogs, schemas


def init_governance(tables: Tables, subdomain: str, owner: str, created_at: str) -> None:
    """Create and seed the governance tables; catalogs and schemas are written anew."""
    catalogs, schemas = seed_rows(subdomain, owner, created_at, tables.root)
    spark = tables.spark
    tables.replace(spark.createDataFrame(catalogs, CATALOG_SCHEMA), CATALOGS)
    tables.replace(spark.createDataFrame(schemas, SCHEMA_SCHEMA), SCHEMAS)
    tables.create(TABLES, TABLE_SCHEMA, (), COMMENTS[TABLES])
    tables.create(DETAILS, DETAIL_SCHEMA, (), COMMENTS[DETAILS])
    tables.create(INGESTIONS, METRIC_SCHEMA, (), COMMENTS[INGESTIONS])
    tables.create(EVENT_ERRORS, EVENT_SCHEMA, ["batch_id"], COMMENTS[EVENT_ERRORS])
    tables.create(HISTORY_BATCHES, HISTORY_BATCH_SCHEMA, (), COMMENTS[HISTORY_BATCHES])
    for name in (CATALOGS, SCHEMAS):
        tables.comment(name, COMMENTS[name])


def reset(tables: Tables, names: list[str]) -> None:
    """Drop layer tables and empty the ingestion metrics and batch control."""
    tables.drop(names)
    for name in (INGESTIONS, HISTORY_BATCHES):
        if tables.exists(name):
            tables.clear(name)


# ---- registration of specs, all tables and columns at once


def with_schema_ids(rows: DataFrame, catalogs: DataFrame, schemas: DataFrame) -> DataFrame:
    """Rows with the ids of their catalog and schema; an unknown name fails the job."""
    in_catalog = lookup_ids(rows, catalogs, ["catalog_name"], "catalog_id", required=True)
    return lookup_ids(in_catalog, schemas, ["catalog_id", "schema_name"], "schema_id", required=True)


def table_rows(
    resolved: DataFrame, catalogs: DataFrame, schemas: DataFrame, registered: DataFrame, now: datetime | str
) -> DataFrame:
    """One governance row per table, new tables numbered by asset and layer."""
    rank = F.array_position(F.array(*[F.lit(layer) for layer in LAYERS]), F.col("layer")).cast("int")
    declared = [f for f in TABLE_SCHEMA.names if f in resolved.columns]
    distinct = resolved.select("catalog_name", "schema_name", "asset", rank.alias("_rank"), *[c for c in declared if c not in ("schema_name",)]).distinct()
    placed = with_schema_ids(distinct, catalogs, schemas)
    base = ["schema_id", "table_name", "version"]
    ids = assign_ids(placed.select(*base, "asset", "_rank"), registered, base, "table_id", F.col("asset"), ["_rank"])
    typed = ids.select(
        F.col("schema_id").cast("int").alias("schema_id"), "table_name", F.col("version").cast("int").alias("version"), "table_id"
    )
    return placed.join(typed, base).select(
        *[
            {
                "current_flag": F.lit(True),
                "valid_from": F.lit(now).cast("timestamp"),
                "valid_to": F.lit(OPEN_END).cast("timestamp"),
            }.get(c, F.col(c)).alias(c)
            for c in TABLE_SCHEMA.names
        ]
    )


def column_rows(resolved: DataFrame, tables: DataFrame, registered: DataFrame) -> DataFrame:
    """One governance row per column, new columns numbered by table and position."""
    named = resolved.join(tables.select("table_name", "version", "table_id"), ["table_name", "version"])
    base = ["table_id", "column_name"]
    ids = assign_ids(
        named.select(*base, "ordinal_position", F.col("table_id").alias("_table")),
        registered,
        base,
        "column_id",
        F.struct("_table", F.floor(F.col("ordinal_position") / COLUMNS_PER_GROUP)),
        ["ordinal_position"],
    ).select(F.col("table_id").cast("int").alias("table_id"), "column_name", "column_id")
    no = F.lit(False)
    filled = {
        "is_primary_key": F.coalesce("is_primary_key", no),
        "is_nullable": F.coalesce("is_nullable", F.lit(True)),
        "is_partition": F.coalesce("is_partition", no),
        "is_pii": F.coalesce("is_pii", no),
    }
    return named.join(ids, base).withColumns(filled).select(*DETAIL_SCHEMA.names)


def register_specs(tables: Tables, spec_rows: DataFrame, now: datetime | str, environment: str = "dev") -> None:
    """Write all tables and columns of the given spec rows to the governance tables."""
    resolved = materialize(layer_attributes(resolve_layers(spec_rows), environment), "specs")
    entries = table_rows(resolved, tables.read(CATALOGS), tables.read(SCHEMAS), tables.read(TABLES), now)
    tables.upsert(TABLES, entries, ["table_id"])
    details = column_rows(resolved, entries_by_name(tables), tables.read(DETAILS))
    tables.upsert(DETAILS, details, ["column_id"])


def entries_by_name(tables: Tables) -> DataFrame:
    return tables.read(TABLES).where("current_flag")


def fetch_spec(tables: Tables, name: str, aliases: Mapping[str, str] | None = None) -> TableSpec:
    """The registered spec of `catalog.schema.table`; technical columns are not part of it."""
    catalog, schema, table = name.split(".")
    catalogs = tables.read(CATALOGS).where(F.col("catalog_name") == catalog).select("catalog_id", "catalog_name")
    schemas = tables.read(SCHEMAS).where(F.col("schema_name") == schema).select("schema_id", "catalog_id", "schema_name")
    entries = (
        entries_by_name(tables)
        .where(F.col("table_name") == table)
        .join(schemas, "schema_id")
        .join(catalogs, "catalog_id")
        .limit(2)
        .collect()
    )
    if len(entries) != 1:
        raise ValueError(f"{'No' if not entries else 'More than one'} registered table: {name}")
    entry = entries[0].asDict()
    columns = (
        tables.read(DETAILS)
        .where((F.col("table_id") == entry["table_id"]) & ~F.col("column_name").contains("metadata"))
        .collect()
    )
    return table_spec(entry, [c.asDict() for c in columns], dict(aliases or {}))
