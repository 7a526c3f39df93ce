"""The declarative column spec: what a table's columns are, and how each layer treats them."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierflow.functions.types import declared_type, record

LAYERS = ["raw", "audit", "historic"]
# Naming of the layers, and the end date of an open validity period.
LAYER_MODULES = {"raw": "load", "audit": "audit", "historic": "hist"}
LAYER_QUALITY = {"raw": "bronze", "audit": "silver", "historic": "silver"}
OPEN_END = "2200-01-01 00:00:00"
INHERITED = ["data_type", "is_primary_key", "is_nullable", "is_partition", "is_pii", "comment"]

# One row per (asset, layer, column), as read from the spec files.
SPEC_SCHEMA = record(
    asset="string",
    domain="string",
    subdomain="string",
    layer="string",
    write_mode="string",
    version="integer",
    description="string",
    owner="string",
    retention_policy="string",
    column_name="string",
    ordinal_position="integer",
    rename_from="string",
    data_type="string",
    is_primary_key="boolean",
    is_nullable="boolean",
    is_partition="boolean",
    is_pii="boolean",
    validations="string",
    track_changes="boolean",
    comment="string",
)


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    data_type: str = "string"
    rename_from: str | None = None
    is_primary_key: bool = False
    is_nullable: bool = True
    is_partition: bool = False
    is_pii: bool = False
    validations: tuple[dict[str, Any], ...] = ()
    track_changes: bool = False
    comment: str = ""


@dataclass(frozen=True)
class TableSpec:
    catalog_name: str
    schema_name: str
    table_name: str
    columns: tuple[ColumnSpec, ...]
    etl_module: str = ""
    write_mode: str = "overwrite_partition"
    quality: str = ""
    table_id: int | None = None
    aliases: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for column in self.columns:
            declared_type(column.data_type)

    @property
    def name(self) -> str:
        return f"{self.catalog_name}.{self.schema_name}.{self.table_name}"

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def key(self) -> list[str]:
        return [c.name for c in self.columns if c.is_primary_key]

    @property
    def required(self) -> list[str]:
        return [c.name for c in self.columns if not c.is_nullable]

    @property
    def tracked(self) -> list[str]:
        """Columns whose changes open a new version."""
        return [c.name for c in self.columns if c.track_changes]

    @property
    def comments(self) -> dict[str, str]:
        return {c.name: c.comment for c in self.columns if c.comment}

    def pattern(self, column: ColumnSpec) -> str | None:
        """The declared date pattern of a column, if it has one."""
        for v in column.validations:
            if v["validation"] == "is_date_format":
                return v["format"]
        return None


def screen_plan(spec: TableSpec) -> list[tuple[str, str, dict[str, Any]]]:
    """A spec's validations as `(column, screen, params)`; composite groups come last.

    `unique` validations with one `unique_group` become one `is_unique` screen over the group,
    whose column entry is the list of its members joined by commas.
    """
    plan: list[tuple[str, str, dict[str, Any]]] = []
    groups: dict[str, list[str]] = {}
    types = {c.name: c for c in spec.columns}
    for column in spec.columns:
        for item in column.validations:
            params = {k: v for k, v in item.items() if k != "validation"}
            screen = item["validation"]
            if screen == "unique":
                groups.setdefault(params["unique_group"], []).append(column.name)
                continue
            if screen == "is_in_list" and "reference" in params:
                screen = "is_in_foreign_column"
            if screen == "is_not_lower_than":
                params.setdefault("data_type", column.data_type)
                pattern = spec.pattern(types.get(params["reference"], column))
                if pattern is not None:
                    params.setdefault("format", pattern)
            plan.append((column.name, screen, params))
    plan += [(",".join(members), "is_unique", {"columns": members}) for members in groups.values()]
    return plan


# ---- inheritance between the layers


def _filled(child: DataFrame, parent: DataFrame, on: list[Column]) -> DataFrame:
    joined = child.alias("c").join(parent.alias("p"), on, "left")
    kept = [
        F.coalesce(f"c.{name}", f"p.{name}").alias(name) if name in INHERITED else F.col(f"c.{name}")
        for name in child.columns
    ]
    return joined.select(*kept)


def inherit_audit(raw: DataFrame, audit: DataFrame) -> DataFrame:
    """Audit columns take what they do not declare from the raw column they are renamed from."""
    named = audit.withColumn("rename_from", F.coalesce("rename_from", "column_name"))
    return _filled(
        named,
        raw,
        [F.col("c.asset") == F.col("p.asset"), F.col("c.rename_from") == F.col("p.column_name")],
    )


def inherit_historic(audit: DataFrame, historic: DataFrame) -> DataFrame:
    """Historic columns take what they do not declare from the audit column of the same name."""
    named = historic.withColumn("rename_from", F.col("column_name"))
    return _filled(
        named,
        audit,
        [F.col("c.asset") == F.col("p.asset"), F.col("c.column_name") == F.col("p.column_name")],
    )


def resolve_layers(spec_rows: DataFrame) -> DataFrame:
    """All layers of all assets, each with its inherited attributes filled in."""
    raw = spec_rows.where("layer = 'raw'")
    audit = inherit_audit(raw, spec_rows.where("layer = 'audit'"))
    historic = inherit_historic(audit, spec_rows.where("layer = 'historic'"))
    return raw.unionByName(audit).unionByName(historic)


def layer_attributes(spec_rows: DataFrame, environment: str = "dev") -> DataFrame:
    """Names that follow from the layer: catalog, schema, table, module, quality, type."""

    def by_layer(values: dict[str, str]) -> Column:
        chosen = F.lit(None).cast("string")
        for layer, value in values.items():
            chosen = F.when(F.col("layer") == layer, F.lit(value)).otherwise(chosen)
        return chosen

    return spec_rows.withColumns(
        {
            "catalog_name": F.concat_ws("_", "domain", F.lit(environment)),
            "schema_name": F.concat_ws("_", by_layer(LAYER_QUALITY), "subdomain"),
            "table_name": F.concat_ws("_", "layer", "asset"),
            "etl_module": F.concat_ws("__", "asset", by_layer(LAYER_MODULES)),
            "quality": by_layer(LAYER_QUALITY),
            "table_type": F.lit("table"),
        }
    )


def table_spec(row: dict[str, Any], columns: Iterable[dict[str, Any]], aliases: dict[str, str] | None = None) -> TableSpec:
    """A `TableSpec` from one table row and its column rows (as dictionaries)."""
    return TableSpec(
        catalog_name=row["catalog_name"],
        schema_name=row["schema_name"],
        table_name=row["table_name"],
        etl_module=row["etl_module"],
        write_mode=row["write_mode"],
        quality=row["quality"],
        table_id=row.get("table_id"),
        aliases=dict(aliases or {}),
        columns=tuple(
            ColumnSpec(
                name=c["column_name"],
                data_type=c["data_type"],
                rename_from=c["rename_from"],
                is_primary_key=bool(c["is_primary_key"]),
                is_nullable=c["is_nullable"] is not False,
                is_partition=bool(c["is_partition"]),
                is_pii=bool(c["is_pii"]),
                validations=tuple(json.loads(c["validations"])) if c["validations"] else (),
                track_changes=bool(c["track_changes"]),
                comment=c["comment"] or "",
            )
            for c in sorted(columns, key=lambda c: c["ordinal_position"])
        ),
    )
