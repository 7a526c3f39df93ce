"""Declarative, layered data processing on Spark DataFrames.

A column spec (types, renames, keys, data-quality screens, change tracking) drives generic
operators that land delimited batches, conform and type them, clean and screen them with an
error log, merge them by key, keep change history, record metrics, summarise and export.
"""

from tierflow.functions.cleaning import clean_text, cleaning_hook, list_to_json
from tierflow.functions.hashing import hash_key
from tierflow.operators.events import error_events
from tierflow.operators.history import current_versions, scd2_actions, scd2_apply, scd2_rebuild, versions_at
from tierflow.operators.keys import assign_ids, lookup_ids
from tierflow.operators.metrics import ingestion_metrics, pending_batches
from tierflow.operators.screening import Screening, failing_rows, screen
from tierflow.operators.skew import lookup_join
from tierflow.operators.summary import visitor_summary
from tierflow.operators.upsert import upsert
from tierflow.plans.runs import Asset, Run, export, process, summarize
from tierflow.plans.spec import ColumnSpec, TableSpec
from tierflow.session import configure
from tierflow.sources.tables import Tables

__all__ = [
    "Asset",
    "ColumnSpec",
    "Run",
    "Screening",
    "TableSpec",
    "Tables",
    "assign_ids",
    "clean_text",
    "cleaning_hook",
    "configure",
    "current_versions",
    "error_events",
    "export",
    "failing_rows",
    "hash_key",
    "ingestion_metrics",
    "list_to_json",
    "lookup_ids",
    "lookup_join",
    "pending_batches",
    "process",
    "scd2_actions",
    "scd2_apply",
    "scd2_rebuild",
    "screen",
    "summarize",
    "upsert",
    "versions_at",
    "visitor_summary",
]
