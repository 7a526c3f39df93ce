"""The frame-to-frame part of the layers: delivered batch -> raw -> audit and events.

Nothing is read or written here; `tierflow.plans.runs` adds the tables.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.functions.cleaning import Hook
from tierflow.operators.conform import (
    AUDIT_TECHNICAL,
    BATCH,
    RAW_TECHNICAL,
    TECHNICAL_COMMENTS,
    cast_audit,
    drop_technical,
    rename_from_spec,
    with_audit_technical,
    with_comments,
)
from tierflow.operators.events import error_events
from tierflow.operators.screening import References, Screening
from tierflow.plans.spec import TableSpec, screen_plan


def audit_plan(spec: TableSpec) -> list:
    """The spec's screens, with the key screen first if a key is declared."""
    key = [(",".join(spec.key), "is_primary_key", {"columns": spec.key})] if spec.key else []
    return key + screen_plan(spec)


def cleaned_rows(raw: DataFrame, spec: TableSpec, hook: Hook | None = None) -> DataFrame:
    """Raw rows under their audit names, cleaned by the hook."""
    named = rename_from_spec(drop_technical(raw, keep=[BATCH]), spec)
    return named.transform(hook) if hook else named


def audit_screening(
    raw: DataFrame,
    spec: TableSpec,
    hook: Hook | None = None,
    references: References = {},
    violations: DataFrame | None = None,
) -> Screening:
    """The screening of raw-layer rows; rows and events can share one, so lookups are found once."""
    return Screening(cleaned_rows(raw, spec, hook), audit_plan(spec), spec.key, BATCH, references, violations=violations)


def audit_rows(
    raw: DataFrame,
    spec: TableSpec,
    loaded_at: datetime | str,
    hook: Hook | None = None,
    references: References = {},
    screening: Screening | None = None,
) -> DataFrame:
    """Audit-layer rows of raw-layer rows, for any number of batches at once."""
    screening = screening or audit_screening(raw, spec, hook, references)
    typed = with_audit_technical(cast_audit(screening.audited(), spec), loaded_at, spec.etl_module)
    ordered = [*spec.names, *AUDIT_TECHNICAL[:2], *RAW_TECHNICAL, *AUDIT_TECHNICAL[2:]]
    return with_comments(typed.select(*ordered), {**spec.comments, **TECHNICAL_COMMENTS})


def audit_events(
    raw: DataFrame,
    spec: TableSpec,
    hook: Hook | None = None,
    references: References = {},
    screening: Screening | None = None,
) -> DataFrame:
    """Error events of raw-layer rows."""
    screening = screening or audit_screening(raw, spec, hook, references)
    return error_events(screening.failures(), BATCH, spec.catalog_name, spec.schema_name, spec.table_name)


def passed_rows(audited: DataFrame) -> DataFrame:
    """Rows that passed every screen."""
    return audited.where(F.col("metadata_audit_passed"))
