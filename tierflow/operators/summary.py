"""Per-entity summary of audited rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Column names of the published summary.
FIRST_VISIT = "fechaPrimeraVisita"
LAST_VISIT = "fechaUltimaVisita"
TOTAL = "visitasTotales"
THIS_YEAR = "visitasAnioActual"
THIS_MONTH = "visitasMesActual"


def run_period(rundate: str) -> tuple[int, int]:
    """Year and month of a run id (`yyyyMMdd_HHmmss`)."""
    return int(rundate[0:4]), int(rundate[4:6])


# Columns of the partial summaries.
YEAR, MONTH, FIRST, LAST, VISITS = "visit_year", "visit_month", "first_visit", "last_visit", "visits"


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def partial_summary(rows: DataFrame, key: str | Sequence[str], at: str, batch: str) -> DataFrame:
    """What each batch brings to the summary: a row per key, batch and month of its visits.

    Such rows can be merged over any batches and for any run's period, and a batch that is screened
    again replaces its own. Counts combine before the shuffle.
    """
    keys = _keys(key)
    known = F.coalesce(*[F.col(k).cast("string") for k in keys])
    return rows.groupBy(*keys, batch, F.year(at).alias(YEAR), F.month(at).alias(MONTH)).agg(
        F.min(at).alias(FIRST), F.max(at).alias(LAST), F.count(known).alias(VISITS)
    )


def merged_summary(partials: DataFrame, key: str | Sequence[str], rundate: str) -> DataFrame:
    """`visitor_summary` of all rows, from their partial summaries."""
    year, month = run_period(rundate)
    in_year = F.col(YEAR) == year
    visits = lambda period: F.coalesce(F.sum(F.when(period, F.col(VISITS))), F.lit(0)).cast("long")
    return partials.groupBy(*_keys(key)).agg(
        F.min(FIRST).alias(FIRST_VISIT),
        F.max(LAST).alias(LAST_VISIT),
        visits(F.lit(True)).alias(TOTAL),
        visits(in_year).alias(THIS_YEAR),
        visits(in_year & (F.col(MONTH) == month)).alias(THIS_MONTH),
    )


def visitor_summary(rows: DataFrame, key: str | Sequence[str], at: str, rundate: str) -> DataFrame:
    """First and last visit and visit counts (all, run's year, run's month) per key.

    Visits of an entity without a key are not counted; of a composite key one part is enough.
    One aggregate with conditional counts: a single exchange that carries one partial row per
    key and task, however many visits a key has.
    """
    year, month = run_period(rundate)
    in_year = F.year(at) == year
    in_month = in_year & (F.month(at) == month)
    keys = _keys(key)
    known = F.coalesce(*[F.col(k).cast("string") for k in keys])
    return rows.groupBy(*keys).agg(
        F.min(at).alias(FIRST_VISIT),
        F.max(at).alias(LAST_VISIT),
        F.count(known).alias(TOTAL),
        F.count(F.when(in_year, known)).alias(THIS_YEAR),
        F.count(F.when(in_month, known)).alias(THIS_MONTH),
    )
