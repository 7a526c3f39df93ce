"""Runs: delivered files through raw, audit, history, summary and deliverables.

Every step handles all batches of the run in one job, and leaves its metrics row as the last
thing it does: a run that failed midway is resumed by running it again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierflow.functions.cleaning import Hook
from tierflow.functions.types import record
from tierflow.operators.conform import BATCH, LOADED_AT, conform, fail_on_null
from tierflow.operators.events import EVENT_SCHEMA
from tierflow.operators.export import events_differential, run_batches, statistic_differential, visitor_differential
from tierflow.operators.history import VALIDITY, close_absent, empty_history, scd2_changes
from tierflow.operators.metrics import METRIC_KEY, ingestion_metrics, pending_batches, table_metrics
from tierflow.operators.skew import SMALL_ROWS, lookup_join
from tierflow.operators.summary import (
    FIRST_VISIT,
    LAST_VISIT,
    THIS_MONTH,
    THIS_YEAR,
    TOTAL,
    merged_summary,
    partial_summary,
    visitor_summary,
)
from tierflow.plans.governance import EVENT_ERRORS, HISTORY_BATCH_SCHEMA, HISTORY_BATCHES, INGESTIONS
from tierflow.plans.layers import audit_events, audit_rows, audit_screening
from tierflow.plans.spec import TableSpec
from tierflow.sources.landing import COMMA, CsvReader, discover, read_files
from tierflow.sources.tables import Tables

# Column of partial summaries: when their batch was screened.
SCREENED_AT = "screened_at"
# Partition column of a history table: the step that closed a version, OPEN for current ones.
CLOSED_BY = "metadata_closed_by"
OPEN = "open"


@dataclass(frozen=True)
class Asset:
    """One table's way through the layers."""

    raw: TableSpec
    audit: TableSpec
    historic: TableSpec
    hook: Hook | None = None
    references: Mapping[str, DataFrame] = field(default_factory=dict)
    reader: CsvReader = COMMA


@dataclass(frozen=True)
class Run:
    """A run id (`yyyyMMdd_HHmmss`) and the time that its rows carry."""

    tables: Tables
    rundate: str
    loaded_at: str

    def pending(self, batches: Iterable[str], spec: TableSpec) -> list[str]:
        """Of the given batches, those that this table has no metrics for."""
        found = _named(self, batches)
        return sorted(r[0] for r in pending_batches(found, self.tables.read(INGESTIONS), spec).collect())

    def step(self, batches: Iterable[str]) -> str:
        """Name of one step of this run: the same when the step runs again, another for other batches."""
        return f"{self.rundate}-{hashlib.md5(','.join(sorted(batches)).encode()).hexdigest()[:16]}"

    def record(self, metrics: DataFrame) -> None:
        self.tables.upsert(INGESTIONS, metrics, METRIC_KEY)


def land_to_raw(run: Run, asset: Asset, files: DataFrame, batches: list[str]) -> None:
    """Files of new batches into the raw table, one partition per batch."""
    spec, tables = asset.raw, run.tables
    delivered = read_files(tables.spark, files, asset.reader, spec.aliases, spec.names)
    raw = conform(delivered, spec, run.loaded_at)
    # Checked while writing: delivered text is parsed once, and a failed write commits nothing.
    tables.write(fail_on_null(raw, spec.required), spec.name, spec.write_mode, batches)
    # Conforming keeps every row, so rows delivered and rows written are the same count.
    written = tables.read(spec.name).where(F.col(BATCH).isin(batches))
    target = tables.read(spec.name)
    run.record(ingestion_metrics(written, written, target, BATCH, spec, run.rundate, run.loaded_at, batches))


def raw_to_audit(run: Run, asset: Asset, batches: list[str]) -> None:
    """Screen raw batches; merge the audited rows and the error events."""
    spec, tables = asset.audit, run.tables
    raw = tables.read(asset.raw.name).where(F.col(BATCH).isin(batches))
    screening = audit_screening(raw, spec, asset.hook, asset.references)
    audited = audit_rows(raw, spec, run.loaded_at, asset.hook, asset.references, screening)
    events = audit_events(raw, spec, asset.hook, asset.references, screening)
    if spec.key:
        tables.upsert(
            spec.name,
            audited,
            [*spec.key, BATCH],
            created_col="metadata_created_at",
            updated_col="metadata_updated_at",
            at=run.loaded_at,
            batches=batches,
            partition_by=[BATCH],
            rerun_null_keys=True,
        )
    else:
        # Without a key there is nothing to merge by: the batches are replaced.
        created = F.lit(run.loaded_at).cast("timestamp")
        tables.overwrite_batches(audited.withColumn("metadata_created_at", created), spec.name, batches)
    tables.upsert(
        EVENT_ERRORS, events, ["error_event_id", "batch_id"], batches=batches, partition_by=["batch_id"]
    )
    kept, target = tables.read(spec.name).where(F.col(BATCH).isin(batches)), tables.read(spec.name)
    run.record(ingestion_metrics(raw, kept, target, BATCH, spec, run.rundate, run.loaded_at, batches))


def audit_to_historic(run: Run, asset: Asset, batches: Iterable[str] | None = None, deletes: bool = True) -> None:
    """Bring the history up to the passed rows; only current versions are read and rewritten.

    With `batches`, only their rows are compared and keys without one stay as they are: a run
    reads what it loaded, not the whole audit table. If one of them is in the history already, it
    was screened again, and current keys that no passed row holds any more are closed; that takes
    the keys of all passed rows. Without `batches`, all passed rows are compared and keys that have
    none left are closed. `deletes` off closes none.

    Versions closed by a step go to a partition of their own, so running the step again replaces
    them instead of adding to them, and other steps of the run keep theirs.
    """
    spec, tables, key = asset.historic, run.tables, asset.audit.key
    passed = everything = tables.read(asset.audit.name, "read_audit_passed")
    vanished = None
    if batches is None:
        batches = [r[0] for r in _audited_batches(run, asset).collect()]
    else:
        batches = sorted(set(batches))
        known = pending_batches(_named(run, batches), tables.read(HISTORY_BATCHES), spec).count() < len(batches)
        passed = passed.where(F.col(BATCH).isin(batches))
        vanished = everything.select(*key).distinct() if deletes and known else None
        deletes = False
    snapshot = passed.withColumn("_batch_length", F.length(BATCH))
    if not tables.exists(spec.name):
        start = empty_history(snapshot, key, spec.tracked).withColumn(CLOSED_BY, F.lit(OPEN))
        tables.create(spec.name, start.schema, ["is_current", CLOSED_BY], spec.comments)
    before = tables.read(spec.name).count()
    current = tables.read(spec.name).where("is_current").select(*dict.fromkeys([*key, *spec.tracked]), *VALIDITY)
    # Batch ids are text: the shorter is the lower number.
    order = [LOADED_AT, "_batch_length", BATCH]
    versions = scd2_changes(current, snapshot, key, spec.tracked, run.loaded_at, order, deletes)
    if vanished is not None:
        versions = close_absent(versions, vanished, key, run.loaded_at)
    placed = versions.withColumn(CLOSED_BY, F.when(F.col("is_current"), OPEN).otherwise(run.step(batches)))
    # Without passed rows no version stays current, and the open partition has to be emptied.
    empties = (deletes or vanished is not None) and everything.isEmpty()
    tables.write_partitions(placed, spec.name, ["is_current", CLOSED_BY])
    if empties:
        tables.clear_partition(spec.name, {"is_current": True, CLOSED_BY: OPEN})
    after = tables.read(spec.name).count()
    run.record(table_metrics(tables.spark, spec, run.rundate, run.loaded_at, before, after))
    done = [(spec.catalog_name, spec.schema_name, spec.table_name, b, run.rundate) for b in batches]
    tables.upsert(HISTORY_BATCHES, tables.spark.createDataFrame(done, HISTORY_BATCH_SCHEMA), METRIC_KEY)


def _named(run: Run, batches: Iterable[str]) -> DataFrame:
    return run.tables.spark.createDataFrame([(b,) for b in sorted(set(batches))], "batch_id string")


def _audited_batches(run: Run, asset: Asset) -> DataFrame:
    """Batches that the audit table has metrics for."""
    spec = asset.audit
    return run.tables.read(INGESTIONS).where(
        (F.col("catalog_name") == spec.catalog_name)
        & (F.col("schema_name") == spec.schema_name)
        & (F.col("table_name") == spec.table_name)
    ).select("batch_id")


def read_history(tables: Tables, name: str) -> DataFrame:
    """A history table without its partitioning column."""
    return tables.read(name).drop(CLOSED_BY)


def process_files(run: Run, asset: Asset, files: DataFrame) -> list[str]:
    """Take the given files' batches through all layers; returns the batches landed by this call.

    Each layer takes the batches that it has not recorded: a batch whose audit or history step
    failed is caught up by the next run, although it has landed already.
    """
    nameless = files.where("batch_id = ''").select("file_name").first()
    if nameless:
        raise ValueError(f"No batch id in the file name {nameless[0]}")
    found = [r[0] for r in files.select("batch_id").distinct().collect()]
    new = run.pending(found, asset.raw)
    if new:
        land_to_raw(run, asset, files.where(F.col("batch_id").isin(new)), new)
    unaudited = run.pending(found, asset.audit)
    if unaudited:
        raw_to_audit(run, asset, unaudited)
    applied = run.tables.read(HISTORY_BATCHES)
    open_batches = pending_batches(_audited_batches(run, asset), applied, asset.historic).collect()
    if open_batches:
        audit_to_historic(run, asset, [r[0] for r in open_batches])
    return new


def process(run: Run, asset: Asset, path: str) -> list[str]:
    """Take all new files below a landing folder through the layers."""
    return process_files(run, asset, discover(run.tables.spark, path))


def summarize(run: Run, asset: Asset, name: str, at: str) -> None:
    """Write the per-key summary of all passed rows."""
    passed = run.tables.read(asset.audit.name, "read_audit_passed")
    run.tables.replace(visitor_summary(passed, _entity(asset), at, run.rundate), name)


def summarize_batches(run: Run, asset: Asset, name: str, at: str, state: str) -> None:
    """`summarize` from partial summaries in the table `state`, which holds a partition per batch.

    Passed rows are read of those batches only that were screened since their partial summary was
    made, by this run or by one that failed before it came here; theirs replace the old ones.
    """
    tables, key, spec = run.tables, _entity(asset), asset.audit
    passed = tables.read(spec.name, "read_audit_passed")
    own = (F.col("catalog_name") == spec.catalog_name) & (F.col("schema_name") == spec.schema_name) & (F.col("table_name") == spec.table_name)
    screened = tables.read(INGESTIONS).where(own).select(F.col("batch_id").alias(BATCH), F.col("loaded_at").alias(SCREENED_AT), "rundate")
    since = screened
    if tables.exists(state):
        done = tables.read(state).select(BATCH, SCREENED_AT).distinct()
        since = screened.where(F.col("rundate") == run.rundate).unionByName(screened.join(done, [BATCH, SCREENED_AT], "left_anti"))
    batches = sorted({r[0] for r in since.select(BATCH).distinct().collect()})
    partials = partial_summary(passed.where(F.col(BATCH).isin(batches)), key, at, BATCH)
    partials = lookup_join(partials, screened.drop("rundate"), [BATCH], small_rows=SMALL_ROWS)
    tables.overwrite_batches(partials, state, batches)
    tables.replace(merged_summary(tables.read(state), key, run.rundate), name)


def _entity(asset: Asset) -> list[str]:
    """The key columns of the entities that gold and export are about."""
    if not asset.audit.key:
        raise ValueError(f"{asset.audit.name} has no key, so there is nothing to summarize by")
    return list(asset.audit.key)


def deliverables(asset: Asset) -> dict[str, tuple[T.StructType, list[str], list[str]]]:
    """(schema, key, partition columns) of each published table; their keys hold each value once."""
    spec = asset.audit
    types = {c.name: c.data_type for c in spec.columns}
    visitor = {**{k: types[k] for k in _entity(asset)}, FIRST_VISIT: "timestamp", LAST_VISIT: "timestamp"}
    statistic = {c.name: c.data_type for c in spec.columns}
    return {
        "visitor": (record(**visitor, **{c: "integer" for c in (TOTAL, THIS_YEAR, THIS_MONTH)}), list(spec.key), []),
        "statistic": (record(**statistic, **{BATCH: "string"}), [*spec.key, BATCH], [BATCH]),
        "event_errors": (EVENT_SCHEMA, ["error_event_id", "batch_id"], ["batch_id"]),
    }


def create_deliverables(tables: Tables, asset: Asset, targets: Mapping[str, str]) -> None:
    """Define the published tables that do not exist yet."""
    for kind, (schema, _, partition_by) in deliverables(asset).items():
        tables.create(targets[kind], schema, partition_by)


def export(run: Run, asset: Asset, summary_name: str, targets: Mapping[str, str]) -> None:
    """Merge what the run touched into the deliverables `visitor`, `statistic` and `event_errors`."""
    tables, spec, key = run.tables, asset.audit, _entity(asset)
    create_deliverables(tables, asset, targets)
    batches = run_batches(tables.read(INGESTIONS), run.rundate, spec)
    ids = [r[0] for r in batches.collect()]
    audited = tables.read(spec.name)
    rows = {
        "visitor": visitor_differential(tables.read(summary_name), audited, batches, key),
        "statistic": statistic_differential(audited, batches, spec.names),
        "event_errors": events_differential(tables.read(EVENT_ERRORS), batches),
    }
    for kind, (_, keys, partition_by) in deliverables(asset).items():
        tables.upsert(targets[kind], rows[kind], keys, batches=ids if partition_by else None)
