"""Queries over whole runs: the feed delivered as one file per day, taken through all tables.

Three deliveries: the first two by `process` under one run id, the last by a file stream under
another; the first is offered again at the end and must change nothing. The runs are executed once
per session and data folder; each query returns one of the tables they left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suite import feed as f
from suite.queries import AUDIT, EVENTS, GOLD, V, delivered, query
from tierflow.operators.conform import BATCH
from tierflow.plans.governance import EVENT_ERRORS, INGESTIONS, init_governance
from tierflow.plans.runs import Asset, Run, export, process, read_history, summarize, summarize_batches
from tierflow.plans.spec import ColumnSpec, TableSpec
from tierflow.session import materialize, shared_dir
from tierflow.sources.landing import profile_files
from tierflow.sources.tables import Tables, write_csv
from tierflow.streaming.ingest import ingest_available

TRACKED = ["Baja", "Opens"]
HISTORIC = TableSpec(
    f.CATALOG,
    f.SCHEMA,
    "historic_visits",
    etl_module="visits__hist",
    write_mode="historic",
    quality="silver",
    columns=(
        ColumnSpec("Email", "string", "Email", track_changes=True),
        ColumnSpec("Baja", "string", "Baja", track_changes=True),
        ColumnSpec("Opens", "integer", "Opens", track_changes=True),
    ),
)
VISITOR = f"{f.CATALOG}.gold_analytics.visitor"
VISITOR_KEPT, VISITOR_STATE = f"{VISITOR}_kept", f"{VISITOR}_state"
TARGETS = {kind: f"published.analytics.{kind}" for kind in ("visitor", "statistic", "event_errors")}
# (first day, last day, run id, load time)
STEPS = [
    ("20240101", "20240110", "20240110_000000", "2024-01-10 20:00:00"),
    ("20240111", "20240120", "20240110_000000", "2024-01-20 20:00:00"),
    ("20240121", "20240131", "20240130_000000", "2024-01-30 20:00:00"),
]

_left: dict[tuple[str, str], dict[str, DataFrame]] = {}


def deliver(spark: SparkSession, rows: DataFrame, folder: str) -> None:
    """One file per batch, named after it."""
    parts = f"{folder}-parts"
    write_csv(rows.withColumnRenamed(BATCH, "batch_id").repartition("batch_id"), parts, partition_by=["batch_id"])
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(parts)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(hadoop.Path(folder))
    for batch in system.globStatus(hadoop.Path(f"{parts}/batch_id=*/*.csv")):
        path = batch.getPath()
        name = path.getParent().getName().split("=")[1]
        system.rename(path, hadoop.Path(f"{folder}/report_{name}.csv"))


def tables_left(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables after all runs."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _left:
        _left[key] = run_all(spark, sf_dir)
    return _left[key]


def run_all(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    folder = shared_dir(spark, "runs")
    tables, asset = Tables(spark, f"{folder}/tables"), Asset(f.RAW, f.AUDIT, HISTORIC, f.HOOK)
    named = {"raw": f.RAW.name, "audit": f.AUDIT.name, "events": EVENT_ERRORS, "metrics": INGESTIONS, "gold": VISITOR}
    named |= {"gold_kept": VISITOR_KEPT, "gold_state": VISITOR_STATE}
    named |= {f"export_{kind}": name for kind, name in TARGETS.items()}
    tables.drop([*named.values(), HISTORIC.name])
    init_governance(tables, "analytics", "suite", "2024-01-01 00:00:00")
    rows = delivered(spark, sf_dir).withColumn(BATCH, F.substring(BATCH, 1, 8))
    for n, (first, last, rundate, loaded_at) in enumerate(STEPS):
        path = f"{folder}/landing/{n}"
        deliver(spark, rows.where(F.col(BATCH).between(first, last)), path)
        run = Run(tables, rundate, loaded_at)
        if n < len(STEPS) - 1:
            process(run, asset, path)
        else:
            ingest_available(run, asset, path, f"{folder}/checkpoint").awaitTermination()
        summarize(run, asset, VISITOR, "FechaEnvio")
        summarize_batches(run, asset, VISITOR_KEPT, "FechaEnvio", VISITOR_STATE)
        export(run, asset, VISITOR, TARGETS)
    if process(Run(tables, STEPS[0][2], STEPS[0][3]), asset, f"{folder}/landing/0"):
        raise ValueError("A delivery was landed twice")
    left = {kind: tables.read(name) for kind, name in named.items()} | {"history": read_history(tables, HISTORIC.name)}
    left["passed"] = tables.read(f.AUDIT.name, "read_audit_passed")
    left = {kind: materialize(df, f"left-{kind}") for kind, df in left.items()}
    tables.drop([*named.values(), HISTORIC.name])
    return left


def daily(sql: str) -> str:
    """A query over the feed with one batch per day."""
    return sql.replace("strftime(ts,'%Y%m%d%H')", "strftime(ts,'%Y%m%d')")


def by_step(value: str) -> str:
    cases = "".join(f" WHEN {{0}} BETWEEN '{first}' AND '{last}' THEN {value.format(n=n, at=at, run=run)}" for n, (first, last, run, at) in enumerate(STEPS))
    return f"CASE{cases} END"


LOADED = by_step("TIMESTAMP '{at}'")


@query(
    "run_raw",
    daily(
        f"""{V} SELECT event_id, email, fechaenvio, baja, opens, nullif(links, '') AS links, batch_id AS metadata_batch_id,
      {LOADED.format('batch_id')} AS metadata_loaded_at, 'visits__load' AS metadata_etl_module FROM v"""
    ),
)
def run_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables_left(spark, sf_dir)["raw"]


AUDITED = ["event_id", "Email", "FechaEnvio", "Baja", "Opens", "Links", "metadata_audit_id", BATCH]
AUDITED_SQL = ", ".join(f'"{c}"' for c in AUDITED)


@query("run_audit", daily(f"{AUDIT} SELECT {AUDITED_SQL}, {LOADED.format(BATCH)} AS metadata_created_at FROM a"))
def run_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables_left(spark, sf_dir)["audit"].select(*AUDITED, "metadata_created_at")


@query("run_passed", daily(f"{AUDIT} SELECT {AUDITED_SQL} FROM a WHERE metadata_audit_id = 1"))
def run_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables_left(spark, sf_dir)["passed"].select(*AUDITED)


@query("run_events", daily(f"{EVENTS} SELECT * FROM e"))
def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables_left(spark, sf_dir)["events"]


@query(
    "run_history",
    daily(
        f"""{AUDIT},
p AS (SELECT "Email", "Baja", "Opens", metadata_batch_id, {by_step('{n}').format(BATCH)} AS step FROM a WHERE metadata_audit_id = 1),
l AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY "Email", step
  ORDER BY metadata_batch_id DESC, "Baja" DESC NULLS LAST, "Opens" DESC NULLS LAST) = 1),
c AS (SELECT *, lag("Baja") OVER w AS baja0, lag("Opens") OVER w AS opens0, row_number() OVER w AS n FROM l
  WINDOW w AS (PARTITION BY "Email" ORDER BY step)),
s AS (SELECT *, {LOADED.format(BATCH)} AS valid_from FROM c
  WHERE n = 1 OR baja0 IS DISTINCT FROM "Baja" OR opens0 IS DISTINCT FROM "Opens")
SELECT "Email", "Baja", "Opens", lead(valid_from) OVER w IS NULL AS is_current, valid_from,
  coalesce(lead(valid_from) OVER w, TIMESTAMP '2200-01-01') AS valid_to
FROM s WINDOW w AS (PARTITION BY "Email" ORDER BY valid_from)"""
    ),
)
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables_left(spark, sf_dir)["history"]


@query(
    "run_metrics",
    daily(
        f"""{AUDIT},
i AS (SELECT batch_id, {by_step('{n}').format('batch_id')} AS step, {by_step("'{run}'").format('batch_id')} AS rundate,
  {LOADED.format('batch_id')} AS loaded_at, count(*) AS n FROM v GROUP BY ALL),
w AS (SELECT metadata_batch_id AS batch_id, count(*) AS n FROM a GROUP BY metadata_batch_id),
m AS (SELECT i.*, coalesce(w.n, 0) AS kept FROM i LEFT JOIN w USING (batch_id))
SELECT 'raw_visits' AS table_name, batch_id, rundate, loaded_at, n AS initial_rows, n AS final_rows,
  (SELECT sum(n) FROM m x WHERE x.step <= m.step)::BIGINT AS accumulated_rows FROM m
UNION ALL SELECT 'audit_visits', batch_id, rundate, loaded_at, n, kept,
  (SELECT sum(kept) FROM m x WHERE x.step <= m.step)::BIGINT FROM m"""
    ),
)
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history's own row depends on the number of versions and is left to `run_history`."""
    columns = ["table_name", "batch_id", "rundate", "loaded_at", "initial_rows", "final_rows", "accumulated_rows"]
    return tables_left(spark, sf_dir)["metrics"].where("table_name <> 'historic_visits'").select(*columns)


SUMMED = daily(f"""{AUDIT} {GOLD} FROM a WHERE metadata_audit_id = 1 GROUP BY "Email" """)


@query("run_gold", SUMMED)
def run_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables_left(spark, sf_dir)["gold"]


@query("run_gold_by_batches", SUMMED)
def run_gold_by_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary kept from one run to the next, of which each reads its own batches only."""
    return tables_left(spark, sf_dir)["gold_kept"]


@query("run_export_visitor", SUMMED)
def run_export_visitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables_left(spark, sf_dir)["export_visitor"]


@query(
    "run_export_statistic",
    daily(f"""{AUDIT} SELECT event_id, "Email", "FechaEnvio", "Baja", "Opens", "Links", {BATCH} FROM a WHERE metadata_audit_id = 1"""),
)
def run_export_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables_left(spark, sf_dir)["export_statistic"]


@query("run_export_events", daily(f"{EVENTS} SELECT * FROM e"))
def run_export_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables_left(spark, sf_dir)["export_event_errors"]


@query(
    "file_profile",
    daily(
        f"""{V} SELECT batch_id AS metadata_batch_id, count(*) AS n_rows,
      count(DISTINCT email) + CAST(max(CASE WHEN email IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_distinct FROM v GROUP BY batch_id"""
    ),
)
def file_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and different visitors of each of the daily files, whose headers differ."""
    folder = shared_dir(spark, "reports")
    rows = delivered(spark, sf_dir).withColumn(BATCH, F.substring(BATCH, 1, 8))
    late = F.col(BATCH) > "20240115"
    deliver(spark, rows.where(~late), f"{folder}/early")
    deliver(spark, rows.where(late).withColumnRenamed("jk", "fgh"), f"{folder}/late")
    return profile_files(spark, folder, "email", aliases=f.RAW.aliases)["files"]
