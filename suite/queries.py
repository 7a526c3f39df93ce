"""The query list: every operator over whole tables, next to the SQL that must give the same rows.

`QUERIES` maps a name to `(spark, sf_dir) -> DataFrame`; `ORACLES` maps it to DuckDB SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suite import feed as f
from suite.feed import feed, table
from tierflow.functions.cleaning import clean_text, list_to_json
from tierflow.functions.hashing import hash_key
from tierflow.functions.types import record
from tierflow.operators.conform import BATCH, PASSED, column_difference_rows, conform, null_counts
from tierflow.operators.events import error_events as error_event_rows
from tierflow.operators.export import (
    events_differential,
    members,
    run_batches,
    statistic_differential,
    visitor_differential,
)
from tierflow.operators.history import (
    current_versions,
    empty_history,
    scd2_actions,
    scd2_apply,
    scd2_insert,
    scd2_rebuild,
    versions_at,
)
from tierflow.operators.keys import assign_ids, lookup_ids, max_value
from tierflow.operators.metrics import ingestion_metrics, pending_batches
from tierflow.operators.profiling import (
    column_summary,
    frequency_of_frequencies,
    key_frequencies,
    key_summary,
    merged_profile,
    most_frequent,
    profile_sketches,
    value_counts,
)
from tierflow.operators.screening import Screening, failing_rows
from tierflow.operators.skew import SMALL_ROWS, lookup_join
from tierflow.operators.summary import visitor_summary
from tierflow.operators.upsert import upsert
from tierflow.plans.governance import (
    CATALOG_SCHEMA,
    DETAIL_SCHEMA,
    SCHEMA_SCHEMA,
    TABLE_SCHEMA,
    column_rows,
    seed_rows,
    table_rows,
)
from tierflow.plans.key_index import KeyIndex
from tierflow.plans.keyed_history import KeyedHistory
from tierflow.plans.layers import audit_events, audit_rows, passed_rows
from tierflow.plans.spec import SPEC_SCHEMA, layer_attributes, resolve_layers
from tierflow.session import materialize, shared_dir
from tierflow.sources.landing import SEMICOLON, discover, read_files
from tierflow.sources.specs import read_specs, write_specs
from tierflow.sources.tables import Tables, write_csv
from tierflow.streaming.events import log_once

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    """Register a query with its oracle. Times leave without a zone, as the tables hold them."""

    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return without_zone(function(spark, sf_dir))

        QUERIES[name] = run
        ORACLES[name] = sql
        return run

    return register


def without_zone(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.col(c).cast("timestamp_ntz").alias(c) if kind == "timestamp" else F.col(c) for c, kind in df.dtypes]
    )


V = f"WITH v AS ({f.DUCKDB_FEED})"
CLEAN = "nullif(nullif(replace(links, 'unknown', ''), '-'), '')"
JSON = "CAST(to_json(list_filter(string_split({}, ','), lambda x: x <> '')) AS VARCHAR)"
BAD_EMAIL = r"(email IS NOT NULL AND NOT regexp_matches(email, '^.+@.+\..+$'))"
BAD_LIST = "(baja IS NOT NULL AND baja NOT IN ('click', 'view', 'purchase', 'signup'))"
BAD_BOUNDS = "(opens < 0 OR opens > 100)"
PARSED = "try_strptime(fechaenvio, '%d/%m/%Y %H:%M')"
BAD_DATE = (
    rf"(fechaenvio IS NOT NULL AND NOT coalesce(regexp_full_match(fechaenvio, '\d\d/\d\d/\d\d\d\d \d\d:\d\d') "
    rf"AND {PARSED} IS NOT NULL, false))"
)
LOADED = f"TIMESTAMP '{f.LOADED_AT}'"
AUDIT = f"""{V},
k AS (SELECT *, email IS NOT NULL AND count(*) OVER (PARTITION BY batch_id, email) > 1 AS repeated FROM v),
a AS (
  SELECT event_id,
    CASE WHEN NOT {BAD_EMAIL} THEN email END AS "Email",
    CASE WHEN NOT {BAD_DATE} THEN {PARSED} END AS "FechaEnvio",
    CASE WHEN NOT {BAD_LIST} THEN baja END AS "Baja",
    CASE WHEN NOT {BAD_BOUNDS} THEN opens END AS "Opens",
    {JSON.format(CLEAN)} AS "Links",
    CASE WHEN email IS NULL OR {BAD_EMAIL} OR {BAD_DATE} OR {BAD_LIST} OR coalesce({BAD_BOUNDS}, false) THEN 2 ELSE 1 END
      AS metadata_audit_id,
    batch_id AS metadata_batch_id
  FROM k WHERE NOT repeated)"""
EVENTS = f"""{V},
x AS (
  SELECT 'Email' AS column_name, 'is_not_null' AS screen_code, batch_id, email, CAST(NULL AS VARCHAR) AS original
    FROM v WHERE email IS NULL
  UNION ALL SELECT 'Email', 'is_email_format', batch_id, email, email FROM v WHERE {BAD_EMAIL}
  UNION ALL SELECT 'Baja', 'is_in_list', batch_id, email, baja FROM v WHERE {BAD_LIST}
  UNION ALL SELECT 'Opens', 'is_in_bounds', batch_id, email, CAST(opens AS VARCHAR) FROM v WHERE {BAD_BOUNDS}
  UNION ALL SELECT 'FechaEnvio', 'is_date_format', batch_id, email, fechaenvio FROM v WHERE {BAD_DATE}
  UNION ALL SELECT 'Email', 'is_primary_key', batch_id, email, email FROM v WHERE email IS NOT NULL
    GROUP BY batch_id, email HAVING count(*) > 1),
e AS (
  SELECT md5(concat_ws('||', '{f.CATALOG}', '{f.SCHEMA}', 'audit_visits', column_name, batch_id, coalesce(email, ''),
      screen_code)) AS error_event_id,
    batch_id, screen_code, '{f.CATALOG}' AS catalog_name, '{f.SCHEMA}' AS schema_name,
    'audit_visits' AS table_name, column_name, email AS record_identifier, min(original) AS original_value,
    CAST(NULL AS VARCHAR) AS replaced_value, 'Sin Resolver' AS error_condition
  FROM x GROUP BY batch_id, screen_code, column_name, email)"""


# ---- landing, conforming, cleaning


def delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed as a report: text columns, a legacy column name and a blank in another."""
    text = feed(spark, sf_dir).select(
        F.col("event_id").cast("string"),
        "email",
        F.col("fechaenvio").alias("fecha envio"),
        "baja",
        F.col("opens").cast("string"),
        F.col("links").alias("jk"),
        F.col("batch_id").alias(BATCH),
    )
    return text


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(delivered(spark, sf_dir), f.RAW, f.LOADED_AT)


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_rows(raw(spark, sf_dir), f.AUDIT, f.LOADED_AT, f.HOOK)


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_events(raw(spark, sf_dir), f.AUDIT, f.HOOK)


@query(
    "land_conform",
    f"""{V} SELECT event_id, email, fechaenvio, baja, opens, links, batch_id AS metadata_batch_id,
      {LOADED} AS metadata_loaded_at, 'visits__load' AS metadata_etl_module FROM v""",
)
def land_conform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir)


@query(
    "csv_round_trip",
    f"""{V} SELECT CAST(event_id AS VARCHAR) AS event_id, email, fechaenvio, baja,
      CAST(opens AS VARCHAR) AS opens, nullif(links, '') AS links, batch_id FROM v""",
)
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as two deliveries with different headers, read back by column name."""
    folder = shared_dir(spark, "reports")
    rows = delivered(spark, sf_dir).withColumnRenamed(BATCH, "batch_id")
    early = F.col("batch_id") < "2024011600"
    write_csv(rows.where(early), f"{folder}/early")
    swapped = [*reversed([c for c in rows.columns if c != "jk"]), "jk"]
    write_csv(rows.where(~early).select(*swapped).withColumnRenamed("jk", "fgh"), f"{folder}/late")
    return read_files(spark, discover(spark, folder, "*.csv"), aliases=f.RAW.aliases).select(*f.RAW.names, "batch_id")


COLUMNS = ["event_id", "email", "batch_id", "fechaenvio", "baja", "opens", "links"]


@query(
    "nullability_report",
    V + " UNION ALL ".join(f" SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n_null FROM v" for c in COLUMNS),
)
def nullability_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return null_counts(feed(spark, sf_dir), COLUMNS)


@query("clean_tokens", f"{V} SELECT event_id, {CLEAN} AS links FROM v")
def clean_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, sf_dir).select("event_id", clean_text(F.col("links")).alias("links"))


@query("list_to_json", f"{V} SELECT event_id, {JSON.format(CLEAN)} AS links FROM v")
def list_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, sf_dir).select("event_id", list_to_json(clean_text(F.col("links"))).alias("links"))


# ---- screens


def feed_failures(column: str, screen: str, params: dict, batch: str | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        failing = failing_rows(feed(spark, sf_dir), (column, screen, params), batch)
        return failing.select("event_id", "batch_id", F.col(column).cast("string").alias("value"))

    return run


for name, column, code, params, condition in [
    ("dq_not_null", "email", "is_not_null", {}, "email IS NULL"),
    ("dq_in_list", "baja", "is_in_list", {"allowed": f.ALLOWED}, BAD_LIST),
    ("dq_email", "email", "is_email_format", {}, BAD_EMAIL),
    ("dq_bounds", "opens", "is_in_bounds", {"min_allowed": 0, "max_allowed": 100}, BAD_BOUNDS),
    ("dq_date_format", "fechaenvio", "is_date_format", {"format": f.DATE_PATTERN}, BAD_DATE),
]:
    query(name, f"{V} SELECT event_id, batch_id, CAST({column} AS VARCHAR) AS value FROM v WHERE {condition}")(
        feed_failures(column, code, params)
    )

query(
    "dq_primary_key",
    f"""{V}, k AS (SELECT *, count(*) OVER (PARTITION BY batch_id, email) AS n FROM v WHERE email IS NOT NULL)
      SELECT event_id, batch_id, email AS value FROM k WHERE n > 1""",
)(feed_failures("email", "is_primary_key", {}, "batch_id"))

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


@query(
    "dq_unique_group",
    f"""SELECT {', '.join(LINE)} FROM (
      SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1""",
)
def dq_unique_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = ("l_orderkey,l_linenumber", "is_unique", {"columns": ["l_orderkey", "l_linenumber"]})
    return failing_rows(table(spark, sf_dir, "lineitem").select(*LINE), item)


@query(
    "dq_foreign_key",
    """SELECT o_orderkey, o_custkey FROM orders
      WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def dq_foreign_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    building = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    item = ("o_custkey", "is_in_foreign_column", {"table": "customer", "reference": "c_custkey"})
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return failing_rows(orders, item, references={"customer": building})


@query(
    "dq_not_lower_than",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, o_orderdate
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate""",
)
def dq_not_lower_than(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    dated = lookup_join(lines, orders, ["l_orderkey"], "inner")
    return failing_rows(dated, ("l_shipdate", "is_not_lower_than", {"reference": "o_orderdate"}))


DATED = "SELECT lineitem.*, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
REPEATED_LINE = "count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1"
FEW_KINDS = "p_size <= 25"
SCREENED = f"""WITH d AS ({DATED}), x AS (SELECT *, {REPEATED_LINE} AS repeated,
  l_partkey NOT IN (SELECT p_partkey FROM part WHERE {FEW_KINDS}) AS orphan, l_quantity < 2 OR l_quantity > 40 AS beyond,
  l_returnflag NOT IN ('A', 'N') AS unlisted, l_shipdate < o_orderdate AS early FROM d)"""


def screened_lines(spark: SparkSession, sf_dir: str) -> Screening:
    """Line items through every kind of screen that the feed does not have, in one plan."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate"
    )
    plan = [
        ("l_orderkey,l_linenumber", "is_unique", {"columns": ["l_orderkey", "l_linenumber"]}),
        ("l_partkey", "is_in_foreign_column", {"table": "part", "reference": "p_partkey"}),
        ("l_quantity", "is_in_bounds", {"min_allowed": 2, "max_allowed": 40}),
        ("l_returnflag", "is_in_list", {"allowed": "A,N"}),
        ("l_shipdate", "is_not_lower_than", {"reference": "o_orderdate"}),
    ]
    parts = table(spark, sf_dir, "part").where(FEW_KINDS)
    dated = lookup_join(lines, orders, ["l_orderkey"], "inner")
    return Screening(dated, plan, ["l_orderkey"], references={"part": parts}, like=lines)


@query(
    "screen_lines",
    f"""{SCREENED} SELECT l_orderkey, l_linenumber, CASE WHEN NOT orphan THEN l_partkey END AS l_partkey,
      CASE WHEN NOT beyond THEN l_quantity END AS l_quantity, CASE WHEN NOT unlisted THEN l_returnflag END AS l_returnflag,
      CASE WHEN NOT early THEN l_shipdate END AS l_shipdate, o_orderdate,
      NOT (repeated OR orphan OR beyond OR unlisted OR early) AS metadata_audit_passed FROM x""",
)
def screen_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screened_lines(spark, sf_dir).audited()


@query(
    "screen_lines_failures",
    SCREENED
    + " UNION ALL ".join(
        f""" SELECT CAST(l_orderkey AS VARCHAR) AS record_identifier, '{column}' AS column_name, '{code}' AS screen_code,
        {value} AS original_value FROM x WHERE {condition}"""
        for column, code, value, condition in [
            ("l_orderkey,l_linenumber", "is_unique", "concat(l_orderkey, '||', l_linenumber)", "repeated"),
            ("l_partkey", "is_in_foreign_column", "CAST(l_partkey AS VARCHAR)", "orphan"),
            ("l_quantity", "is_in_bounds", "CAST(l_quantity AS VARCHAR)", "beyond"),
            ("l_returnflag", "is_in_list", "l_returnflag", "unlisted"),
            ("l_shipdate", "is_not_lower_than", "CAST(l_shipdate AS VARCHAR)", "early"),
        ]
    ),
)
def screen_lines_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screened_lines(spark, sf_dir).failures()


@query(
    "screen_bounds",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity BETWEEN 2 AND 40 THEN l_quantity END AS l_quantity,
      CASE WHEN l_discount <= 0.08 THEN l_discount END AS l_discount,
      l_quantity BETWEEN 2 AND 40 AND l_discount <= 0.08 AS metadata_audit_passed FROM lineitem""",
)
def screen_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    plan = [
        ("l_quantity", "is_in_bounds", {"min_allowed": 2, "max_allowed": 40}),
        ("l_discount", "is_in_bounds", {"min_allowed": 0, "max_allowed": 0.08}),
    ]
    return Screening(lines, plan, ["l_orderkey"]).audited()


@query(
    "composite_events",
    f"""WITH x AS (SELECT CASE WHEN l_linenumber % 3 > 0 THEN l_orderkey END AS k, CASE WHEN l_linenumber % 3 < 2 THEN l_linenumber END AS n,
      strftime(l_shipdate, '%Y') AS batch, l_quantity FROM lineitem),
    i AS (SELECT concat(coalesce(CAST(k AS VARCHAR), '\\N'), '||', coalesce(CAST(n AS VARCHAR), '\\N')) AS id, batch, l_quantity FROM x WHERE l_quantity > 48)
    SELECT md5(concat_ws('||', '{f.CATALOG}', '{f.SCHEMA}', 'lines', 'l_quantity', batch, id, 'is_in_bounds')) AS error_event_id,
      batch AS batch_id, id AS record_identifier, min(CAST(l_quantity AS VARCHAR)) AS original_value FROM i GROUP BY ALL""",
)
def composite_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of records whose key has two parts, one or the other of them NULL."""
    number = F.col("l_linenumber") % 3
    lines = table(spark, sf_dir, "lineitem").select(
        F.when(number > 0, F.col("l_orderkey")).alias("k"),
        F.when(number < 2, F.col("l_linenumber")).alias("n"),
        F.date_format("l_shipdate", "yyyy").alias("batch"),
        "l_quantity",
    )
    plan = [("l_quantity", "is_in_bounds", {"min_allowed": 0, "max_allowed": 48})]
    failures = Screening(lines, plan, ["k", "n"], "batch").failures()
    events = error_event_rows(failures, "batch", f.CATALOG, f.SCHEMA, "lines")
    return events.select("error_event_id", "batch_id", "record_identifier", "original_value")


@query(
    "audit_table",
    f"""{AUDIT} SELECT *, metadata_audit_id = 1 AS metadata_audit_passed, {LOADED} AS metadata_loaded_at,
      'visits__audit' AS metadata_etl_module, CAST(NULL AS TIMESTAMP) AS metadata_created_at,
      CAST(NULL AS TIMESTAMP) AS metadata_updated_at, CAST(NULL AS TIMESTAMP) AS metadata_deleted_at FROM a""",
)
def audit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(spark, sf_dir)


@query("error_events", f"{EVENTS} SELECT * FROM e")
def error_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_log(spark, sf_dir)


@query("events_once", f"{EVENTS} SELECT * FROM e")
def events_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries of the event log that share half of it, taken in as a stream."""
    folder = shared_dir(spark, "event-stream")
    log = materialize(events_log(spark, sf_dir), "events")
    schema = None
    for day, share in ((1, "substr(error_event_id, 1, 1) < 'b'"), (2, "substr(error_event_id, 1, 1) > '4'")):
        delivered = log.where(share).withColumn("arrived_at", F.lit(f"2024-02-0{day} 00:00:00").cast("timestamp"))
        delivered.write.mode("append").parquet(f"{folder}/in")
        schema = delivered.schema
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        log_once(stream, f"{folder}/log", f"{folder}/checkpoint", "arrived_at", "7 days").awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/log").drop("arrived_at")


# ---- keys


@query(
    "unique_across_batches",
    """WITH b AS (SELECT o_custkey, o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS batch FROM orders),
      f AS (SELECT o_custkey, min(batch) AS first_batch FROM b GROUP BY o_custkey)
      SELECT o_orderkey, o_custkey, batch, first_batch FROM b JOIN f USING (o_custkey) WHERE batch <> first_batch""",
)
def unique_across_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers that an earlier year's batch delivered before, by an index of the customers."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").cast("string").alias("batch"))
    index = KeyIndex(Tables(spark, shared_dir(spark, "tables")), f"suite_{uuid.uuid4().hex}.silver.customers", ["o_custkey"])
    index.create(orders.schema, parts=8, buckets=4)
    found = []
    for years in ("batch < '1995'", "batch BETWEEN '1995' AND '1996'", "batch > '1996'"):
        rows = orders.where(years)
        # A delivery's own keys go in first, so repeats between its batches are found as well.
        index.add(rows, "batch")
        found.append(materialize(index.repeats(rows, "batch"), "repeats"))
    return reduce(DataFrame.unionByName, found).select("o_orderkey", "o_custkey", "batch", "first_batch")


@query(
    "hash_key",
    """SELECT c_custkey, md5(concat_ws('||', coalesce(n_name, ''), coalesce(c_mktsegment, ''), coalesce(c_name, ''),
      CAST(c_custkey AS VARCHAR))) AS customer_key
      FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def hashed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    named = lookup_join(table(spark, sf_dir, "customer"), nations, ["c_nationkey"], "left", small_rows=SMALL_ROWS)
    return named.select("c_custkey", hash_key(["n_name", "c_mktsegment", "c_name", "c_custkey"]).alias("customer_key"))


@query(
    "surrogate_keys",
    """WITH known AS (SELECT c_name, c_mktsegment, c_custkey AS id FROM customer WHERE c_acctbal >= 0),
      fresh AS (SELECT DISTINCT c_name, c_mktsegment FROM customer WHERE c_acctbal < 0)
      SELECT c_name, c_mktsegment, id, false AS is_new FROM known
      UNION ALL
      SELECT c_name, c_mktsegment, (SELECT max(id) FROM known) + row_number() OVER (ORDER BY
        substr(md5(concat_ws('||', c_name, c_mktsegment)), 1, 3), c_name, c_mktsegment) AS id, true AS is_new FROM fresh""",
)
def surrogate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in credit are registered already, under their own number."""
    customers = table(spark, sf_dir, "customer")
    known = customers.where("c_acctbal >= 0").select("c_name", "c_mktsegment", F.col("c_custkey").alias("id"))
    return assign_ids(customers.select("c_name", "c_mktsegment"), known, ["c_name", "c_mktsegment"], "id")


@query(
    "dimension_lookup",
    """SELECT c_custkey, n_name, r_name, r_regionkey, n_nationkey FROM customer
      JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def dimension_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by name in two steps, as for a schema within its catalog."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    names = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name"
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    named = lookup_join(customers, names, ["c_nationkey"], "inner", small_rows=SMALL_ROWS).drop("c_nationkey")
    in_region = lookup_ids(named, regions, ["r_name"], "r_regionkey", required=True)
    in_nation = nations.withColumnRenamed("n_regionkey", "r_regionkey")
    return lookup_ids(in_region, in_nation, ["r_regionkey", "n_name"], "n_nationkey", required=True)


@query("largest_key", "SELECT max(o_orderkey) AS max_value FROM orders")
def largest_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_value(table(spark, sf_dir, "orders"), "o_orderkey")


# ---- upserts: orders known by the end of 1998, then a delivery that starts with 1998

ORDER = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def known_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderdate < timestamp_ntz'1999-01-01'").select(*ORDER)


def new_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later orders with a changed price; those in progress lose their priority."""
    return (
        table(spark, sf_dir, "orders")
        .where("o_orderdate >= timestamp_ntz'1998-01-01'")
        .select(
            "o_orderkey",
            "o_custkey",
            F.lit("X").alias("o_orderstatus"),
            (F.col("o_totalprice") + 1).alias("o_totalprice"),
            F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("o_orderpriority"),
        )
    )


UPSERTED = """WITH m AS (SELECT *, o_orderdate < TIMESTAMP '1999-01-01' AS known,
  o_orderdate >= TIMESTAMP '1998-01-01' AS given,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS new_priority FROM orders)
SELECT o_orderkey, o_custkey, """


@query(
    "upsert_all",
    UPSERTED
    + """CASE WHEN given THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
      CASE WHEN given THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
      CASE WHEN given THEN new_priority ELSE o_orderpriority END AS o_orderpriority FROM m""",
)
def upsert_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert(known_orders(spark, sf_dir), new_orders(spark, sf_dir), ["o_orderkey"])


@query(
    "upsert_columns",
    UPSERTED
    + """CASE WHEN given AND NOT known THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
      CASE WHEN given THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
      CASE WHEN given THEN new_priority ELSE o_orderpriority END AS o_orderpriority FROM m""",
)
def upsert_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    updated = ["o_totalprice", "o_orderpriority"]
    return upsert(known_orders(spark, sf_dir), new_orders(spark, sf_dir), ["o_orderkey"], updated)


@query(
    "upsert_altered_at",
    UPSERTED
    + """CASE WHEN given THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
      CASE WHEN NOT given THEN TIMESTAMP '1999-01-01' WHEN known THEN TIMESTAMP '1999-01-01'
        ELSE TIMESTAMP '2002-01-01' END AS created_at,
      CASE WHEN given AND known THEN TIMESTAMP '2002-01-01' END AS updated_at FROM m""",
)
def upsert_altered_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two merges: the first inserts all, the second updates the overlap and inserts the rest."""
    keep = ["o_orderkey", "o_custkey", "o_orderstatus"]
    times = {c: F.lit(None).cast("timestamp") for c in ("created_at", "updated_at")}
    first = known_orders(spark, sf_dir).select(*keep).withColumns(times)
    second = new_orders(spark, sf_dir).select(*keep).withColumns(times)
    options = dict(created_col="created_at", updated_col="updated_at")
    once = upsert(first.limit(0), first, ["o_orderkey"], at="1999-01-01 00:00:00", **options)
    return upsert(once, second, ["o_orderkey"], at="2002-01-01 00:00:00", **options)


# ---- tables


@query(
    "partition_overwrite",
    f"""{V} SELECT event_id, email, CASE WHEN substr(batch_id, 1, 8) = '20240117' THEN opens + 1 ELSE opens END AS opens,
      substr(batch_id, 1, 8) AS metadata_batch_id FROM v WHERE substr(batch_id, 1, 8) <> '20240105'""",
)
def partition_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One day delivered again with other values, another day delivered empty; the rest stays."""
    tables = Tables(spark, shared_dir(spark, "tables"))
    name = f"suite_{uuid.uuid4().hex}.bronze.raw_visits"
    rows = feed(spark, sf_dir).select("event_id", "email", "opens", F.substring("batch_id", 1, 8).alias(BATCH))
    tables.write(rows, name)
    again = tables.read(name, "read_partition", batch_id="20240117").withColumn("opens", F.col("opens") + 1)
    tables.write(again, name, batches=["20240117", "20240105"])
    return tables.read(name)


@query(
    "table_sql",
    """SELECT o_custkey, n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' AND o_totalprice > 1000 GROUP BY o_custkey, n_name""",
)
def table_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables by name in SQL with bound values; one of them replaced as a whole before."""
    tables, database = Tables(spark, shared_dir(spark, "tables")), f"suite_{uuid.uuid4().hex}.silver"
    for name in ("orders", "customer", "nation"):
        tables.replace(table(spark, sf_dir, name), f"{database}.{name}")
    tables.replace(tables.read(f"{database}.orders").where("o_totalprice > 1000"), f"{database}.orders")
    found = tables.sql(
        """SELECT o_custkey, n_name, count(*) AS n FROM {orders} JOIN {customer} ON o_custkey = c_custkey
          JOIN {nation} ON c_nationkey = n_nationkey WHERE o_orderstatus = :status GROUP BY o_custkey, n_name""",
        {"status": "F"},
        **{name: f"{database}.{name}" for name in ("orders", "customer", "nation")},
    )
    return materialize(found, "table-sql")


@query(
    "semicolon_round_trip",
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment, substr(c_mktsegment, 1, 1) AS batch FROM customer",
)
def semicolon_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as text with another separator, a file group per segment."""
    folder = shared_dir(spark, "reports")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    write_csv(rows.withColumn("batch", F.substring("c_mktsegment", 1, 1)), folder, ";")
    return read_files(spark, discover(spark, folder, "*.csv"), SEMICOLON).select("c_custkey", "c_name", "c_mktsegment", "batch")


@query(
    "table_upsert",
    f"""{V} SELECT event_id, CASE WHEN substr(batch_id, 1, 8) >= '20240115' THEN opens + 1 ELSE opens END AS opens,
      substr(batch_id, 1, 8) AS metadata_batch_id FROM v""",
)
def table_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries that share some days, merged into a table that rewrites only the days at hand."""
    tables = Tables(spark, shared_dir(spark, "tables"))
    name = f"suite_{uuid.uuid4().hex}.silver.audit_visits"
    rows = feed(spark, sf_dir).select("event_id", "opens", F.substring("batch_id", 1, 8).alias(BATCH))
    days = [r[0] for r in rows.select(BATCH).distinct().collect()]
    keys = ["event_id", BATCH]
    first, second = [d for d in days if d < "20240120"], [d for d in days if d >= "20240115"]
    tables.upsert(name, rows.where(F.col(BATCH) < "20240120"), keys, batches=first, partition_by=[BATCH])
    changed = rows.where(F.col(BATCH) >= "20240115").withColumn("opens", F.col("opens") + 1)
    tables.upsert(name, changed, keys, batches=second)
    return tables.read(name)


@query(
    "upsert_bucketed",
    UPSERTED
    + """CASE WHEN given THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
      CASE WHEN given THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
      CASE WHEN given THEN new_priority ELSE o_orderpriority END AS o_orderpriority FROM m""",
)
def upsert_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two merges into a table kept by key, the second of which leaves parts without its keys alone."""
    tables, name = Tables(spark, shared_dir(spark, "tables")), f"suite_{uuid.uuid4().hex}.silver.orders"
    known, new = known_orders(spark, sf_dir), new_orders(spark, sf_dir)
    tables.create_keyed(name, known.schema, ["o_orderkey"], parts=16, buckets=4)
    tables.merge(name, known, ["o_orderkey"])
    tables.merge(name, new, ["o_orderkey"])
    return tables.read_keyed(name)


@query(
    "passed_rows",
    f"""{AUDIT} SELECT event_id, "Email", "FechaEnvio", "Opens", metadata_batch_id FROM a WHERE metadata_audit_id = 1""",
)
def read_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passed_rows(audited(spark, sf_dir)).select("event_id", "Email", "FechaEnvio", "Opens", BATCH)


# ---- history of a customer's order status

STATUS = {"key": ["o_custkey"], "tracked": ["o_orderstatus"]}
LATEST = """SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus
  FROM orders WHERE o_orderdate {} GROUP BY o_custkey"""
REBUILD = """WITH last AS (
  SELECT o_custkey, o_orderdate, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus
  FROM orders GROUP BY o_custkey, o_orderdate),
p AS (SELECT *, lag(o_orderstatus) OVER w AS before, row_number() OVER w AS n FROM last
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)),
s AS (SELECT * FROM p WHERE n = 1 OR before IS DISTINCT FROM o_orderstatus),
h AS (SELECT o_custkey, o_orderstatus, lead(o_orderdate) OVER w IS NULL AS is_current, o_orderdate AS valid_from,
  coalesce(lead(o_orderdate) OVER w, TIMESTAMP '2200-01-01') AS valid_to FROM s
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate))"""


def order_status(spark: SparkSession, sf_dir: str, condition: str = "true") -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .where(condition)
        .select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))
    )


def rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scd2_rebuild(order_status(spark, sf_dir), **STATUS, version_ts="o_orderdate", tie=["o_orderkey"])


EARLY, LATE, ALL = "< TIMESTAMP '1998-01-01'", ">= TIMESTAMP '1998-01-01'", "IS NOT NULL"
BEFORE_1998 = "o_orderdate < timestamp_ntz'1998-01-01'"
SINCE_1998 = "o_orderdate >= timestamp_ntz'1998-01-01'"
T1, T2 = "1998-01-01 00:00:00", "2002-01-01 00:00:00"
ORDERED = ["o_orderdate", "o_orderkey"]


def applied(spark: SparkSession, sf_dir: str, first: str, second: str) -> DataFrame:
    one, two = order_status(spark, sf_dir, first), order_status(spark, sf_dir, second)
    start = scd2_apply(empty_history(one, **STATUS), one, **STATUS, now=T1, order=ORDERED)
    return scd2_apply(start, two, **STATUS, now=T2, order=ORDERED)


def applied_sql(first: str, second: str) -> str:
    return f"""WITH o AS ({LATEST.format(first)}), n AS ({LATEST.format(second)}),
    j AS (SELECT coalesce(o.o_custkey, n.o_custkey) AS o_custkey, o.o_orderstatus AS old, n.o_orderstatus AS new,
      o.o_custkey IS NOT NULL AS had, n.o_custkey IS NOT NULL AS has
      FROM o FULL JOIN n ON o.o_custkey = n.o_custkey),
    c AS (SELECT *, CASE WHEN NOT has THEN 'DELETE' WHEN NOT had THEN 'INSERT'
      WHEN old IS NOT DISTINCT FROM new THEN 'NO_ACTION' ELSE 'UPDATE' END AS action FROM j)
    """


APPLIED = """SELECT o_custkey, old AS o_orderstatus, action = 'NO_ACTION' AS is_current,
  TIMESTAMP '1998-01-01' AS valid_from,
  CASE WHEN action = 'NO_ACTION' THEN TIMESTAMP '2200-01-01' ELSE TIMESTAMP '2002-01-01' END AS valid_to
  FROM c WHERE had
UNION ALL SELECT o_custkey, new, true, TIMESTAMP '2002-01-01', TIMESTAMP '2200-01-01'
  FROM c WHERE action IN ('INSERT', 'UPDATE')"""


@query("history_rebuild", f"{REBUILD} SELECT * FROM h")
def history_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt(spark, sf_dir)


HOT_REBUILD = REBUILD.replace("o_custkey", "o_orderpriority").replace("arg_max(o_orderstatus, o_orderkey)", "max(o_orderstatus)")


@query("history_hot", f"{HOT_REBUILD} SELECT * FROM h")
def history_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few keys with long histories, cut into slices of 50 rows: some 60 slices a key at the smallest scale."""
    orders = table(spark, sf_dir, "orders")
    return scd2_rebuild(orders, ["o_orderpriority"], ["o_orderstatus"], "o_orderdate", hot_rows=50)


@query("history_current", f"{REBUILD} SELECT * FROM h WHERE is_current")
def history_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_versions(rebuilt(spark, sf_dir))


@query(
    "history_as_of",
    f"{REBUILD} SELECT * FROM h WHERE valid_from <= TIMESTAMP '1998-07-01' AND TIMESTAMP '1998-07-01' < valid_to",
)
def history_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions_at(rebuilt(spark, sf_dir), "1998-07-01 00:00:00")


@query("history_apply", applied_sql(EARLY, ALL) + APPLIED)
def history_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return applied(spark, sf_dir, BEFORE_1998, "true")


@query("history_delete", applied_sql(EARLY, LATE) + APPLIED)
def history_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second snapshot holds only recent orders: customers without any are closed."""
    return applied(spark, sf_dir, BEFORE_1998, SINCE_1998)


# (condition, time) of deliveries that each hold the orders of some years.
DELIVERIES = [
    ("o_orderdate < timestamp_ntz'1996-01-01'", "1996-01-01 00:00:00"),
    ("o_orderdate >= timestamp_ntz'1996-01-01' AND o_orderdate < timestamp_ntz'1998-01-01'", "1998-01-01 00:00:00"),
    (SINCE_1998, "2002-01-01 00:00:00"),
]
BY_DELIVERY = """WITH last AS (
  SELECT o_custkey, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN TIMESTAMP '1996-01-01'
    WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN TIMESTAMP '1998-01-01' ELSE TIMESTAMP '2002-01-01' END AS o_orderdate,
    arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY ALL),""" + REBUILD.split("),", 1)[1]


def kept_by_key(spark: SparkSession, sf_dir: str) -> KeyedHistory:
    tables = Tables(spark, shared_dir(spark, "tables"))
    history = KeyedHistory(tables, f"suite_{uuid.uuid4().hex}.silver.status", ["o_custkey"], ["o_orderstatus"])
    history.create(table(spark, sf_dir, "orders").schema, parts=16, buckets=4)
    for n, (condition, now) in enumerate(DELIVERIES):
        history.apply(order_status(spark, sf_dir, condition), now, f"step-{n}", ORDERED)
    return history


@query("history_keyed", f"{BY_DELIVERY} SELECT * FROM h")
def history_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three deliveries into a history kept by key; who is not delivered stays."""
    return kept_by_key(spark, sf_dir).read()


@query(
    "history_keyed_as_of",
    f"{BY_DELIVERY} SELECT * FROM h WHERE valid_from <= TIMESTAMP '1999-07-01' AND TIMESTAMP '1999-07-01' < valid_to",
)
def history_keyed_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed versions of the months before are not read."""
    return kept_by_key(spark, sf_dir).at("1999-07-01 00:00:00")


BETWEEN = DELIVERIES[1][0]


@query("history_late", f"{REBUILD} SELECT * FROM h")
def history_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of 1996 and 1997 arrive last."""
    in_time = order_status(spark, sf_dir, f"NOT ({BETWEEN})")
    late = order_status(spark, sf_dir, BETWEEN)
    history = materialize(scd2_rebuild(in_time, **STATUS, version_ts="o_orderdate", tie=["o_orderkey"]), "status-history")
    return scd2_insert(history, late, in_time, **STATUS, version_ts="o_orderdate", tie=["o_orderkey"])


@query("history_keyed_late", f"{BY_DELIVERY} SELECT * FROM h")
def history_keyed_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delivery of 1998 arrives after that of 2002, in a history kept by key."""
    tables = Tables(spark, shared_dir(spark, "tables"))
    history = KeyedHistory(tables, f"suite_{uuid.uuid4().hex}.silver.status", ["o_custkey"], ["o_orderstatus"])
    history.create(table(spark, sf_dir, "orders").schema, parts=16, buckets=4)
    first, between, last = (
        order_status(spark, sf_dir, condition).withColumn("applied_at", F.lit(now).cast("timestamp"))
        for condition, now in DELIVERIES
    )
    history.apply(first, DELIVERIES[0][1], "step-0", ORDERED)
    history.apply(last, DELIVERIES[2][1], "step-2", ORDERED)
    history.insert(between, first.unionByName(last), "applied_at", "step-1", ORDERED)
    return history.read()


@query("history_actions", applied_sql(EARLY, LATE) + "SELECT action, count(*) AS n FROM c GROUP BY action")
def history_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = order_status(spark, sf_dir, BEFORE_1998), order_status(spark, sf_dir, SINCE_1998)
    start = scd2_apply(empty_history(one, **STATUS), one, **STATUS, now=T1, order=ORDERED)
    return scd2_actions(start, two, **STATUS, order=ORDERED)


# ---- metrics and batch control


@query(
    "ingestion_metrics",
    f"""{AUDIT}, i AS (SELECT batch_id, count(*) AS n FROM v GROUP BY batch_id),
      w AS (SELECT metadata_batch_id AS batch_id, count(*) AS n FROM a GROUP BY metadata_batch_id)
      SELECT CAST(NULL AS INTEGER) AS table_id, '{f.CATALOG}' AS catalog_name, '{f.SCHEMA}' AS schema_name,
        'audit_visits' AS table_name, '{f.RUNDATE}' AS rundate, i.batch_id, {LOADED} AS loaded_at,
        'visits__audit' AS etl_module, 'merge_incremental' AS write_mode, i.n AS initial_rows,
        coalesce(w.n, 0) AS final_rows, (SELECT count(*) FROM a) AS accumulated_rows, 'silver' AS quality
      FROM i LEFT JOIN w ON i.batch_id = w.batch_id""",
)
def metrics_per_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = audited(spark, sf_dir)
    return ingestion_metrics(raw(spark, sf_dir), kept, kept, BATCH, f.AUDIT, f.RUNDATE, f.LOADED_AT)


def daily_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics as they are after a run per day: one row per batch, the day as run id."""
    batches = feed(spark, sf_dir).groupBy("batch_id").agg(F.count("*").alias("initial_rows"))
    return batches.withColumns(
        {
            "catalog_name": F.lit(f.CATALOG),
            "schema_name": F.lit(f.SCHEMA),
            "table_name": F.lit("audit_visits"),
            "rundate": F.concat(F.substring("batch_id", 1, 8), F.lit("_000000")),
        }
    )


@query("pending_batches", f"{V} SELECT DISTINCT batch_id FROM v WHERE batch_id >= '2024011600'")
def batches_to_do(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of the month is loaded; the other batches are still to do."""
    found = feed(spark, sf_dir).select("batch_id").distinct()
    done = daily_metrics(spark, sf_dir).where("rundate < '20240116_000000'")
    return pending_batches(found, done, f.AUDIT)


# ---- summary and differentials

SUMMARY = """SELECT {key}, min({at}) AS "fechaPrimeraVisita", max({at}) AS "fechaUltimaVisita",
  count({key}) AS "visitasTotales", count(*) FILTER (year({at}) = {year}) AS "visitasAnioActual",
  count(*) FILTER (year({at}) = {year} AND month({at}) = {month}) AS "visitasMesActual" """
GOLD = SUMMARY.format(key='"Email"', at='"FechaEnvio"', year=2024, month=1)


@query("gold_visitor", f"""{AUDIT} {GOLD} FROM a WHERE metadata_audit_id = 1 GROUP BY "Email" """)
def gold_visitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visitor_summary(passed_rows(audited(spark, sf_dir)), "Email", "FechaEnvio", f.RUNDATE)


@query(
    "gold_orders",
    SUMMARY.format(key="o_custkey", at="o_orderdate", year=1998, month=3) + "FROM orders GROUP BY o_custkey",
)
def gold_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visitor_summary(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "19980301_000000")


RUN_DAY = f.RUNDATE[:8]


def batches_of_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_batches(daily_metrics(spark, sf_dir), f.RUNDATE, f.AUDIT)


@query(
    "export_visitor",
    f"""{AUDIT}, g AS ({GOLD} FROM a WHERE metadata_audit_id = 1 GROUP BY "Email")
      SELECT * FROM g WHERE "Email" IN (SELECT "Email" FROM a WHERE substr(metadata_batch_id, 1, 8) = '{RUN_DAY}')""",
)
def export_visitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = audited(spark, sf_dir)
    visitor = visitor_summary(passed_rows(kept), "Email", "FechaEnvio", f.RUNDATE)
    return visitor_differential(visitor, kept, batches_of_run(spark, sf_dir), "Email")


@query(
    "export_statistic",
    f"""{AUDIT} SELECT event_id, "Email", "FechaEnvio", "Baja", "Opens", "Links", metadata_batch_id
      FROM a WHERE metadata_audit_id = 1 AND substr(metadata_batch_id, 1, 8) = '{RUN_DAY}'""",
)
def export_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistic_differential(audited(spark, sf_dir), batches_of_run(spark, sf_dir), f.AUDIT.names)


@query("export_events", f"{EVENTS} SELECT * FROM e WHERE substr(batch_id, 1, 8) = '{RUN_DAY}'")
def export_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_differential(events_log(spark, sf_dir), batches_of_run(spark, sf_dir))


@query(
    "inspect_rows",
    f"""{AUDIT} SELECT event_id, "Email", "Baja", metadata_batch_id FROM a
      WHERE "Baja" = 'purchase' AND "Email" IN ('user1@example.com', 'user2@example.com', 'user3@example.com')""",
)
def inspect_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality and membership filters, a column list and an order."""
    wanted = members(audited(spark, sf_dir).where("Baja = 'purchase'"), "Email", [f"user{i}@example.com" for i in (1, 2, 3)])
    return wanted.select("event_id", "Email", "Baja", BATCH).orderBy("Email", "event_id")


# ---- profile

PROFILED = ["event_id", "ts", "user_id", "event_type", "value", "props"]
# Times and amounts in a form that both engines write alike.
COUNTS = "WITH p AS (SELECT * REPLACE (strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, CAST(value AS DECIMAL(18, 4)) AS value) FROM events), c AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM p GROUP BY {c}" for c in PROFILED
) + ")"


def profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = {"ts": F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "value": F.col("value").cast("decimal(18,4)")}
    return value_counts(table(spark, sf_dir, "events").withColumns(written), PROFILED)


@query("profile_values", f"{COUNTS} SELECT * FROM c")
def profile_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiled(spark, sf_dir)


@query(
    "profile_columns",
    f"""{COUNTS} SELECT column_name, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct,
      CAST(coalesce(sum(n) FILTER (value IS NULL), 0) AS BIGINT) AS n_null FROM c GROUP BY column_name""",
)
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_summary(profiled(spark, sf_dir))


@query("profile_most_frequent", "SELECT user_id, count(ts) AS n FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def profile_most_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return most_frequent(key_frequencies(table(spark, sf_dir, "events"), "user_id", "ts"), "user_id")


@query(
    "profile_keys",
    f"""{V} SELECT substr(batch_id, 1, 8) AS day, count(*) AS n_rows,
      count(DISTINCT email) + max(CASE WHEN email IS NULL THEN 1 ELSE 0 END) AS n_distinct FROM v GROUP BY day""",
)
def profile_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_summary(feed(spark, sf_dir).withColumn("day", F.substring("batch_id", 1, 8)), "email", ["day"])


@query(
    "profile_frequencies",
    """WITH c AS (SELECT o_custkey, count(o_orderdate) AS n FROM orders GROUP BY o_custkey)
      SELECT n, count(*) AS n_keys FROM c GROUP BY n""",
)
def profile_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency_of_frequencies(key_frequencies(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate"))


# ---- specs: one asset per brand, one column per part

PARTS = """WITH p AS (SELECT lower(replace(p_brand, '#', '')) AS asset, CAST(p_partkey AS INTEGER) AS pos,
  p_partkey, p_size, p_retailprice, p_name, p_type FROM part),
raw AS (SELECT asset, 'raw' AS layer, concat('c', p_partkey) AS column_name, pos, CAST(NULL AS VARCHAR) AS rename_from,
  CASE WHEN p_size > 25 THEN 'integer' ELSE 'string' END AS data_type, p_size = 1 AS is_primary_key,
  p_size <> 1 AS is_nullable, false AS is_partition, p_type LIKE '%STEEL%' AS is_pii, p_name AS comment FROM p),
audit AS (SELECT asset, 'audit' AS layer, CASE WHEN p_size > 10 THEN concat('C', p_partkey) ELSE concat('c', p_partkey) END
  AS column_name, pos, concat('c', p_partkey) AS source,
  CASE WHEN p_retailprice > 1500 THEN 'timestamp' END AS data_type, CAST(NULL AS BOOLEAN) AS is_pii FROM p),
filled AS (SELECT a.asset, a.layer, a.column_name, a.pos, a.source AS rename_from,
  coalesce(a.data_type, r.data_type) AS data_type, r.is_primary_key, r.is_nullable, r.is_partition, r.is_pii, r.comment
  FROM audit a JOIN raw r ON a.asset = r.asset AND a.source = r.column_name),
historic AS (SELECT asset, 'historic' AS layer, column_name, pos, column_name AS rename_from, data_type,
  is_primary_key, is_nullable, is_partition, is_pii, comment FROM filled),
s AS (SELECT * FROM raw UNION ALL SELECT * FROM filled UNION ALL SELECT * FROM historic)"""


def part_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumns(
        {
            "asset": F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))),
            "ordinal_position": F.col("p_partkey").cast("int"),
        }
    )
    delivered_name = F.concat(F.lit("c"), "p_partkey")
    audit_name = F.when(F.col("p_size") > 10, F.concat(F.lit("C"), "p_partkey")).otherwise(delivered_name)
    shared = {
        "domain": F.lit("domain"),
        "subdomain": F.lit("analytics"),
        "version": F.lit(1),
        "owner": F.lit("team"),
        "retention_policy": F.lit("permanent"),
    }
    layers = {
        "raw": {
            "column_name": delivered_name,
            "data_type": F.when(F.col("p_size") > 25, "integer").otherwise("string"),
            "is_primary_key": F.col("p_size") == 1,
            "is_nullable": F.col("p_size") != 1,
            "is_partition": F.lit(False),
            "is_pii": F.col("p_type").contains("STEEL"),
            "comment": F.col("p_name"),
            "write_mode": F.lit("overwrite_partition"),
        },
        "audit": {
            "column_name": audit_name,
            "rename_from": F.when(F.col("p_size") > 10, delivered_name),
            "data_type": F.when(F.col("p_retailprice") > 1500, "timestamp"),
            "write_mode": F.lit("merge_incremental"),
        },
        "historic": {"column_name": audit_name, "track_changes": F.lit(True), "write_mode": F.lit("historic")},
    }
    frames = []
    for layer, values in layers.items():
        given = {**shared, **values, "layer": F.lit(layer)}
        carried = ("asset", "ordinal_position")
        frames.append(
            parts.select(
                *[
                    (F.col(x.name) if x.name in carried else given.get(x.name, F.lit(None))).cast(x.dataType).alias(x.name)
                    for x in SPEC_SCHEMA.fields
                ]
            )
        )
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


SPEC_OUT = ["asset", "layer", "column_name", "rename_from", "data_type", "is_primary_key", "is_nullable", "is_partition", "is_pii", "comment"]


@query("spec_inheritance", f"{PARTS} SELECT {', '.join(SPEC_OUT)} FROM s")
def spec_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_layers(part_specs(spark, sf_dir)).select(*SPEC_OUT)


REGISTERED = f"""{PARTS}, t AS (
  SELECT asset, layer, row_number() OVER (ORDER BY asset, CASE layer WHEN 'raw' THEN 1 WHEN 'audit' THEN 2 ELSE 3 END)
    AS table_id FROM (SELECT DISTINCT asset, layer FROM s))"""


def registered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(resolved specs, table rows) for an empty registry."""
    catalogs, schemas = seed_rows("analytics", "team", "2025-01-01 00:00:00", "lake")
    resolved = materialize(layer_attributes(resolve_layers(part_specs(spark, sf_dir))), "specs")
    entries = table_rows(
        resolved,
        spark.createDataFrame(catalogs, CATALOG_SCHEMA),
        spark.createDataFrame(schemas, SCHEMA_SCHEMA),
        spark.createDataFrame([], TABLE_SCHEMA),
        "2025-01-01 00:00:00",
    )
    return resolved, entries


@query(
    "spec_registration",
    f"""{REGISTERED} SELECT CAST(table_id AS INTEGER) AS table_id,
      CAST(CASE layer WHEN 'raw' THEN 3 ELSE 4 END AS INTEGER) AS schema_id,
      concat(layer, '_', asset) AS table_name,
      concat(asset, '__', CASE layer WHEN 'raw' THEN 'load' WHEN 'audit' THEN 'audit' ELSE 'hist' END) AS etl_module,
      CASE layer WHEN 'raw' THEN 'overwrite_partition' WHEN 'audit' THEN 'merge_incremental' ELSE 'historic' END AS write_mode,
      CASE layer WHEN 'raw' THEN 'bronze' ELSE 'silver' END AS quality, true AS current_flag,
      TIMESTAMP '2025-01-01' AS valid_from, TIMESTAMP '2200-01-01' AS valid_to FROM t""",
)
def spec_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ["table_id", "schema_id", "table_name", "etl_module", "write_mode", "quality", "current_flag", "valid_from", "valid_to"]
    return registered(spark, sf_dir)[1].select(*out)


@query(
    "spec_columns",
    f"""{REGISTERED} SELECT CAST(t.table_id AS INTEGER) AS table_id,
      CAST(row_number() OVER (ORDER BY t.table_id, pos) AS INTEGER) AS column_id, column_name, rename_from, data_type,
      pos AS ordinal_position, is_primary_key, is_nullable, is_pii FROM s JOIN t ON s.asset = t.asset AND s.layer = t.layer""",
)
def spec_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved, entries = registered(spark, sf_dir)
    out = ["table_id", "column_id", "column_name", "rename_from", "data_type", "ordinal_position", "is_primary_key", "is_nullable", "is_pii"]
    return column_rows(resolved, materialize(entries, "entries"), spark.createDataFrame([], DETAIL_SCHEMA)).select(*out)


# ---- all layers in one plan


@query(
    "flagship",
    f"""{AUDIT} {GOLD} FROM a WHERE metadata_audit_id = 1 GROUP BY "Email" """,
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered rows through conforming, cleaning, screening and key check to the visitor summary."""
    rows = audit_rows(raw(spark, sf_dir), f.AUDIT, f.LOADED_AT, f.HOOK)
    return visitor_summary(rows.where(F.col(PASSED)), "Email", "FechaEnvio", f.RUNDATE)


import suite.runs  # noqa: E402,F401  registers the queries over whole runs


SKETCHED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@query(
    "profile_merged",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, min(CAST({c} AS VARCHAR)) AS least,
      max(CAST({c} AS VARCHAR)) AS greatest, true AS distinct_near, true AS median_near FROM orders"""
        for c in SKETCHED
    ),
)
def profile_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches per year, merged: distinct values within 3 percent, the median within 2 percent of the ranks."""
    orders = table(spark, sf_dir, "orders")
    per_year = materialize(profile_sketches(orders.withColumn("year", F.year("o_orderdate")), SKETCHED, ["year"]), "sketches")
    merged = materialize(merged_profile(per_year), "profile")
    median = lambda c: merged.where(F.col("column_name") == c).select(F.col("quantiles")[0]).scalar()
    checks = []
    for c in SKETCHED:
        number = c.endswith("key")
        rank = F.avg((F.col(c) <= median(c)).cast("int")) if number else F.lit(0.5)
        checks.append(orders.agg(F.lit(c).alias("column_name"), F.count_distinct(c).alias("exact"), rank.alias("rank")))
    out = merged.join(reduce(DataFrame.unionByName, checks), "column_name")
    near = F.abs(F.col("n_distinct") - F.col("exact")) <= 0.03 * F.col("exact")
    return out.select("column_name", "n_rows", "n_null", "least", "greatest", near.alias("distinct_near"), F.col("rank").between(0.48, 0.52).alias("median_near"))


@query(
    "spec_documents",
    f"""{PARTS} SELECT asset, layer, column_name, rename_from, data_type, is_primary_key, is_nullable, is_pii, comment,
      CAST(row_number() OVER (PARTITION BY asset, layer ORDER BY pos) AS INTEGER) AS ordinal_position FROM s""",
)
def specs_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specs written as one document per asset, read back and resolved."""
    folder = shared_dir(spark, "assets")
    write_specs(part_specs(spark, sf_dir), folder)
    resolved = layer_attributes(resolve_layers(materialize(read_specs(spark, folder), "documents")))
    return resolved.select(
        "asset", "layer", "column_name", "rename_from", "data_type", "ordinal_position", "is_primary_key", "is_nullable", "is_pii", "comment"
    )


@query(
    "spec_column_differences",
    f"""{PARTS}, d AS (SELECT asset, column_name FROM s WHERE layer = 'raw'), a AS (SELECT asset, column_name FROM s WHERE layer = 'audit')
      SELECT coalesce(d.asset, a.asset) AS asset, coalesce(d.column_name, a.column_name) AS column_name,
        CASE WHEN a.asset IS NULL THEN 'delivered but not declared' ELSE 'declared but not delivered' END AS problem
      FROM d FULL JOIN a ON d.asset = a.asset AND d.column_name = a.column_name WHERE d.asset IS NULL OR a.asset IS NULL""",
)
def spec_column_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the raw layers deliver against what the audit layers declare, for all assets."""
    specs = part_specs(spark, sf_dir)
    return column_difference_rows(specs.where("layer = 'raw'"), specs.where("layer = 'audit'"), ["asset"])


@query(
    "catalog_comments",
    """SELECT lower(replace(p_brand, '#', '')) AS asset, concat('c', p_partkey) AS column_name,
      CASE WHEN p_size > 25 THEN 'int' ELSE 'string' END AS data_type, p_name AS comment FROM part""",
)
def catalog_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table per asset, defined from its spec with a comment on each column, as the catalog has them."""
    tables, database = Tables(spark, shared_dir(spark, "tables")), f"suite_{uuid.uuid4().hex}.bronze"
    raw_layer = part_specs(spark, sf_dir).where("layer = 'raw'")
    one = F.struct("ordinal_position", "column_name", "data_type", "comment")
    assets = materialize(raw_layer.groupBy("asset").agg(F.sort_array(F.collect_list(one)).alias("columns")), "assets")
    found = []
    # One asset at a time: neither this process nor the catalog holds the columns of all.
    for a in assets.toLocalIterator():
        name = f"{database}.{a.asset}"
        schema = record(**{c.column_name: c.data_type for c in a["columns"]})
        tables.create(name, schema, comments={c.column_name: c.comment for c in a["columns"]})
        found.append(materialize(tables.comment_rows([name]), "comments"))
        tables.drop([name])
    found = reduce(DataFrame.unionByName, found)
    return found.select(F.element_at(F.split("table_name", "[.]"), -1).alias("asset"), "column_name", "data_type", "comment")
