import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tierflow.operators.export import events_differential, members, of_batches, run_batches, statistic_differential, visitor_differential
from tierflow.operators.keys import assign_ids, lookup_ids
from tierflow.operators.metrics import METRIC_SCHEMA, ingestion_metrics, pending_batches, table_metrics
from tierflow.operators.profiling import approximate_key_summary, column_summary, frequency_of_frequencies, key_frequencies, key_summary, most_frequent, value_counts
from tierflow.operators.skew import hot_keys, lookup_join, semi_join
from tierflow.operators.summary import visitor_summary
from tierflow.plans.spec import ColumnSpec, TableSpec

SPEC = TableSpec("c", "s", "t", (ColumnSpec("k"),), etl_module="m", quality="silver", table_id=4)


# ---- surrogate keys


def dimension(spark, *values):
    return spark.createDataFrame(list(values), "id int, name string, version int")


def test_lookup_trims_and_compares_as_text(spark):
    df = spark.createDataFrame([(" a ", "1"), ("b", "1")], "name string, version string")
    dim = dimension(spark, (7, "a", 1))
    assert rows(lookup_ids(df, dim, ["name", "version"], "id")) == [(" a ", "1", 7), ("b", "1", None)]
    with pytest.raises(Exception, match="No id for"):
        lookup_ids(df, dim, ["name", "version"], "id", required=True).collect()


def test_lookup_errors(spark):
    dim = dimension(spark, (7, "a", 1), (8, "a", 1))
    df = spark.createDataFrame([("a", 1)], "name string, version int")
    with pytest.raises(Exception, match="more than once"):
        lookup_ids(df, dim, ["name", "version"], "id").collect()
    other = spark.createDataFrame([("b", 1)], "name string, version int")
    assert rows(lookup_ids(other, dim, ["name", "version"], "id")) == [("b", 1, None)]
    for blank in (None, "  "):
        bad = spark.createDataFrame([(blank, 1)], "name string, version int")
        with pytest.raises(Exception, match="without a value"):
            lookup_ids(bad, dim, ["name", "version"], "id").collect()


def test_assigned_ids_continue_without_gaps(spark):
    df = spark.createDataFrame([(f"n{i % 50}", 1) for i in range(200)], "name string, version int")
    dim = dimension(spark, (3, "n1", 1), (9, "n2", 1))
    out = assign_ids(df, dim, ["name", "version"], "id").collect()
    assert {(r["name"], r["id"]) for r in out if not r["is_new"]} == {("n1", 3), ("n2", 9)}
    assert sorted(r["id"] for r in out if r["is_new"]) == list(range(10, 58))


def test_first_ids_start_at_one_in_the_given_order(spark):
    df = spark.createDataFrame([("b", 1, 2), ("a", 1, 1), ("c", 1, 3)], "name string, version int, pos int")
    empty = spark.createDataFrame([], "id int, name string, version int")
    out = assign_ids(df, empty, ["name", "version"], "id", F.col("version"), ["pos"])
    assert rows(out, "name", "id") == [("a", 1), ("b", 2), ("c", 3)]


# ---- metrics


def test_metrics_per_batch(spark):
    before = spark.createDataFrame([("7",), ("7",), ("8",)], "b string")
    after = spark.createDataFrame([("7",)], "b string")
    out = ingestion_metrics(before, after, before, "b", SPEC, "20240101_000000", "2024-01-01 00:00:00")
    assert out.schema.names == METRIC_SCHEMA.names
    assert rows(out, "batch_id", "initial_rows", "final_rows", "accumulated_rows", "table_id") == [("7", 2, 1, 3, 4), ("8", 1, 0, 3, 4)]
    whole = table_metrics(spark, SPEC, "r", "2024-01-01 00:00:00", 1, 2)
    assert rows(whole, "batch_id", "initial_rows", "final_rows", "accumulated_rows") == [("all", 1, 2, 2)]


def test_pending_batches(spark):
    found = spark.createDataFrame([("7",), ("8",), ("9",)], "batch_id string")
    done = spark.createDataFrame(
        [("c", "s", "t", "7"), ("c", "s", "other", "8")], "catalog_name string, schema_name string, table_name string, batch_id string"
    )
    assert rows(pending_batches(found, done, SPEC)) == [("8",), ("9",)]
    with pytest.raises(Exception, match="Several metrics rows"):
        pending_batches(found, done.unionByName(done), SPEC).collect()


# ---- skew


def test_hot_keys_and_lookup_join(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, F.lit(-1)).otherwise(F.col("id")).alias("k"), "id"
    )
    lookup = spark.range(0, 3000, 2).select(F.col("id").alias("k"), F.lit(True).alias("hit")).unionByName(
        spark.createDataFrame([(-1, True)], "k long, hit boolean")
    )
    assert hot_keys(df, ["k"], 900).count() == 2
    assert hot_keys(df, ["k"], 1001) is None
    for how in ("left", "inner", "left_semi", "left_anti"):
        split = lookup_join(df, lookup, ["k"], how, hot_rows=900)
        plain = df.join(lookup, ["k"], how)
        assert split.columns == plain.columns
        assert rows(split) == rows(plain)
    with pytest.raises(ValueError, match="Unsupported join"):
        lookup_join(df, lookup, ["k"], "full")


def test_hot_rows_are_dealt_over_several_tasks(spark):
    """One join serves all keys; the rows of a hot key are spread by a salt."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lookup = spark.range(3000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
        joined = lookup_join(df, lookup, ["k"], "left", hot_rows=100)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        largest = joined.withColumn("task", F.spark_partition_id()).groupBy("task").count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert plan.count("SortMergeJoin") == 1 and "_salt" in plan
    assert joined.count() == 3000 and joined.where("v = 1").count() == 3000
    # The key alone has 1,001 rows.
    assert largest < 1000


@pytest.mark.parametrize("small_rows", [100, 1])
def test_semi_join_with_short_and_long_lists(spark, small_rows):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4)], "k string, v int")
    ids = spark.createDataFrame([("a",), ("a",), ("c",)], "k string")
    for hot_rows in (1, 1000):
        assert rows(semi_join(df, ids, "k", small_rows, hot_rows), "k", "v") == [("a", 1), ("a", 3)]


# ---- differentials


def test_differentials(spark):
    metrics = spark.createDataFrame(
        [("c", "s", "t", "7", "r1"), ("c", "s", "t", "8", "r2"), ("c", "s", "other", "9", "r1")],
        "catalog_name string, schema_name string, table_name string, batch_id string, rundate string",
    )
    batches = run_batches(metrics, "r1", SPEC)
    assert rows(batches) == [("7",)]
    audited = spark.createDataFrame(
        [("a", "7", True), ("b", "7", False), ("c", "8", True), ("a", "8", True)],
        "k string, metadata_batch_id string, metadata_audit_passed boolean",
    )
    visitor = spark.createDataFrame([("a", 2), ("b", 0), ("c", 1)], "k string, n int")
    assert rows(visitor_differential(visitor, audited, batches, "k")) == [("a", 2), ("b", 0)]
    assert rows(statistic_differential(audited, batches, ["k"])) == [("a", "7")]
    events = spark.createDataFrame([("e1", "7", "t"), ("e2", "8", "t"), ("e3", "7", "u")], "id string, batch_id string, table_name string")
    assert rows(events_differential(events, batches), "id") == [("e1",), ("e3",)]
    assert rows(events_differential(events, batches, ["t"]), "id") == [("e1",)]
    assert rows(members(visitor, "k", ["a", "z"])) == [("a", 2)]
    assert of_batches(audited, batches).columns[-1] == "metadata_audit_passed"


# ---- summary and profile


def test_visitor_summary(spark):
    df = spark.createDataFrame(
        [("a", "2024-01-05"), ("a", "2024-02-05"), ("a", "2023-02-05"), ("a", None), ("b", "2022-01-01")], "k string, d string"
    ).select("k", F.col("d").cast("timestamp").alias("at"))
    out = visitor_summary(df, "k", "at", "20240201_000000").selectExpr(
        "k", "cast(fechaPrimeraVisita as date)", "cast(fechaUltimaVisita as date)", "visitasTotales", "visitasAnioActual", "visitasMesActual"
    )
    assert [(r[0], str(r[1]), str(r[2]), *r[3:]) for r in rows(out)] == [
        ("a", "2023-02-05", "2024-02-05", 4, 2, 1),
        ("b", "2022-01-01", "2022-01-01", 1, 0, 0),
    ]


def test_profile(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "x"), (None, 1, "x")], "k string, n int, d string")
    counts = value_counts(df, ["k", "n"])
    assert rows(counts) == [("k", "a", 2), ("k", "b", 1), ("k", None, 1), ("n", "1", 3), ("n", "2", 1)]
    assert rows(column_summary(counts)) == [("k", 4, 3, 1), ("n", 4, 2, 0)]
    assert rows(key_summary(df, "k")) == rows(approximate_key_summary(df, "k")) == [(4, 3)]
    assert rows(key_summary(df, "k", ["n"])) == [(1, 3, 3), (2, 1, 1)]
    frequencies = key_frequencies(df, "k", "d")
    assert [tuple(r) for r in most_frequent(frequencies, "k").collect()] == [("a", 1), ("b", 1)]
    assert rows(frequency_of_frequencies(frequencies)) == [(1, 2)]
