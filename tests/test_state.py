"""State kept from one batch to the next: known keys, profile sketches, events seen."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tierflow.operators.profiling import merged_profile, profile_sketches
from tierflow.plans.key_index import KeyIndex
from tierflow.streaming.events import log_once

SCHEMA = "a string, b int, v int, batch string"


@pytest.fixture
def index(spark, tables):
    out = KeyIndex(tables, "c.s.known", ["a", "b"])
    out.create(spark.createDataFrame([], SCHEMA).schema, parts=4, buckets=2)
    return out


def test_repeats_of_earlier_batches(spark, index):
    first = spark.createDataFrame([("x", 1, 1, "1"), ("x", 1, 2, "1"), ("y", 1, 3, "1"), (None, 1, 4, "1"), ("z", None, 5, "1")], SCHEMA)
    assert index.repeats(first, "batch").isEmpty()
    index.add(first, "batch")
    # A batch is no repeat of itself, nor are keys with a NULL part.
    assert index.repeats(first, "batch").isEmpty()
    second = spark.createDataFrame([("x", 1, 6, "2"), ("x", 2, 7, "2"), (None, 1, 8, "2"), ("z", None, 9, "2"), ("x", 1, 10, "2")], SCHEMA)
    for _ in range(2):
        assert rows(index.repeats(second, "batch"), "v", "first_batch") == [(10, "1"), (6, "1")]
        index.add(second, "batch")
    third = spark.createDataFrame([("x", 2, 11, "3"), ("w", 2, 12, "3"), ("y", 1, 13, "2")], SCHEMA)
    assert rows(index.repeats(third, "batch"), "v", "first_batch") == [(11, "2"), (13, "1")]
    assert rows(index.tables.read_keyed("c.s.known")) == [("x", 1, "1"), ("x", 2, "2"), ("y", 1, "1")]
    assert index.repeats(third.limit(0), "batch").isEmpty()


def test_key_that_fills_a_batch(spark, index):
    index.add(spark.createDataFrame([("hot", 1, 0, "1"), ("cold", 1, 0, "1")], SCHEMA), "batch")
    batch = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id)) AS a", "1 AS b", "CAST(id AS INT) AS v", "'2' AS batch")
    found = index.repeats(batch, "batch", hot_rows=100, small_rows=0)
    assert found.count() == 1000 and found.columns == ["a", "b", "v", "batch", "first_batch"]


def test_known_keys_are_not_shuffled(spark, index):
    index.add(spark.createDataFrame([("x", 1, 0, "1")], SCHEMA), "batch")
    buckets = index.tables.key_layout("c.s.known")[1]
    keys = spark.createDataFrame([("x", 1)], "a string, b int").repartition(buckets, "a", "b")
    plan = index.tables.read("c.s.known").join(keys.hint("merge"), ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1


def test_sketches_merge_to_the_profile_of_all_rows(spark):
    df = spark.range(20_000).selectExpr(
        "id % 10 AS batch", "id % 7000 AS n", "if(id % 4 = 0, NULL, concat('v', id % 300)) AS s", "id / 2.0D AS x", "CAST(NULL AS STRING) AS none"
    )
    parts = [profile_sketches(df.where(F.col("batch") == b), ["n", "s", "x", "none"], ["batch"]) for b in range(10)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    got = {r.column_name: r for r in merged_profile(whole, [0.0, 0.25, 0.5, 1.0]).collect()}
    assert {c: (r.n_rows, r.n_null, r.least, r.greatest) for c, r in got.items()} == {
        "n": (20_000, 0, "0", "999"),
        "s": (20_000, 5000, "v1", "v99"),
        "x": (20_000, 0, "0.0", "9999.5"),
        "none": (20_000, 20_000, None, None),
    }
    exact = {"n": 7000, "s": df.select("s").distinct().count() - 1, "x": 20_000, "none": 0}
    assert all(abs(got[c].n_distinct - n) <= 0.03 * n for c, n in exact.items())
    assert got["s"].quantiles is None and got["none"].quantiles is None
    low, quarter, half, high = got["x"].quantiles
    assert (low, high) == (0.0, 9999.5) and abs(quarter - 2500) < 200 and abs(half - 5000) < 200
    # Batches merge to the same whatever the order, and no rows give no profile.
    assert merged_profile(whole.limit(0)).isEmpty()
    assert profile_sketches(df.limit(0), ["n"], ["batch"]).isEmpty()


def test_events_of_overlapping_deliveries_are_logged_once(spark, tmp_path):
    schema = "error_event_id string, v int, arrived_at timestamp"
    source, log, checkpoint = (str(tmp_path / x) for x in ("in", "log", "checkpoint"))

    def deliver(day, *events):
        at = datetime(2024, 1, day)
        spark.createDataFrame([(i, v, at) for i, v in events], schema).coalesce(1).write.mode("append").parquet(source)
        log_once(spark.readStream.schema(schema).parquet(source), log, checkpoint, "arrived_at", "3 days").awaitTermination()
        return rows(spark.read.schema(schema).parquet(log), "error_event_id", "v")

    assert deliver(1, ("a", 1), ("b", 1), ("b", 1)) == [("a", 1), ("b", 1)]
    assert deliver(2, ("b", 2), ("c", 2)) == [("a", 1), ("b", 1), ("c", 2)]
    assert deliver(2, ("a", 3)) == [("a", 1), ("b", 1), ("c", 2)]
    # Ids are remembered for three days; after that one counts as new.
    assert len(deliver(20, ("d", 4))) == 4
    assert ("c", 5) in deliver(21, ("c", 5))
