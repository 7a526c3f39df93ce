from datetime import datetime, timedelta
from itertools import groupby

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import tierflow.operators.history as history_module
from tests.conftest import rows
from tierflow.operators.history import (
    current_versions,
    empty_history,
    scd2_actions,
    scd2_apply,
    scd2_insert,
    scd2_rebuild,
    versions_at,
)

START = datetime(2024, 1, 1)
END = datetime(2200, 1, 1)
SCHEMA = "k string, t timestamp, n int, a string, b string"


def changes(spark, items):
    """items: (key, day, tie, a, b)"""
    return spark.createDataFrame([(k, START + timedelta(days=d), n, a, b) for k, d, n, a, b in items], SCHEMA)


def expected_history(items):
    """Row-at-a-time model of a rebuild."""
    out = []
    order = sorted(items, key=lambda r: (repr(r[0]), r[1], r[2]))
    for key, group in groupby(order, key=lambda r: r[0]):
        last = {r[1]: (r[3], r[4]) for r in group}
        starts = []
        for day, state in sorted(last.items()):
            if not starts or starts[-1][1] != state:
                starts.append((day, state))
        ends = [d for d, _ in starts[1:]] + [None]
        for (day, state), end in zip(starts, ends):
            out.append((key, *state, end is None, START + timedelta(days=day), START + timedelta(days=end) if end is not None else END))
    return sorted(out, key=repr)


def rebuild(spark, items, **options):
    return scd2_rebuild(changes(spark, items), ["k"], ["a", "b"], "t", ["n"], **options)


def test_batches_in_order(spark):
    items = [("x", 0, 0, "1", None), ("x", 1, 0, "2", None), ("x", 2, 0, "3", None)]
    assert rows(rebuild(spark, items)) == expected_history(items)
    assert rebuild(spark, items).count() == 3


def test_equal_value_opens_no_version_and_moved_null_does(spark):
    assert rebuild(spark, [("x", 0, 0, "1", None), ("x", 1, 0, "1", None)]).count() == 1
    assert rebuild(spark, [("x", 0, 0, "1", None), ("x", 1, 0, None, "1")]).count() == 2


def test_late_rows_are_placed_by_time(spark):
    items = [("x", 5, 0, "late", None), ("x", 0, 0, "early", None)]
    assert rows(current_versions(rebuild(spark, items)), "a") == [("late",)]


def test_row_without_time_is_an_error(spark):
    df = spark.createDataFrame([("x", None, 0, "1", None)], SCHEMA)
    with pytest.raises(Exception, match="without a version time"):
        scd2_rebuild(df, ["k"], ["a", "b"], "t", ["n"]).collect()


item = st.tuples(
    st.sampled_from(["x", "y", None]),
    st.integers(0, 12),
    st.integers(0, 10_000),
    st.sampled_from(["p", "q", None]),
    st.sampled_from(["p", None]),
)
items_strategy = st.lists(item, max_size=40, unique_by=lambda r: (r[0], r[1], r[2]))
relaxed = settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@relaxed
@given(items_strategy)
def test_rebuild_equals_row_at_a_time_model(spark, items):
    assert rows(rebuild(spark, items)) == expected_history(items)


@relaxed
@given(items_strategy)
def test_sliced_rebuild_equals_model(spark, items):
    """Every key counts as hot, and slices are so short that most versions cross their borders."""
    assert rows(rebuild(spark, items, hot_rows=1)) == expected_history(items)


def test_one_key_with_a_third_of_all_rows(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
        (F.lit(START) + F.make_interval(mins=F.col("id").cast("int"))).alias("t"),
        F.col("id").cast("int").alias("n"),
        (F.col("id") / 12).cast("int").cast("string").alias("a"),
        F.lit(None).cast("string").alias("b"),
    )
    split = scd2_rebuild(df, ["k"], ["a", "b"], "t", ["n"], hot_rows=500)
    assert rows(split) == rows(scd2_rebuild(df, ["k"], ["a", "b"], "t", ["n"]))
    assert split.where("k = 'hot'").count() == 250


@pytest.mark.parametrize("slices", [3, 64, 1000])
def test_slices_follow_the_rows_of_a_key(spark, slices):
    """A key with 4,000 rows and one with a tenth of them: as many slices as their rows ask for, of even size."""
    size = -(-4000 // (slices - 1))
    df = spark.range(4400).select(
        F.when(F.col("id") < 4000, "long").otherwise("short").alias("k"),
        (F.lit(START) + F.make_interval(mins=(F.col("id") * 37 % 4400).cast("int"))).alias("t"),
        F.col("id").cast("int").alias("n"),
        (F.col("id") * 37 % 4400 / 3).cast("int").cast("string").alias("a"),
        F.lit(None).cast("string").alias("b"),
    )
    split = scd2_rebuild(df, ["k"], ["a", "b"], "t", ["n"], hot_rows=size)
    assert rows(split) == rows(scd2_rebuild(df, ["k"], ["a", "b"], "t", ["n"]))
    hot = history_module.hot_keys(df, ["k"], size)
    most = hot.agg(F.max("_parts")).first()[0]
    cuts = history_module._time_cuts(df, hot, ["k"], "t", most)
    micros = F.unix_micros("t")
    placed = df.withColumn("_h", history_module.key_hash(["k"])).join(cuts, "_h")
    counts = placed.groupBy("k", history_module._slice_of(micros, most).alias("s")).count().collect()
    per_key = {k: [r["count"] for r in counts if r.k == k] for k in ("long", "short")}
    assert len(per_key["long"]) == -(-4000 // size) + 1
    assert all(max(own) <= 2 * size for own in per_key.values() if own)


def snapshot(spark, *values):
    return spark.createDataFrame(list(values), "k string, o int, a string, b string")


def history(spark, *values):
    return spark.createDataFrame(
        list(values), "k string, a string, b string, is_current boolean, valid_from timestamp, valid_to timestamp"
    )


def apply(old, new, day, **options):
    return scd2_apply(old, new, ["k"], ["a", "b"], START + timedelta(days=day), ["o"], **options)


def test_first_run_opens_all(spark):
    new = snapshot(spark, ("x", 1, "1", None), ("x", 2, "2", None), ("y", 1, None, None))
    out = apply(empty_history(new, ["k"], ["a", "b"]), new, 0)
    assert rows(out) == [("x", "2", None, True, START, END), ("y", None, None, True, START, END)]


def test_closed_rows_stay_and_unchanged_snapshot_changes_nothing(spark):
    old = history(
        spark,
        ("x", "1", None, False, START, START + timedelta(days=1)),
        ("x", "2", None, True, START + timedelta(days=1), END),
    )
    assert rows(apply(old, snapshot(spark, ("x", 1, "2", None)), 2)) == rows(old)


def test_missing_key_is_closed_unless_deletes_are_off(spark):
    old = history(spark, ("x", "1", None, True, START, END))
    none = snapshot(spark, ("z", 1, "1", None)).limit(0)
    assert rows(apply(old, none, 3)) == [("x", "1", None, False, START, START + timedelta(days=3))]
    assert rows(apply(old, none, 3, deletes=False)) == rows(old)


def test_actions(spark):
    old = history(
        spark,
        ("same", "1", None, True, START, END),
        ("gone", "1", None, True, START, END),
        ("moved", "1", None, True, START, END),
        ("closed", "1", None, False, START, START),
    )
    new = snapshot(spark, ("same", 1, "1", None), ("moved", 1, None, "1"), ("new", 1, None, None), ("closed", 1, "1", None))
    assert rows(scd2_actions(old, new, ["k"], ["a", "b"], ["o"])) == [("DELETE", 1), ("INSERT", 2), ("NO_ACTION", 1), ("UPDATE", 1)]


def test_key_listed_as_tracked(spark):
    new = snapshot(spark, ("x", 1, "1", None))
    out = scd2_apply(empty_history(new, ["k"], ["k", "a"]), new, ["k"], ["k", "a"], START)
    assert out.columns == ["k", "a", "is_current", "valid_from", "valid_to"]


@relaxed
@given(st.lists(st.tuples(st.sampled_from("xyz"), st.sampled_from(["p", "q", None])), max_size=18))
def test_stepwise_apply_equals_rebuild(spark, deliveries):
    """Snapshots that grow day by day lead to the history that a rebuild gives."""
    items = [(k, day, 0, a, None) for day, (k, a) in enumerate(deliveries)]
    seen = changes(spark, items)
    out = empty_history(seen, ["k"], ["a", "b"])
    for day in range(0, len(items), 6):
        out = spark.createDataFrame(out.collect(), out.schema)
        upto = seen.where(F.col("t") < F.lit(START + timedelta(days=day + 6)))
        out = scd2_apply(out, upto, ["k"], ["a", "b"], START + timedelta(days=day), ["t"])
    grouped = [(k, day - day % 6, day, a, b) for k, day, _, a, b in items]
    assert rows(out) == expected_history(grouped)


def test_versions_at(spark):
    items = [("x", 0, 0, "1", None), ("x", 2, 0, "2", None)]
    built = rebuild(spark, items)
    assert rows(versions_at(built, START + timedelta(days=1)), "a") == [("1",)]
    assert rows(versions_at(built, START + timedelta(days=2)), "a") == [("2",)]
    assert rows(versions_at(built, START - timedelta(days=1)), "a") == []


def test_rebuild_does_not_depend_on_the_order_of_input(spark):
    changes = [("k", 1, "b", 1), ("k", 1, "a", 1), ("k", 2, "c", 1)]
    schema = "k string, t int, v string, tie int"
    for rows_given in (changes, changes[::-1]):
        df = spark.createDataFrame(rows_given, schema).withColumn("at", F.expr("timestamp_seconds(t)"))
        for hot_rows in (1_000_000, 1):
            built = scd2_rebuild(df, ["k"], ["v"], "at", ["tie"], hot_rows)
            assert [r.v for r in built.orderBy("valid_from").collect()] == ["b", "c"]


def test_history_kept_by_key(spark, tables):
    """Small deliveries: equal to applying each to the whole, and only their keys' parts change."""
    from tests.test_tables import files_of
    from tierflow.plans.keyed_history import KeyedHistory

    schema = "k long, v string"
    history = KeyedHistory(tables, "c.s.h", ["k"], ["v"])
    history.create(spark.createDataFrame([], schema).schema, parts=16, buckets=2)
    plain = empty_history(spark.createDataFrame([], schema), ["k"], ["v"])
    first = spark.range(500).selectExpr("id AS k", "CAST(id % 5 AS STRING) AS v")
    deliveries = [first, [(1, "x"), (2, "2"), (900, "new")], [(1, "y"), (900, None)], [(1, "y")], []]
    for n, given in enumerate(deliveries):
        snapshot = given if n == 0 else spark.createDataFrame(given, schema)
        now = f"2024-0{n + 1}-15 00:00:00"
        before = files_of(tables.read(history.current)) if n else set()
        for _ in range(2):
            # Again with the same step: nothing more changes.
            history.apply(snapshot, now, f"step-{n}")
        plain = spark.createDataFrame(scd2_apply(plain, snapshot, ["k"], ["v"], now, deletes=False).collect(), plain.schema)
        assert rows(history.read()) == rows(plain), n
        if n:
            touched = tables.touched_parts(history.current, snapshot, ["k"])
            kept = {f for f in before if not any(f"metadata_key_part={p}/" in f for p in touched)}
            assert kept <= files_of(tables.read(history.current)) and len(touched) <= len(given)
    for moment in ("2024-01-01 00:00:00", "2024-02-15 00:00:00", "2024-02-20 00:00:00", "2030-01-01 00:00:00"):
        assert rows(history.at(moment)) == rows(versions_at(plain, moment))
    plan = history.at("2024-03-01 00:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(metadata_ended_in" in plan and ">= 2024-03" in plan


LATE_ITEMS = st.lists(
    st.tuples(st.sampled_from(["x", "y", None]), st.integers(0, 9), st.integers(0, 99), st.sampled_from(["1", "2", None]), st.none(), st.booleans()),
    max_size=25,
    unique_by=lambda r: (r[0], r[1], r[2]),
)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(items=LATE_ITEMS, hot_rows=st.sampled_from([2, 1_000_000]))
def test_late_rows_are_put_between_versions(spark, items, hot_rows):
    """Whatever part of the rows arrives late: equal to the rebuild of all."""
    in_time, late = ([r[:5] for r in items if r[5] == flag] for flag in (False, True))
    got = scd2_insert(rebuild(spark, in_time), changes(spark, late), changes(spark, in_time), ["k"], ["a", "b"], "t", ["n"], hot_rows)
    assert rows(got) == expected_history(in_time + late)


def test_late_rows_leave_closings_and_other_keys(spark):
    day = lambda d: START + timedelta(days=d)
    known = [("x", "1", False, day(0), day(4)), ("x", "2", False, day(6), day(8)), ("y", "1", True, day(0), END)]
    kept = spark.createDataFrame(known, "k string, a string, is_current boolean, valid_from timestamp, valid_to timestamp")
    given = spark.createDataFrame([("x", day(0), "1"), ("x", day(6), "2"), ("y", day(0), "1")], "k string, t timestamp, a string")
    late = spark.createDataFrame([("x", day(2), "3"), ("x", day(9), "4"), ("x", day(5), "2")], "k string, t timestamp, a string")
    want = [("x", "1", False, day(0), day(2)), ("x", "3", False, day(2), day(4)), ("x", "2", False, day(5), day(8)), ("x", "4", True, day(9), END), known[2]]
    assert rows(scd2_insert(kept, late, given, ["k"], ["a"], "t")) == sorted(want, key=repr)
    assert rows(scd2_insert(kept, late.limit(0), given, ["k"], ["a"], "t")) == sorted(known, key=repr)


def test_late_delivery_to_a_history_kept_by_key(spark, tables):
    """In whatever order deliveries come, run twice or not: the history of all in order."""
    from tests.test_tables import files_of
    from tierflow.plans.keyed_history import KeyedHistory

    schema = "k long, v string"
    one = [(k, str(k % 3)) for k in range(200)]
    deliveries = [one, [(1, "x"), (2, "2"), (3, "q")], [(1, "x"), (2, "z"), (900, "n")], [(1, "1"), (3, "0"), (7, "w")]]
    at = [f"2024-0{n + 1}-15 00:00:00" for n in range(4)]
    frames = [spark.createDataFrame(d, schema).withColumn("at", F.lit(t).cast("timestamp")) for d, t in zip(deliveries, at)]
    plain = empty_history(frames[0], ["k"], ["v"])
    for frame, now in zip(frames, at):
        plain = spark.createDataFrame(scd2_apply(plain, frame, ["k"], ["v"], now, deletes=False).collect(), plain.schema)
    history = KeyedHistory(tables, "c.s.late", ["k"], ["v"])
    history.create(spark.createDataFrame([], schema).schema, parts=16, buckets=2)
    for n in (0, 3):
        history.apply(frames[n], at[n], f"step-{n}")
    before = files_of(tables.read(history.current))
    seen = frames[0].unionByName(frames[3])
    for n in (2, 1):
        for _ in range(2):
            history.insert(frames[n], seen, "at", f"step-{n}")
        seen = seen.unionByName(frames[n])
    assert rows(history.read()) == rows(plain)
    touched = tables.touched_parts(history.current, frames[1].unionByName(frames[2]), ["k"])
    assert {f for f in before if not any(f"metadata_key_part={p}/" in f for p in touched)} <= files_of(tables.read(history.current))
    history.insert(frames[0].limit(0), seen, "at", "step-9")
    assert rows(history.read()) == rows(plain)
