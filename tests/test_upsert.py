import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.conftest import rows
from tierflow.operators.upsert import upsert

SCHEMA = "k int, a string, b string"


def frames(spark):
    target = spark.createDataFrame([(1, "x", "y"), (2, "x", "y")], SCHEMA)
    source = spark.createDataFrame([(2, None, "new"), (3, "x", None)], SCHEMA)
    return target, source


def test_source_wins_even_when_null(spark):
    target, source = frames(spark)
    assert rows(upsert(target, source, ["k"])) == [(1, "x", "y"), (2, None, "new"), (3, "x", None)]


def test_update_columns_limit_updates_but_not_inserts(spark):
    target, source = frames(spark)
    assert rows(upsert(target, source, ["k"], update_columns=["b"])) == [(1, "x", "y"), (2, "x", "new"), (3, "x", None)]


def test_created_and_updated_times(spark):
    schema = "k int, v int, c timestamp, u timestamp, d timestamp"
    target = spark.createDataFrame([], schema)
    source = spark.createDataFrame([(1, 1, None, None, None), (2, 1, None, None, None)], schema)
    once = upsert(target, source, ["k"], created_col="c", updated_col="u", at="2024-01-01 00:00:00")
    again = spark.createDataFrame([(2, 2, None, None, None), (3, 2, None, None, None)], schema)
    twice = upsert(once, again, ["k"], created_col="c", updated_col="u", at="2024-02-01 00:00:00")
    text = twice.selectExpr("k", "v", "cast(c as string)", "cast(u as string)", "cast(d as string)")
    assert rows(text) == [
        (1, 1, "2024-01-01 00:00:00", None, None),
        (2, 2, "2024-01-01 00:00:00", "2024-02-01 00:00:00", None),
        (3, 2, "2024-02-01 00:00:00", None, None),
    ]


def test_repeated_source_key_is_an_error(spark):
    target, source = frames(spark)
    with pytest.raises(Exception, match="Several source rows for one key"):
        upsert(target, source.unionByName(source), ["k"]).collect()
    with pytest.raises(Exception, match="Several source rows for one key"):
        upsert(target, source.unionByName(source), ["k"]).count()


def test_null_keys(spark):
    target = spark.createDataFrame([(None, "t", "t"), (1, "t", "t")], SCHEMA)
    source = spark.createDataFrame([(None, "s", "s"), (None, "s", "s")], SCHEMA)
    with pytest.raises(Exception, match="NULL in a key column"):
        upsert(target, source, ["k"]).collect()
    inserted = upsert(target, source, ["k"], allow_null_keys=True)
    assert rows(inserted) == [(1, "t", "t"), (None, "s", "s"), (None, "s", "s"), (None, "t", "t")]
    replaced = upsert(target, source, ["k"], allow_null_keys=True, replace_null_keys=True)
    assert rows(replaced) == [(1, "t", "t"), (None, "s", "s"), (None, "s", "s")]


def test_missing_and_extra_source_columns(spark):
    target, _ = frames(spark)
    source = spark.createDataFrame([(2, "new"), (3, "new")], "k int, b string")
    assert rows(upsert(target, source, ["k"])) == [(1, "x", "y"), (2, "x", "new"), (3, None, "new")]
    with pytest.raises(ValueError, match="not in the target: z"):
        upsert(target, source.withColumnRenamed("b", "z"), ["k"])


def test_key_only_table(spark):
    target = spark.createDataFrame([(1, 2)], "x int, y int")
    source = spark.createDataFrame([(1, 2), (1, 3)], "x int, y int")
    assert rows(upsert(target, source, ["x", "y"])) == [(1, 2), (1, 3)]


keyed = st.dictionaries(st.integers(0, 6), st.tuples(st.sampled_from(["p", "q", None]), st.sampled_from(["p", None])), max_size=6)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(keyed, keyed)
def test_merging_the_same_source_again_changes_nothing(spark, old, new):
    target = spark.createDataFrame([(k, *v) for k, v in old.items()], SCHEMA)
    source = spark.createDataFrame([(k, *v) for k, v in new.items()], SCHEMA)
    once = upsert(target, source, ["k"])
    assert rows(once) == sorted(((k, *v) for k, v in {**old, **new}.items()), key=repr)
    assert rows(upsert(once, source, ["k"])) == rows(once)
