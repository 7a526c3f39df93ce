import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tierflow.operators import skew
from tierflow.operators.events import EVENT_SCHEMA, UNRESOLVED, error_events
from tierflow.operators.screening import Screening, failing_rows, screen

# A published event log (CSV) to check the ids against, if one is at hand.
KEY_SCREEN = ("k", "is_primary_key", {})


def frame(spark):
    return spark.createDataFrame(
        [
            ("1", "a@x.y", 5, "SI"),
            ("1", "dup@x.y", 50, "SI"),
            ("1", "dup@x.y", 5, "NO"),
            ("2", "dup@x.y", 5, None),
            ("1", "bad", 30, "NO"),
            ("1", None, 5, None),
            ("1", None, None, None),
        ],
        "b string, k string, n int, s string",
    )


PLAN = [
    KEY_SCREEN,
    ("k", "is_not_null", {}),
    ("k", "is_email_format", {}),
    ("n", "is_in_bounds", {"min_allowed": 0, "max_allowed": 20}),
    ("s", "is_in_list", {"allowed": "SI"}),
]


# Lookups sent whole, joined by shuffle, and joined with every key counted as hot.
WAYS = [{}, {"small_rows": 0}, {"small_rows": 0, "hot_rows": 1}]


@pytest.mark.parametrize("way", WAYS)
def test_single_pass_equals_sequential_screens(spark, way):
    audited, failures = screen(frame(spark), PLAN, ["k"], "b", **way)
    assert rows(audited) == sorted(
        [
            ("1", "a@x.y", 5, "SI", True),
            ("2", "dup@x.y", 5, None, True),
            ("1", None, None, None, False),
            ("1", None, 5, None, False),
            ("1", None, None, None, False),
        ],
        key=repr,
    )
    assert rows(failures, "b", "record_identifier", "column_name", "screen_code", "original_value") == sorted(
        [
            ("1", "dup@x.y", "k", "is_primary_key", "dup@x.y"),
            ("1", "dup@x.y", "n", "is_in_bounds", "50"),
            ("1", "dup@x.y", "s", "is_in_list", "NO"),
            ("1", "bad", "k", "is_email_format", "bad"),
            ("1", "bad", "n", "is_in_bounds", "30"),
            ("1", "bad", "s", "is_in_list", "NO"),
            ("1", None, "k", "is_not_null", None),
            ("1", None, "k", "is_not_null", None),
        ],
        key=repr,
    )


def test_key_screen_flags_all_copies_and_no_nulls(spark):
    df = spark.createDataFrame([(None,), (None,), ("a",), ("a",), ("b",)], "k string")
    assert rows(failing_rows(df, KEY_SCREEN)) == [("a",), ("a",)]


def test_composite_key(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (1, None), (1, None)], "x int, y int")
    plan = [("x,y", "is_primary_key", {"columns": ["x", "y"]})]
    audited, failures = screen(df, plan, ["x", "y"])
    assert rows(audited, "x", "y") == [(1, 2), (1, None), (1, None)]
    assert rows(failures) == [("1||1", "x,y", "is_primary_key", "1||1")]


@pytest.mark.parametrize("way", WAYS)
def test_unique_group_marks_rows_and_keeps_values(spark, way):
    df = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 2, 1), ("d", None, 1), ("e", None, 1)], "k string, x int, y int")
    item = ("x,y", "is_unique", {"columns": ["x", "y"]})
    audited, failures = screen(df, [item], ["k"], **way)
    assert rows(audited) == [("a", 1, 1, False), ("b", 1, 1, False), ("c", 2, 1, True), ("d", None, 1, True), ("e", None, 1, True)]
    assert rows(failures, "record_identifier", "column_name", "original_value") == [("a", "x,y", "1||1"), ("b", "x,y", "1||1")]
    assert rows(failing_rows(df, item, **way), "k") == [("a",), ("b",)]


@pytest.mark.parametrize("way", WAYS)
def test_foreign_column(spark, way):
    df = spark.createDataFrame([("a", 1), ("b", 9), ("c", None), ("d", 1), ("e", 9)], "k string, f int")
    refs = {"s.t": spark.createDataFrame([(1,), (1,), (2,), (None,)], "id int")}
    item = ("f", "is_in_foreign_column", {"schema": "s", "table": "t", "reference": "id"})
    audited, failures = screen(df, [item], ["k"], references=refs, **way)
    assert rows(audited) == [("a", 1, True), ("b", None, False), ("c", None, True), ("d", 1, True), ("e", None, False)]
    assert rows(failures, "record_identifier", "original_value") == [("b", "9"), ("e", "9")]
    assert rows(failing_rows(df, item, references=refs, **way), "k") == [("b",), ("e",)]
    with pytest.raises(ValueError, match="Unknown reference table"):
        screen(df, [item], ["k"])


def test_not_lower_than_sees_the_screened_reference(spark):
    df = spark.createDataFrame([("a", 1, 5), ("b", 1, 500), ("c", 9, 5)], "k string, v int, r int")
    plan = [("r", "is_in_bounds", {"min_allowed": 0, "max_allowed": 100}), ("v", "is_not_lower_than", {"reference": "r"})]
    audited, _ = screen(df, plan, ["k"])
    assert rows(audited) == [("a", None, 5, False), ("b", 1, None, False), ("c", 9, 5, True)]


def test_screen_without_key_or_batch_keeps_all_rows(spark):
    df = spark.createDataFrame([("a", 1), ("a", None)], "k string, v int")
    audited, failures = screen(df, [("v", "is_not_null", {})], ["k"])
    assert rows(audited) == [("a", 1, True), ("a", None, False)]
    assert failures.count() == 1


def test_events_collapse_to_one_per_id(spark):
    failures = spark.createDataFrame(
        [("7", None, "k", "is_not_null", None), ("7", None, "k", "is_not_null", None), ("7", "a", "n", "s", "9"), ("7", "a", "n", "s", "10")],
        "b string, record_identifier string, column_name string, screen_code string, original_value string",
    )
    events = error_events(failures, "b", "c", "s", "t")
    assert events.columns == EVENT_SCHEMA.names
    assert rows(events, "batch_id", "record_identifier", "original_value", "replaced_value", "error_condition") == [
        ("7", "a", "10", None, UNRESOLVED),
        ("7", None, None, None, UNRESOLVED),
    ]


# Published events and their ids.
GOLDEN = [
    ("1a7b33ba01bece2e3a2df4c8c4dab655", "7", "is_in_list", "Baja", "jhosebh_19@yahoo.com"),
    ("a722e68e512e2f798e1e64b70da313e2", "7", "is_date_format", "FechaEnvio", "irmis_20@yahoo.com"),
    ("9d5a3e5a741d0656178407047f4b81c3", "7", "is_primary_key", "Email", "mjesusvelazquez@yahoo.com"),
    ("119deb7333ebac6225a2da46fda4a75e", "7", "is_in_bounds", "Clicks", "jhosebh_19@yahoo.com"),
]


def test_golden_event_ids(spark):
    failures = spark.createDataFrame(
        [(b, record, column, screen, "x") for _, b, screen, column, record in GOLDEN],
        "b string, record_identifier string, column_name string, screen_code string, original_value string",
    )
    events = error_events(failures, "b", "domain_dev", "silver_analytics", "audit_visitas")
    assert rows(events, "error_event_id", "batch_id", "screen_code", "column_name", "record_identifier") == sorted(GOLDEN)
    assert {r.error_condition for r in events.collect()} == {UNRESOLVED}


def test_composite_keys_with_nulls_stay_apart(spark):
    df = spark.createDataFrame(
        [("x", None, -1), (None, "x", -1), ("a||b", "c", -1), ("a", "b||c", -1), ("a\\", "|b", -1), ("\\N", "x", -1), (None, None, -1)],
        "p string, q string, v int",
    )
    _, failures = screen(df, [("v", "is_in_bounds", {"min_allowed": 0, "max_allowed": 9})], ["p", "q"])
    events = error_events(failures.withColumn("b", F.lit("1")), "b", "c", "s", "t")
    assert events.select("error_event_id").distinct().count() == events.count() == 7


def test_hot_keys_do_not_multiply_the_scans(spark, tmp_path):
    """With hot keys forced, another looked-up screen adds no scan of the rows."""
    spark.range(3000).selectExpr("id", "id % 3 AS a", "id % 2 AS b", "if(id < 2000, 0, id) AS c").write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    allowed = spark.createDataFrame([(0,), (1,)], "v long")

    def screened(columns):
        plan = [(c, "is_in_foreign_column", {"table": "t", "reference": "v"}) for c in columns]
        audited, failures = screen(df, plan, ["id"], references={"t": allowed}, hot_rows=500, small_rows=0)
        plan_text = audited._jdf.queryExecution().sparkPlan().toString()
        return plan_text.count("FileScan parquet [id"), audited, failures

    one, three = screened("a"), screened("abc")
    assert one[0] == three[0] == 1
    assert three[1].count() == 3000
    plain = screen(df, [(c, "is_in_foreign_column", {"table": "t", "reference": "v"}) for c in "abc"], ["id"], references={"t": allowed})
    assert rows(three[1]) == rows(plain[0]) and rows(three[2]) == rows(plain[1])


def test_many_repeated_keys_move_no_rows_that_lie_by_key(spark):
    data = [(i % 40, i % 3 if i % 7 else None, i) for i in range(200)] + [(None, 1, 200), (None, 1, 201), (99, 1, 202)]
    df = spark.createDataFrame(data, "a int, b int, v int").repartition(4, "a")
    plan = [("a,b", "is_unique", {"columns": ["a", "b"]})]
    results = []
    # Repeated keys sent to every task, counted beside the rows, and joined with hot keys dealt over salts.
    for options in ({}, {"small_rows": 0}, {"small_rows": 0, "hot_rows": 2}):
        screening = Screening(df, plan, ["v"], like=df.union(df), **options)
        results.append((rows(screening.audited()), rows(screening.failures())))
        if options == {"small_rows": 0}:
            # `like` holds each key twice, and no key often enough to be hot.
            text = screening.audited()._jdf.queryExecution().executedPlan().toString()
            assert "Window" in text and "Join" not in text and text.count("Exchange") == 1
    pairs = [(a, b) for a, b, _ in data if a is not None and b is not None]
    assert sum(1 for _, _, _, passed in results[0][0] if not passed) == sum(1 for p in pairs if pairs.count(p) > 1) > 0
    assert results[0] == results[1] == results[2]


def test_keys_of_a_table_without_a_hot_one_are_not_counted_one_by_one(spark, monkeypatch):
    counted = []
    monkeypatch.setattr(skew, "materialize", lambda df, purpose: counted.append(purpose) or df)
    df = spark.range(1000).selectExpr("id % 200 AS k")
    assert skew.hot_keys(df, ["k"], 900) is None and not counted
    many = df.union(spark.createDataFrame([(None,)] * 950, "k long"))
    assert [tuple(r)[1] for r in skew.hot_keys(many, ["k"], 900).collect()] == [3] and counted == ["hot-keys"]
