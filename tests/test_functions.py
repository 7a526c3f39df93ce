from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tierflow.functions.checks import CHECKS, SCREEN_ORDER, fails, register_check
from tierflow.functions.cleaning import clean_text, cleaning_hook, list_to_json, null_markers, strip_tokens
from tierflow.functions.hashing import hash_key
from tierflow.functions.types import cast_declared, declared_type, json_items


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_clean_text(spark):
    inputs = ["unknown", "-", "", "unknown,x", "a", None, "unknown-", "Unknown", "unknownunknown"]
    expected = [None, None, None, ",x", "a", None, None, "Unknown", None]
    assert values(spark, clean_text(F.col("v")), inputs) == expected


def test_parts_of_cleaning_apply_in_order(spark):
    assert values(spark, strip_tokens(F.col("v")), ["unknown-unknown"]) == ["-"]
    assert values(spark, null_markers(F.col("v")), ["-", "--"]) == [None, "--"]
    assert values(spark, strip_tokens(F.col("v"), ["n/a", "Unknown"]), ["n/aUnknown.x"]) == [".x"]


def test_list_to_json(spark):
    inputs = ["a,,b", ",,a", "a,,", None, ",", "é,x y", 'q"t']
    expected = ['["a","b"]', '["a"]', '["a"]', None, "[]", '["é","x y"]', '["q\\"t"]']
    assert values(spark, list_to_json(F.col("v")), inputs) == expected
    assert values(spark, json_items(list_to_json(F.col("v"))), ["a,,b"]) == [["a", "b"]]
    assert values(spark, list_to_json(F.col("v"), "|"), ["a||b"]) == ['["a","b"]']


def test_cleaning_hook_leaves_other_columns_alone(spark):
    df = spark.createDataFrame([("-", "unknown", "-")], "a string, b string, c string")
    assert tuple(df.transform(cleaning_hook(["a", "b"], ["b"])).first()) == (None, None, "-")


def test_hash_key_is_md5_of_joined_parts(spark):
    import hashlib

    df = spark.createDataFrame([("a", None, 3)], "x string, y string, z int")
    assert df.select(hash_key(["x", "y", "z"])).first()[0] == hashlib.md5(b"a||||3").hexdigest()


@pytest.mark.parametrize(
    "screen, params, inputs, expected",
    [
        ("is_email_format", {}, ["a@b.c", "bad", "", None], [False, True, True, False]),
        ("is_not_null", {}, ["a", None, ""], [False, True, False]),
        ("is_in_list", {"allowed": "HARD"}, ["HARD", "hard", None], [False, True, False]),
        ("is_in_list", {"allowed": "a, b"}, ["a", "b", " b"], [False, True, False]),
        (
            "is_date_format",
            {"format": "dd/MM/yyyy HH:mm"},
            ["08/02/2013 18:30", "8/2/2013 18:30", "31/02/2013 10:00", "08/02/2013", "08/02/2013 25:00", "2013-02-08 18:30", None],
            [False, True, True, True, True, True, False],
        ),
    ],
)
def test_text_checks(spark, screen, params, inputs, expected):
    assert values(spark, fails(screen, F.col("v"), params), inputs) == expected


def test_bounds_are_inclusive_and_null_passes(spark):
    check = fails("is_in_bounds", F.col("v"), {"min_allowed": 0, "max_allowed": 20})
    assert values(spark, check, [-1, 0, 20, 21, None], "int") == [True, False, False, True, False]


def test_not_lower_than_compares_by_declared_type(spark):
    df = spark.createDataFrame([("9", "10"), ("11", "10"), (None, "1"), ("x", "1")], "v string, r string")
    check = fails("is_not_lower_than", F.col("v"), {"reference": "r", "data_type": "integer"})
    assert [r[0] for r in df.select(check).collect()] == [True, False, False, False]


def test_unknown_screen_and_registered_screen(spark):
    with pytest.raises(ValueError, match="Unknown screen"):
        fails("no_such", F.col("v"), {})
    register_check("is_short", lambda value, params: F.length(value) > params["max"])
    try:
        assert values(spark, fails("is_short", F.col("v"), {"max": 2}), ["ab", "abc", None]) == [False, True, False]
    finally:
        CHECKS.pop("is_short")
        SCREEN_ORDER.remove("is_short")


def test_casts(spark):
    assert values(spark, cast_declared(F.col("v"), "integer"), ["7", "x", "1.5", None]) == [7, None, None, None]
    assert values(spark, cast_declared(F.col("v"), "boolean"), ["true", "maybe"]) == [True, None]
    assert values(spark, cast_declared(F.col("v"), "timestamp"), ["2013-02-08 18:30:00", "x"]) == [
        datetime(2013, 2, 8, 18, 30),
        None,
    ]
    assert values(spark, cast_declared(F.col("v"), "timestamp", "dd/MM/yyyy HH:mm"), ["08/02/2013 18:30"]) == [
        datetime(2013, 2, 8, 18, 30)
    ]
    assert values(spark, cast_declared(F.col("v"), "json"), ["[]"]) == ["[]"]


def test_cast_can_fail_the_job(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        values(spark, cast_declared(F.col("v"), "integer", on_error="fail"), ["x"])
    with pytest.raises(ValueError, match="No such declared type: decimal"):
        declared_type("decimal")
    with pytest.raises(ValueError, match="on_error"):
        cast_declared(F.col("v"), "integer", on_error="skip")
