"""The declared type names of a column spec and how values are cast to them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# JSON fields rest as text; `json_items` gives the array view.
DECLARED_TYPES = {
    "string": T.StringType(),
    "json": T.StringType(),
    "timestamp": T.TimestampType(),
    "integer": T.IntegerType(),
    "long": T.LongType(),
    "boolean": T.BooleanType(),
}


def record(**columns: str) -> T.StructType:
    """A nullable schema from column names and simple type names; needs no running session."""
    plain = {**DECLARED_TYPES, "binary": T.BinaryType()}
    return T.StructType([T.StructField(name, plain[kind]) for name, kind in columns.items()])


def declared_type(name: str) -> T.DataType:
    """Spark type for a declared type name; an unknown name is an error before any job runs."""
    if name not in DECLARED_TYPES:
        raise ValueError(f"No such declared type: {name}")
    return DECLARED_TYPES[name]


def cast_declared(
    column: Column, data_type: str, pattern: str | None = None, on_error: str = "null"
) -> Column:
    """Cast to a declared type. A value that does not fit becomes NULL, or fails the job."""
    target = declared_type(data_type)
    if on_error not in ("null", "fail"):
        raise ValueError(f"Invalid on_error: {on_error}")
    if data_type == "timestamp" and pattern is not None:
        parse = F.try_to_timestamp if on_error == "null" else F.to_timestamp
        return parse(column, F.lit(pattern) if on_error == "null" else pattern)
    return column.try_cast(target) if on_error == "null" else column.cast(target)


def json_items(column: Column) -> Column:
    """Array view of a JSON-array text field."""
    return F.from_json(column, T.ArrayType(T.StringType()))
