"""Row-level data-quality checks: each gives TRUE where the value fails.

`CHECKS` maps a screen name to `(value, params) -> failing condition`. Register further
screens with `register_check`; the screening operator picks them up by name.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tierflow.functions.types import cast_declared

Check = Callable[[Column, Mapping[str, Any]], Column]

# The e-mail pattern, and the order in which a column's screens apply.
EMAIL_PATTERN = r"^.+@.+\..+$"
SCREEN_ORDER = [
    "is_primary_key",
    "is_not_null",
    "is_in_list",
    "is_email_format",
    "is_in_bounds",
    "is_date_format",
    "is_in_foreign_column",
    "is_not_lower_than",
]


def not_null(value: Column, params: Mapping[str, Any]) -> Column:
    return value.isNull()


def in_list(value: Column, params: Mapping[str, Any]) -> Column:
    return ~value.isin(allowed_values(params["allowed"]))


def email_format(value: Column, params: Mapping[str, Any]) -> Column:
    return ~value.rlike(EMAIL_PATTERN)


def in_bounds(value: Column, params: Mapping[str, Any]) -> Column:
    return ~value.between(params["min_allowed"], params["max_allowed"])


def date_format(value: Column, params: Mapping[str, Any]) -> Column:
    return value.isNotNull() & F.try_to_timestamp(value, F.lit(params["format"])).isNull()


def not_lower_than(value: Column, params: Mapping[str, Any]) -> Column:
    """`params["reference"]` is a column name, or the column itself once screened."""
    reference = params["reference"]
    reference = F.col(reference) if isinstance(reference, str) else reference
    if "data_type" in params:
        value = cast_declared(value, params["data_type"], params.get("format"))
        reference = cast_declared(reference, params["data_type"], params.get("format"))
    return value < reference


CHECKS: dict[str, Check] = {
    "is_not_null": not_null,
    "is_in_list": in_list,
    "is_email_format": email_format,
    "is_in_bounds": in_bounds,
    "is_date_format": date_format,
    "is_not_lower_than": not_lower_than,
}


def register_check(name: str, check: Check) -> None:
    """Add a screen of one's own; it applies after the built-in ones, in registration order."""
    CHECKS[name] = check
    if name not in SCREEN_ORDER:
        SCREEN_ORDER.append(name)


def allowed_values(allowed: str | list) -> list:
    """Allowed values of a list screen: comma text is split without trimming."""
    return allowed.split(",") if isinstance(allowed, str) else list(allowed)


def fails(screen: str, value: Column, params: Mapping[str, Any]) -> Column:
    """TRUE only where the value fails; an unknown outcome (NULL) counts as passed."""
    if screen not in CHECKS:
        raise ValueError(f"Unknown screen: {screen}")
    return F.coalesce(CHECKS[screen](value, params), F.lit(False))
