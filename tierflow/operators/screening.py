"""Data-quality screens over a whole frame: one pass for row screens, one count for uniqueness.

A screen plan is a list of `(column, screen, params)`. Per column the screens apply in a fixed
order and the first that fails wins: its value is logged and nulled, so later ones see NULL.
Key and uniqueness screens look at values as delivered and null nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierflow.functions.checks import SCREEN_ORDER, fails
from tierflow.operators.conform import PASSED
from tierflow.session import materialize
from tierflow.operators.skew import HOT_ROWS, SMALL_ROWS, hot_keys, is_small, lookup_join, repeated_keys, salted_join

Screen = tuple[str, str, Mapping[str, Any]]
Plan = Sequence[Screen]
References = Mapping[str, DataFrame]

FAILURES = "failures"
FAILURE_TYPE = (
    "array<struct<record_identifier: string, column_name: string, screen_code: string, original_value: string>>"
)
GROUP_SCREENS = ("is_primary_key", "is_unique")


def identifier(columns: Sequence[str]) -> Column:
    """A record's key as text. Parts of a composite key are joined so that different keys stay
    different: NULL is `\\N`, and separators within a part are escaped."""
    parts = [F.col(c).cast("string") for c in columns]
    if len(parts) == 1:
        return parts[0]
    escaped = [F.regexp_replace(p, r"([\\|])", r"\\$1") for p in parts]
    return F.concat_ws("||", *[F.coalesce(p, F.lit("\\N")) for p in escaped])


def group_members(item: Screen) -> list[str]:
    """Columns of a uniqueness screen."""
    column, _, params = item
    return list(params.get("columns") or column.split(","))


def reference_values(params: Mapping[str, Any], references: References) -> DataFrame:
    """The distinct allowed values (column `value`) of a foreign-column screen."""
    name = f"{params['schema']}.{params['table']}" if "schema" in params else params["table"]
    if name not in references:
        raise ValueError(f"Unknown reference table: {name}")
    return references[name].select(F.col(params["reference"]).alias("value")).dropna().distinct()


def _scope(batch: str | None, columns: Sequence[str]) -> list[str]:
    return ([batch] if batch else []) + list(columns)


def key_violations(df: DataFrame, key: Sequence[str], batch: str | None = None) -> DataFrame:
    """Keys that occur more than once in their batch, written out: they are few and read often.

    Finding them shuffles one count per key and task. Once they measure small they go to every
    task, and the rows themselves never shuffle.
    """
    return materialize(repeated_keys(df, _scope(batch, key)), "repeated-keys")


def _repeated(
    df: DataFrame, repeated: DataFrame, keys: Sequence[str], flag: str, hot_rows: int, small_rows: int, like: DataFrame
) -> tuple[DataFrame, Column]:
    """A frame with all rows of `df`, and whether a row's key is among the repeated ones, which `flag` marks.

    Many repeated keys are counted anew beside the rows: unlike a join with them, that moves no rows that
    lie by a part of the key already. Hot keys are too large for that and are joined.
    """
    found = None
    if not is_small(repeated, small_rows):
        found = hot_keys(like, keys, hot_rows)
        if found is None:
            complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
            return df, complete & (F.count("*").over(Window.partitionBy(*keys)) > 1)
    marked = F.coalesce(F.col(flag), F.lit(False))
    if found is None:
        return df.join(F.broadcast(repeated), list(keys), "left"), marked
    return salted_join(df, repeated, keys, "left", found), marked


def _with_flags(
    df: DataFrame,
    plan: Plan,
    batch: str | None,
    references: References,
    hot_rows: int,
    small_rows: int = SMALL_ROWS,
    like: DataFrame | None = None,
) -> tuple[DataFrame, dict[tuple[str, str], str]]:
    """Add one boolean column per screen that needs other rows or another table."""
    flags: dict[tuple[str, str], str] = {}
    delivered = df
    like = df if like is None else like
    for item in plan:
        column, screen, params = item
        flag = f"_flag_{len(flags)}"
        if screen == "is_unique":
            keys = _scope(batch, group_members(item))
            repeated = key_violations(delivered, group_members(item), batch)
            joined, failing = _repeated(df, repeated.withColumn(flag, F.lit(True)), keys, flag, hot_rows, small_rows, like)
        elif screen == "is_in_foreign_column":
            allowed = reference_values(params, references).withColumnRenamed("value", column)
            lookup = allowed.withColumn(flag, F.lit(True))
            joined = lookup_join(df, lookup, [column], "left", hot_rows, like=like, small_rows=small_rows)
            failing = F.col(column).isNotNull() & F.col(flag).isNull()
        else:
            continue
        df = joined.select(*df.columns, failing.alias(flag))
        flags[(column, screen)] = flag
    return df, flags


def _first_failing(
    column: str, plan: Plan, flags: Mapping[tuple[str, str], str], compared: Mapping[str, Column]
) -> Column:
    """Code of the first screen that `column` fails, NULL if it passes all."""

    def rank(item: Screen) -> int:
        return SCREEN_ORDER.index(item[1]) if item[1] in SCREEN_ORDER else len(SCREEN_ORDER)

    code = F.lit(None).cast("string")
    for _, screen, params in sorted((p for p in plan if p[0] == column), key=rank, reverse=True):
        if screen in GROUP_SCREENS:
            continue
        if screen == "is_not_lower_than":
            params = {**params, "reference": compared.get(params["reference"], params["reference"])}
        flag = flags.get((column, screen))
        failing = F.col(flag) if flag else fails(screen, F.col(column), params)
        code = F.when(failing, F.lit(screen)).otherwise(code)
    return code


def _first_failing_by_column(plan: Plan, flags: Mapping[tuple[str, str], str]) -> dict[str, Column]:
    columns = list(dict.fromkeys(p[0] for p in plan if p[1] not in GROUP_SCREENS))
    # A value is compared with another column as that column's own screens left it.
    own = [p for p in plan if p[1] != "is_not_lower_than"]
    compared = {
        c: F.when(_first_failing(c, own, flags, {}).isNull(), F.col(c)) for c in columns
    }
    return {c: _first_failing(c, plan, flags, compared) for c in columns}


def _apply(
    df: DataFrame, columns: Sequence[str], plan: Plan, key: Sequence[str], flags: Mapping[tuple[str, str], str]
) -> DataFrame:
    """The row pass: nulled values, the pass flag and the array of failures."""
    codes = _first_failing_by_column(plan, flags)
    code_of = {c: f"_code_{i}" for i, c in enumerate(codes)}
    coded = df.withColumns({code_of[c]: code for c, code in codes.items()})

    def failure(failing: Column, column: str, screen: Column, value: Column) -> Column:
        return F.when(
            failing,
            F.struct(
                identifier(key).alias("record_identifier"),
                F.lit(column).alias("column_name"),
                screen.alias("screen_code"),
                value.cast("string").alias("original_value"),
            ),
        )

    failing = [F.col(code).isNotNull() for code in code_of.values()]
    entries = [failure(F.col(code).isNotNull(), c, F.col(code), F.col(c)) for c, code in code_of.items()]
    for item in plan:
        if item[1] == "is_unique":
            flag = F.col(flags[item[:2]])
            failing.append(flag)
            entries.append(failure(flag, item[0], F.lit(item[1]), identifier(group_members(item))))
    values = [
        F.when(F.col(code_of[c]).isNull(), F.col(c)).alias(c) if c in code_of else F.col(c) for c in columns
    ]
    # One entry per screened column, NULL where it passed: a plain array that is compiled and built once.
    return coded.select(
        *values,
        (~reduce(lambda a, b: a | b, failing, F.lit(False))).alias(PASSED),
        (F.array(*entries) if entries else F.array().cast(FAILURE_TYPE)).alias(FAILURES),
    )


def _is_keyed(plan: Plan) -> bool:
    return any(p[1] == "is_primary_key" for p in plan)


class Screening:
    """One screening of a frame: the looked-up flags and repeated keys, found once for both results."""

    def __init__(
        self,
        df: DataFrame,
        plan: Plan,
        key: Sequence[str],
        batch: str | None = None,
        references: References = {},
        hot_rows: int = HOT_ROWS,
        small_rows: int = SMALL_ROWS,
        violations: DataFrame | None = None,
        like: DataFrame | None = None,
    ) -> None:
        """`violations` are the keys found by `key_violations`, if they are known already.

        Hot keys are looked for in `like` if given: a frame that is cheaper to scan than `df`, with all its
        keys at least as often.
        """
        self.df, self.plan, self.key, self.batch = df, plan, list(key), batch
        self.hot_rows, self.small_rows = hot_rows, small_rows
        self.like = df if like is None else like
        self.flagged, self.flags = _with_flags(df, plan, batch, references, hot_rows, small_rows, self.like)
        if _is_keyed(plan) and violations is None:
            violations = key_violations(df, key, batch)
        self.violations = violations if _is_keyed(plan) else None

    def _apply(self, rows: DataFrame) -> DataFrame:
        return _apply(rows, self.df.columns, self.plan, self.key, self.flags)

    def audited(self) -> DataFrame:
        """Rows with failing fields nulled and the pass flag; rows of repeated keys are discarded."""
        kept = self.flagged
        if self.violations is not None:
            scope = _scope(self.batch, self.key)
            kept = lookup_join(kept, self.violations, scope, "left_anti", self.hot_rows, self.like, self.small_rows)
        return self._apply(kept).drop(FAILURES)

    def failures(self) -> DataFrame:
        """One row per failing field, with the record's key as delivered, and one per repeated key."""
        scope = [F.col(self.batch)] if self.batch else []
        found = (
            self._apply(self.flagged)
            .where(~F.col(PASSED))
            .select(*scope, F.explode(FAILURES).alias("f"))
            .where("f IS NOT NULL")
            .select(*scope, "f.*")
        )
        if self.violations is None:
            return found
        repeated = self.violations.select(
            *scope,
            identifier(self.key).alias("record_identifier"),
            F.lit(",".join(self.key)).alias("column_name"),
            F.lit("is_primary_key").alias("screen_code"),
            identifier(self.key).alias("original_value"),
        )
        return found.unionByName(repeated)


def screen(
    df: DataFrame,
    plan: Plan,
    key: Sequence[str],
    batch: str | None = None,
    references: References = {},
    hot_rows: int = HOT_ROWS,
    small_rows: int = SMALL_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(audited rows, failures). Each reads `df` anew, pruned to the columns it needs."""
    screening = Screening(df, plan, key, batch, references, hot_rows, small_rows)
    return screening.audited(), screening.failures()


def failing_rows(
    df: DataFrame,
    item: Screen,
    batch: str | None = None,
    references: References = {},
    hot_rows: int = HOT_ROWS,
    small_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Rows of `df` that fail one screen, all columns as delivered."""
    column, name, params = item
    if name in GROUP_SCREENS:
        members = group_members(item)
        repeated = key_violations(df, members, batch)
        found = lookup_join(df, repeated, _scope(batch, members), "left_semi", hot_rows, small_rows=small_rows)
        return found.select(*df.columns)
    if name == "is_in_foreign_column":
        lookup = reference_values(params, references).withColumnRenamed("value", column)
        given = df.where(F.col(column).isNotNull())
        found = lookup_join(given, lookup, [column], "left_anti", hot_rows, small_rows=small_rows)
        return found.select(*df.columns)
    return df.where(fails(name, F.col(column), params))
