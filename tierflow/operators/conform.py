"""Make a delivered batch fit its declared columns: names, types, presence, provenance."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierflow.functions.types import cast_declared
from tierflow.plans.spec import TableSpec

BATCH = "metadata_batch_id"
LOADED_AT = "metadata_loaded_at"
MODULE = "metadata_etl_module"
PASSED = "metadata_audit_passed"
RAW_TECHNICAL = [BATCH, LOADED_AT, MODULE]
AUDIT_TECHNICAL = [
    "metadata_audit_id",
    PASSED,
    "metadata_created_at",
    "metadata_updated_at",
    "metadata_deleted_at",
]
TECHNICAL_COMMENTS = {
    BATCH: "Batch that delivered the record",
    LOADED_AT: "Time at which the record was loaded into the table",
    MODULE: "Module that loaded the record",
}


def conformed_names(names: Iterable[str], aliases: Mapping[str, str]) -> list[str]:
    """Delivered header to declared names: legacy aliases first, then all spaces removed."""
    out = [aliases.get(n, n).replace(" ", "") for n in names]
    repeated = sorted({n for n in out if out.count(n) > 1})
    if repeated:
        raise ValueError(f"Columns delivered more than once: {', '.join(repeated)}")
    return out


def rename_columns(df: DataFrame, aliases: Mapping[str, str] = {}) -> DataFrame:
    return df.toDF(*conformed_names(df.columns, aliases))


def column_differences(delivered: Iterable[str], declared: Iterable[str]) -> tuple[list[str], list[str]]:
    """(declared but not delivered, delivered but not declared), each in its own order."""
    delivered, declared = list(delivered), list(declared)
    missing = [c for c in declared if c not in set(delivered)]
    extra = [c for c in delivered if c not in set(declared)]
    return missing, extra


def column_difference_rows(delivered: DataFrame, declared: DataFrame, by: Sequence[str]) -> DataFrame:
    """`column_differences` of many tables at once: (by, column_name, problem), one row per column on one side only."""
    sides = delivered.select(*by, "column_name", F.lit(True).alias("given")).unionByName(
        declared.select(*by, "column_name", F.lit(False).alias("given"))
    )
    found = sides.groupBy(*by, "column_name").agg(F.bool_or("given").alias("given"), F.bool_or(~F.col("given")).alias("declared"))
    problem = F.when(F.col("given"), "delivered but not declared").otherwise("declared but not delivered")
    return found.where(F.col("given") != F.col("declared")).select(*by, "column_name", problem.alias("problem"))


def require_columns(delivered: Iterable[str], declared: Iterable[str]) -> None:
    """Both directions, all differences in one message, before any job runs."""
    missing, extra = column_differences(delivered, declared)
    problems = []
    if missing:
        problems.append(f"Declared but not delivered: {', '.join(missing)}")
    if extra:
        problems.append(f"Delivered but not declared: {', '.join(extra)}")
    if problems:
        raise ValueError("; ".join(problems))


def cast_raw(df: DataFrame, spec: TableSpec, on_error: str = "null") -> DataFrame:
    """All declared casts in one projection; columns outside the spec pass through."""
    types = {c.name: c.data_type for c in spec.columns}
    return df.select(
        *[
            cast_declared(F.col(c), types[c], on_error=on_error).alias(c) if c in types else F.col(c)
            for c in df.columns
        ]
    )


def rename_from_spec(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Columns of the previous layer under their names in this one."""
    return df.withColumnsRenamed({c.rename_from or c.name: c.name for c in spec.columns})


def cast_audit(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Final types; timestamps are parsed with the pattern that their date screen declares."""
    casts = {c.name: cast_declared(F.col(c.name), c.data_type, spec.pattern(c)) for c in spec.columns}
    return df.withColumns(casts)


def null_counts(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """One row (column_name, n_null) per column, from one scan."""
    columns = list(columns)
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.unpivot([], columns, "column_name", "n_null")


def require_not_null(df: DataFrame, columns: Iterable[str]) -> None:
    """Fail the batch if a required column holds a NULL; all columns are checked in one job."""
    columns = list(columns)
    if not columns:
        return
    broken = [r["column_name"] for r in null_counts(df, columns).where("n_null > 0").collect()]
    if broken:
        raise ValueError(f"Required but empty: {', '.join(broken)}")


def fail_on_null(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """`df`, failing the job that reads it at the first NULL in a required column: no scan of its own."""
    valid = F.lit(True)
    for column in reversed(list(columns)):
        error = F.raise_error(F.lit(f"Required but empty: {column}")).cast("boolean")
        valid = F.when(F.col(column).isNull(), error).otherwise(valid)
    return df.where(valid)


def _at(value: datetime | str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def with_raw_technical(
    df: DataFrame, loaded_at: datetime | str, module: str, batch_id: str | Column = BATCH
) -> DataFrame:
    """Batch, load time and module. The batch is a column of `df`, or one given as a `Column`."""
    batch = F.col(batch_id) if isinstance(batch_id, str) else batch_id
    return df.withColumns({BATCH: batch.cast("string"), LOADED_AT: _at(loaded_at), MODULE: F.lit(module)})


def with_audit_technical(df: DataFrame, loaded_at: datetime | str, module: str) -> DataFrame:
    """Audit state (1 passed, 2 failed) and typed, still empty change times."""
    empty = F.lit(None).cast("timestamp")
    return df.withColumns(
        {
            LOADED_AT: _at(loaded_at),
            MODULE: F.lit(module),
            "metadata_audit_id": F.when(F.col(PASSED), 1).otherwise(2),
            "metadata_created_at": empty,
            "metadata_updated_at": empty,
            "metadata_deleted_at": empty,
        }
    )


def drop_technical(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    return df.drop(*[c for c in RAW_TECHNICAL + AUDIT_TECHNICAL if c not in set(keep)])


def with_comments(df: DataFrame, comments: Mapping[str, str]) -> DataFrame:
    """Attach column comments, kept when the frame is saved as a table."""
    return df.select(
        *[
            F.col(c).alias(c, metadata={"comment": comments[c]}) if comments.get(c) else F.col(c)
            for c in df.columns
        ]
    )


def conform(
    df: DataFrame,
    spec: TableSpec,
    loaded_at: datetime | str,
    batch_id: str | Column = BATCH,
    on_error: str = "null",
) -> DataFrame:
    """A delivered text frame as a raw-layer frame. The batch column is not part of the spec."""
    renamed = rename_columns(df, spec.aliases)
    carried = [batch_id] if isinstance(batch_id, str) else []
    require_columns([c for c in renamed.columns if c not in carried], spec.names)
    cast = cast_raw(renamed.select(*spec.names, *carried), spec, on_error)
    technical = with_raw_technical(cast, loaded_at, spec.etl_module, batch_id)
    return with_comments(
        technical.select(*spec.names, *RAW_TECHNICAL), {**spec.comments, **TECHNICAL_COMMENTS}
    )
