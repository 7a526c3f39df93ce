"""Delivered report files: delimited text with a header, one batch per file.

Headers differ between batches, and one CSV scan matches columns by position. Files are
therefore grouped by header line: one scan per distinct header, joined by column name.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierflow.operators.conform import BATCH, conformed_names, require_columns
from tierflow.operators.profiling import column_summary, key_summary, value_counts
from tierflow.session import configure

# The batch id is the second `_` part of the file's stem: report_7.txt -> 7.
BATCH_PATTERN = r"^[^_.]*_([^_.]+)"


def batch_of(file_name: Column) -> Column:
    return F.regexp_extract(file_name, BATCH_PATTERN, 1)


def with_batch(files: DataFrame) -> DataFrame:
    """(path, file_name, batch_id, length); a name that holds no batch id gives an empty one."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("file_name"), batch_of(name).alias("batch_id"), "length")


def discover(spark: SparkSession, path: str, file_glob: str = "*") -> DataFrame:
    """(path, file_name, batch_id, length) of the files below `path`; contents are not read."""
    listed = (
        configure(spark)
        .read.format("binaryFile")
        .option("pathGlobFilter", file_glob)
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", "length")
    )
    return with_batch(listed)


def _first_lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first line of each file whose beginning this task reads."""
    seen: set[str] = set()
    for frame in frames:
        first = frame[~frame["path"].isin(seen)].drop_duplicates("path")
        seen.update(first["path"])
        if len(first):
            yield first[["path", "header"]]


def headers(spark: SparkSession, paths: Sequence[str]) -> dict[str, str]:
    """The header line of each file, read by Spark: any file system that it reads will do.

    A text scan keeps the first line of the splits at a file's beginning; nothing is shuffled.
    """
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"),
        F.regexp_replace("value", "^\ufeff", "").alias("header"),
        F.col("_metadata.file_block_start").alias("start"),
    )
    first = lines.where("start = 0").select("path", "header").mapInPandas(_first_lines, "path string, header string")
    # File metadata holds a URI; readers take plain paths.
    # One line per file, all files at once: an iterator would read them one after the other.
    found = {unquote(r["path"]): r["header"] for r in first.collect()}
    if len(found) < len(set(paths)):
        raise ValueError("A delivered file has no header line")
    return found


@dataclass(frozen=True)
class CsvReader:
    """How a delivery's files are read. All columns arrive as text; types are never inferred."""

    separator: str = ","
    multiline: bool = False
    options: Mapping[str, str] = field(default_factory=dict)

    def columns(self, header: str) -> list[str]:
        """Column names of a header line."""
        if not header.strip():
            raise ValueError("A delivered file has no header line")
        return next(csv.reader([header], delimiter=self.separator))

    def scan(self, spark: SparkSession, paths: str | Sequence[str], names: Sequence[str]) -> DataFrame:
        """Files of one header, in its column order, with their batch and file name."""
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        reader = spark.read.schema(schema).option("header", True).option("sep", self.separator)
        reader = reader.option("escape", '"').option("multiLine", self.multiline).options(**dict(self.options))
        paths = [paths] if isinstance(paths, str) else list(paths)
        file_name = F.col("_metadata.file_name")
        return reader.csv(paths).select(*[F.col(f"`{n}`") for n in names], batch_of(file_name).alias(BATCH))


COMMA = CsvReader(",")
SEMICOLON = CsvReader(";")


def read_files(
    spark: SparkSession,
    files: DataFrame,
    reader: CsvReader = COMMA,
    aliases: Mapping[str, str] = {},
    declared: Sequence[str] | None = None,
) -> DataFrame:
    """All given files as one frame of text columns plus the batch, matched by column name.

    The driver sees file names and header lines only, as it does for any file scan. With
    `declared`, every header must hold exactly those columns; otherwise a column that some
    headers lack is NULL for their files.
    """
    groups: dict[str, list[str]] = {}
    paths = [r["path"] for r in files.select("path").toLocalIterator()]
    if not paths:
        raise ValueError("No files to read")
    for path, header in headers(spark, paths).items():
        groups.setdefault(header, []).append(path)
    frames = []
    for header, paths in sorted(groups.items()):
        names = reader.columns(header)
        renamed = conformed_names(names, aliases)
        if declared is not None:
            try:
                require_columns(renamed, declared)
            except ValueError as error:
                raise ValueError(f"{error} (as in {min(paths)})") from error
        frames.append(reader.scan(spark, sorted(paths), names).toDF(*renamed, BATCH))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def profile_files(spark: SparkSession, path: str, key: str, reader: CsvReader = COMMA, aliases: Mapping[str, str] = {}) -> dict[str, DataFrame]:
    """Profile of a delivery: keys per file, keys overall, and value frequencies of all columns."""
    rows = read_files(spark, discover(spark, path), reader, aliases)
    counts = value_counts(rows, [c for c in rows.columns if c != BATCH])
    return {
        "files": key_summary(rows, key, [BATCH]),
        "keys": key_summary(rows, key),
        "values": counts,
        "columns": column_summary(counts),
    }
