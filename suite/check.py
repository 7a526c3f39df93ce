"""Run the query list against DuckDB on the same files: `python -m suite.check [sf_dir] [name...]`."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

from suite.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def comparable(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[str]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def oracle_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    with duckdb.connect() as connection:
        for name in TABLES.split():
            path = f"{sf_dir}/{name}.parquet"
            if os.path.exists(path):
                connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
        result = connection.execute(sql)
        return [d[0] for d in result.description], result.fetchall()


def difference(df: DataFrame, sf_dir: str, sql: str) -> str | None:
    """None if both engines give the same columns and rows, else what differs."""
    ours = comparable(df.columns, [tuple(r) for r in df.collect()])
    theirs = comparable(*oracle_rows(sf_dir, sql))
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} and {theirs[0]}"
    if ours[1] != theirs[1]:
        mine, other = set(ours[1]) - set(theirs[1]), set(theirs[1]) - set(ours[1])
        return f"{len(ours[1])} and {len(theirs[1])} rows; only here {sorted(mine)[:2]}; only there {sorted(other)[:2]}"
    return None


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    failed = []
    for name in names:
        started = time.time()
        try:
            problem = difference(QUERIES[name](spark, sf_dir), sf_dir, ORACLES[name])
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name:24s} {time.time() - started:6.2f}s {'ok' if problem is None else problem}", flush=True)
        failed += [name] if problem else []
    print(f"{len(names) - len(failed)} of {len(names)} equal; differing: {failed}")


if __name__ == "__main__":
    main()
