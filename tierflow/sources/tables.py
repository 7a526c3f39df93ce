"""Named Parquet tables `catalog.schema.table` on the session catalog.

Open-source Spark's session catalog has one namespace level, so catalog and schema together
name a database. Tables are external, below one root folder that all executors can reach; use
a session with a persistent catalog (a metastore) to find them again later.

Writes replace whole partitions or whole tables. A whole-table write goes to a new folder, then
the table is pointed there: a failed write leaves the old state, and a query may read the table
it replaces. A partition write is staged by Spark and moved into place on commit.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierflow.operators.conform import BATCH, PASSED
from tierflow.operators.upsert import upsert
from tierflow.session import configure

# Partition column of a table that is kept by key.
KEY_PART = "metadata_key_part"
READ_MODES = ("read_all", "read_partition", "read_audit_passed")
WRITE_MODES = ("overwrite_partition",)


class Tables:
    """Reads, writes and maintenance of named tables below `root`."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = configure(spark)
        self.root = root.rstrip("/")

    # ---- names

    def table(self, name: str) -> str:
        """The session-catalog name of `catalog.schema.table`."""
        parts = name.split(".")
        if len(parts) != 3 or not all(parts):
            raise ValueError(f"Table names have the form catalog.schema.table: {name}")
        return f"`{parts[0]}__{parts[1]}`.`{parts[2]}`"

    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(self.table(name).replace("`", ""))

    def _new_location(self, name: str) -> str:
        return f"{self.root}/{name.replace('.', '/')}/{uuid.uuid4().hex}"

    def _partition_columns(self, name: str) -> list[str]:
        columns = self.spark.catalog.listColumns(self.table(name).replace("`", ""))
        return [c.name for c in columns if c.isPartition]

    # ---- reading

    def read(self, name: str, read_mode: str = "read_all", batch_id: str | None = None) -> DataFrame:
        """A table as a whole, one batch of it (other partitions are not read), or its passed rows."""
        if read_mode not in READ_MODES:
            raise ValueError(f"Unknown read mode: {read_mode}")
        df = self.spark.read.table(self.table(name))
        if read_mode == "read_partition":
            return df.where(F.col(BATCH) == F.lit(batch_id))
        if read_mode == "read_audit_passed":
            return df.where(F.col(PASSED))
        return df

    def sql(self, text: str, args: Mapping[str, Any] | None = None, **tables: str) -> DataFrame:
        """Run SQL with bound values (`:name`) and tables given as `{name}`."""
        frames = {alias: self.read(name) for alias, name in tables.items()}
        return self.spark.sql(text, args=dict(args or {}), **frames)

    # ---- definition

    def create(
        self,
        name: str,
        schema: T.StructType,
        partition_by: Sequence[str] = (),
        comments: Mapping[str, str] = {},
        description: str | None = None,
    ) -> None:
        """Define an empty table unless it exists."""
        if self.exists(name):
            return
        database = self.table(name).split(".")[0]
        self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS {database} LOCATION '{self.root}/_databases/{database.strip('`')}'")
        ordered = [f for f in schema.fields if f.name not in partition_by]
        ordered += [schema[c] for c in partition_by]
        # Comments are part of the definition: those of partition columns cannot be set later.
        given = {c: {"comment": text} for c, text in comments.items()}
        about = [T.StructField(f.name, f.dataType, f.nullable, {**f.metadata, **given.get(f.name, {})}) for f in ordered]
        self._define(name, T.StructType(about), partition_by, self._new_location(name), description)

    def _define(
        self, name: str, schema: T.StructType, partition_by: Sequence[str], location: str, description: str | None = None
    ) -> None:
        if not partition_by:
            # The schema goes to the catalog as it is: the text of a table of many columns is slow to parse.
            plain = self.table(name).replace("`", "")
            self.spark.catalog.createTable(plain, location, "parquet", schema, description)
            return
        partitioned = f"PARTITIONED BY ({', '.join(f'`{c}`' for c in partition_by)})"
        about = f"COMMENT {self._literal(description)}" if description else ""
        self.spark.sql(
            f"CREATE TABLE {self.table(name)} ({schema.toDDL()}) USING parquet {partitioned} {about} "
            f"LOCATION '{location}'"
        )

    def comment(self, name: str, comments: Mapping[str, str]) -> None:
        """Set the comments of columns that the table is not partitioned by."""
        partitions = self._partition_columns(name)
        for column, text in comments.items():
            if column in partitions:
                continue
            self.spark.sql(f"ALTER TABLE {self.table(name)} ALTER COLUMN `{column}` COMMENT {self._literal(text)}")

    def comments(self, name: str) -> dict[str, str]:
        columns = self.spark.catalog.listColumns(self.table(name).replace("`", ""))
        return {c.name: c.description for c in columns if c.description}

    def comment_rows(self, names: Iterable[str]) -> DataFrame:
        """(table_name, column_name, data_type, comment) of the columns of some tables, as the catalog has them."""
        empty = self.spark.createDataFrame([], "table_name string, column_name string, data_type string, comment string")
        return reduce(DataFrame.unionByName, [self._described(name) for name in names], empty)

    def _described(self, name: str) -> DataFrame:
        """A table's columns as one frame, which stays in the catalog's process: a call per column would take its time."""
        # After the columns, a description lists those of the partitions once more.
        columns = self.spark.sql(f"DESCRIBE TABLE {self.table(name)}").limit(len(self.read(name).columns))
        return columns.select(F.lit(name).alias("table_name"), F.col("col_name").alias("column_name"), "data_type", "comment")

    def drop(self, names: Iterable[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table(name)}")

    def clear(self, name: str) -> None:
        """Empty a table but keep its definition."""
        self.replace(self.read(name).limit(0), name)

    # ---- writing

    def write(
        self, df: DataFrame, name: str, write_mode: str = "overwrite_partition", batches: Iterable[str] | None = None
    ) -> None:
        """Write by mode; `batches` are the ids this write stands for, empty ones included, if not just those of `df`."""
        if write_mode not in WRITE_MODES:
            raise ValueError(f"No such way of writing: {write_mode}")
        self.overwrite_batches(df, name, batches)

    def overwrite_batches(self, df: DataFrame, name: str, batches: Iterable[str] | None = None) -> None:
        """Replace exactly the given batches by the rows of `df`; other batches stay as they are.

        A row of another batch fails the write. A listed batch without rows ends up empty. Without
        a list, the batches that `df` has rows of are replaced. Rows are rebalanced by batch before the
        write: small batches make one file, a large one is split over many tasks.
        """
        self.create(name, df.schema, [BATCH])
        if batches is not None:
            df = self._only(df, BATCH, sorted(set(batches)))
        batches = sorted(set(batches or ()))
        # Only a batch that has rows now can be left over by a write without rows for it.
        present = self._batches_among(self.read(name), batches)
        filled = self._batches_among(df, present) if present else set()
        self._insert_partitions(df, name, [BATCH])
        for batch in sorted(present - filled):
            self.clear_partition(name, {BATCH: batch})

    @staticmethod
    def _only(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
        """`df`, failing the job that reads it at a row outside the listed partitions: no scan of its own."""
        if not all(values):
            raise ValueError("A batch needs an id")
        error = F.concat(F.lit(f"Row outside the listed values of {column}: "), F.coalesce(F.col(column).cast("string"), F.lit("NULL")))
        listed = F.coalesce(F.col(column).isin(list(values)), F.lit(False))
        # In the column itself: a filter could be moved below the joins that leave the row out.
        checked = F.when(listed, F.col(column)).otherwise(F.raise_error(error).cast(df.schema[column].dataType))
        return df.withColumn(column, checked)

    @staticmethod
    def _batches_among(df: DataFrame, batches: Iterable[str]) -> set[str]:
        return {r[0] for r in df.where(F.col(BATCH).isin(list(batches))).select(BATCH).distinct().collect()}

    def _insert_partitions(self, df: DataFrame, name: str, partition_by: Sequence[str]) -> None:
        (
            df.select(*self.spark.read.table(self.table(name)).columns)
            .hint("rebalance", *partition_by)
            .write.insertInto(self.table(name).replace("`", ""), overwrite=True)
        )
        self.spark.catalog.refreshTable(self.table(name).replace("`", ""))

    def clear_partition(self, name: str, partition: Mapping[str, Any]) -> None:
        """Empty one partition; writing no rows to it would leave it as it is."""
        table = self.read(name)
        empty = self.spark.createDataFrame([], table.drop(*partition).schema)
        values = ", ".join(f"`{c}` = {self._literal(v)}" for c, v in partition.items())
        self.spark.sql(
            f"INSERT OVERWRITE TABLE {self.table(name)} PARTITION ({values}) SELECT * FROM {{empty}}", empty=empty
        )
        self.spark.catalog.refreshTable(self.table(name).replace("`", ""))

    @staticmethod
    def _literal(value: Any) -> str:
        if isinstance(value, bool):
            return str(value).lower()
        return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"

    def replace(self, df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> None:
        """Replace the whole table. `df` may read the table: the new state goes to a new folder."""
        self.create(name, df.schema, partition_by)
        location = self._new_location(name)
        partitions = self._partition_columns(name)
        ordered = df.select(*self.read(name).columns)
        writer = (ordered.hint("rebalance", *partitions) if partitions else ordered).write.mode("error")
        (writer.partitionBy(*partitions) if partitions else writer).parquet(location)
        if partitions:
            # The catalog knows each partition's folder, so the table is defined anew over the new ones.
            schema = self.read(name).schema
            self.drop([name])
            self._define(name, schema, partitions, location)
            self.spark.sql(f"MSCK REPAIR TABLE {self.table(name)}")
        else:
            self.spark.sql(f"ALTER TABLE {self.table(name)} SET LOCATION '{location}'")
        self.spark.catalog.refreshTable(self.table(name).replace("`", ""))

    def write_partitions(self, df: DataFrame, name: str, partition_by: Sequence[str]) -> None:
        """Replace the partitions present in `df`; writing the same rows again changes nothing."""
        self.create(name, df.schema, partition_by)
        self._insert_partitions(df, name, partition_by)

    def vacuum(self, name: str) -> list[str]:
        """Delete the folders that earlier whole-table writes left; no reader may still use them."""
        detail = self.spark.sql(f"DESCRIBE EXTENDED {self.table(name)}").where("col_name = 'Location'").first()
        current = detail["data_type"].rstrip("/").rsplit("/", 1)[-1]
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        base = hadoop.Path(f"{self.root}/{name.replace('.', '/')}")
        system = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
        old = [s.getPath() for s in system.listStatus(base) if s.getPath().getName() != current]
        for path in old:
            system.delete(path, True)
        return [path.toString() for path in old]

    def upsert(
        self,
        name: str,
        source: DataFrame,
        keys: Sequence[str],
        update_columns: Sequence[str] | None = None,
        created_col: str | None = None,
        updated_col: str | None = None,
        at: datetime | str | None = None,
        batches: Iterable[str] | None = None,
        partition_by: Sequence[str] = (),
        rerun_null_keys: bool = False,
    ) -> None:
        """Merge `source` into a table, which is created if missing.

        If the table is partitioned by a key column and `batches` lists its values in the
        source, only those partitions are read and rewritten; a source row of another partition
        fails the write. `rerun_null_keys` is for a source
        that holds whole batches: rows with a NULL key replace those of an earlier merge of the
        same batches; without it a NULL key is an error.
        """
        self.create(name, source.schema, partition_by)
        target = self.read(name)
        options: dict[str, Any] = dict(
            update_columns=update_columns,
            created_col=created_col,
            updated_col=updated_col,
            at=at,
            allow_null_keys=rerun_null_keys,
            replace_null_keys=rerun_null_keys,
        )
        partitions = self._partition_columns(name)
        if rerun_null_keys and (batches is None or not partitions):
            raise ValueError("rerun_null_keys needs the batches of the source and a table partitioned by them")
        if batches is not None and partitions and set(partitions) <= set(keys):
            ids = sorted(set(batches))
            part = target.where(F.col(partitions[0]).isin(ids))
            source = self._only(source, partitions[0], ids)
            self._insert_partitions(upsert(part, source, keys, **options), name, partitions)
        else:
            self.replace(upsert(target, source, keys, **options), name)

    # ---- tables kept by key

    def create_keyed(self, name: str, schema: T.StructType, keys: Sequence[str], parts: int = 64, buckets: int = 64) -> None:
        """Define a table whose rows lie by the hash of their key, in `parts` partitions of `buckets` buckets.

        `merge` then rewrites only the parts that hold a key of the source, and reads them as they
        lie. For large tables choose the parts by the share of the table that a source touches, and
        buckets so that one fits a task.
        """
        if self.exists(name):
            return
        database = self.table(name).split(".")[0]
        self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS {database} LOCATION '{self.root}/_databases/{database.strip('`')}'")
        columns = T.StructType([*schema.fields, T.StructField(KEY_PART, T.IntegerType())])
        by = ", ".join(f"`{k}`" for k in keys)
        self.spark.sql(
            f"CREATE TABLE {self.table(name)} ({columns.toDDL()}) USING parquet PARTITIONED BY (`{KEY_PART}`) "
            f"CLUSTERED BY ({by}) INTO {buckets} BUCKETS LOCATION '{self._new_location(name)}' "
            f"TBLPROPERTIES ('key_parts' = '{parts}', 'key_buckets' = '{buckets}')"
        )

    def read_keyed(self, name: str) -> DataFrame:
        """A table kept by key, without the column that places its rows."""
        return self.read(name).drop(KEY_PART)

    def key_layout(self, name: str) -> tuple[int, int]:
        """Parts and buckets of a table kept by key."""
        properties = {r.key: r.value for r in self.spark.sql(f"SHOW TBLPROPERTIES {self.table(name)}").collect()}
        return int(properties["key_parts"]), int(properties["key_buckets"])

    def key_part(self, name: str, keys: Sequence[str]) -> Column:
        """The part in which a table kept by key has a row, by the types that the table has its keys in."""
        types = dict(self.read(name).dtypes)
        return F.pmod(F.xxhash64(*[F.col(k).cast(types[k]) for k in keys]), F.lit(self.key_layout(name)[0])).cast("int")

    def touched_parts(self, name: str, source: DataFrame, keys: Sequence[str]) -> list[int]:
        """The parts that hold a key of `source`: numbers, at most as many as the table has parts."""
        return sorted(r[0] for r in source.select(self.key_part(name, keys).alias("p")).distinct().collect())

    def merged_parts(self, name: str, source: DataFrame, keys: Sequence[str], **options: Any) -> DataFrame:
        """The next state of the parts that hold a key of `source`, with the column that places the rows.

        Of the table only these parts are read, bucket by bucket: it is not shuffled; the source is, to
        the table's buckets.
        """
        types = dict(self.read_keyed(name).dtypes)
        source = source.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in source.columns])
        touched = self.touched_parts(name, source, keys)
        target = self.read(name).where(F.col(KEY_PART).isin(touched)).drop(KEY_PART)
        # The hash of a bucketed table and that of a shuffle are the same, so rows of a key meet where the table has them.
        buckets = self.key_layout(name)[1]
        merged = upsert(target, source.repartition(buckets, *keys), keys, **options)
        return merged.withColumn(KEY_PART, self.key_part(name, keys))

    def rewrite_parts(self, name: str, rows: DataFrame) -> None:
        """Replace the parts that `rows` has rows of; `rows` may read the table."""
        rows.select(*self.read(name).columns).write.insertInto(self.table(name).replace("`", ""), overwrite=True)
        self.spark.catalog.refreshTable(self.table(name).replace("`", ""))

    def merge(self, name: str, source: DataFrame, keys: Sequence[str], **options: Any) -> None:
        """Merge `source` into a table kept by key: `upsert`, and its options, where the source has keys."""
        self.rewrite_parts(name, self.merged_parts(name, source, keys, **options))

    def export_csv(self, name: str, path: str) -> None:
        """A deliverable as delimited text with a header; as many files as the table needs."""
        write_csv(self.read(name), path)


def write_csv(df: DataFrame, path: str, separator: str = ",", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("error").option("header", True).option("sep", separator).option("escape", '"')
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)
