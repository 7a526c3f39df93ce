import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tierflow.functions.types import record
from tierflow.operators.conform import with_comments
from tierflow.sources.tables import write_csv

NAME = "dev.bronze.raw_t"
SCHEMA = "v int, metadata_batch_id string"


def batch(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def test_one_batch_is_replaced_and_the_others_stay(spark, tables):
    tables.write(batch(spark, (1, "7"), (2, "7"), (3, "8")), NAME, batches=["7", "8"])
    tables.write(batch(spark, (9, "7")), NAME, batches=["7"])
    assert rows(tables.read(NAME)) == [(3, "8"), (9, "7")]
    assert rows(tables.read(NAME, "read_partition", batch_id="7")) == [(9, "7")]
    tables.write(batch(spark, (9, "7")).limit(0), NAME, batches=["7"])
    assert rows(tables.read(NAME)) == [(3, "8")]


def test_batch_ids_stay_text_and_prune_partitions(spark, tables):
    tables.write(batch(spark, (1, "007"), (2, "8")), NAME, batches=["007", "8"])
    df = tables.read(NAME, "read_partition", batch_id="007")
    assert rows(df) == [(1, "007")]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(metadata_batch_id" in plan


def test_modes(spark, tables):
    df = spark.createDataFrame([(1, True), (2, False)], "v int, metadata_audit_passed boolean")
    tables.replace(df, NAME)
    assert rows(tables.read(NAME, "read_audit_passed"), "v") == [(1,)]
    with pytest.raises(ValueError, match="Unknown read mode"):
        tables.read(NAME, "read_some")
    with pytest.raises(ValueError, match="No such way of writing"):
        tables.write(df, NAME, "append")
    with pytest.raises(ValueError, match="catalog.schema.table"):
        tables.table("only_a_table")


def test_replace_may_read_what_it_replaces(spark, tables):
    tables.replace(spark.createDataFrame([(1,), (2,)], "v int"), NAME)
    tables.replace(tables.read(NAME).select((F.col("v") + 1).cast("int").alias("v")), NAME)
    assert rows(tables.read(NAME)) == [(2,), (3,)]


def test_replace_of_a_partitioned_table(spark, tables):
    tables.write(batch(spark, (1, "7"), (2, "8")), NAME, batches=["7", "8"])
    tables.replace(tables.read(NAME).withColumn("v", F.col("v") + 10).where("v = 12").unionByName(batch(spark, (3, "9"))), NAME)
    assert rows(tables.read(NAME)) == [(12, "8"), (3, "9")]
    tables.write(batch(spark, (4, "9")), NAME, batches=["9"])
    assert rows(tables.read(NAME)) == [(12, "8"), (4, "9")]


def test_vacuum_keeps_the_current_state(spark, tables):
    for v in (1, 2, 3):
        tables.replace(spark.createDataFrame([(v,)], "v int"), NAME)
    assert len(tables.vacuum(NAME)) == 2
    assert rows(tables.read(NAME)) == [(3,)] and tables.vacuum(NAME) == []


def test_failed_replace_leaves_the_old_state(spark, tables):
    tables.replace(spark.createDataFrame([(1,), (2,)], "v int"), NAME)
    broken = tables.read(NAME).withColumn("v", F.when(F.col("v") == 1, 5).otherwise(F.raise_error(F.lit("no")).cast("int")))
    with pytest.raises(Exception):
        tables.replace(broken, NAME)
    assert rows(tables.read(NAME)) == [(1,), (2,)]


def test_upsert_creates_the_target_and_rewrites_only_its_batches(spark, tables):
    schema = "k string, v int, metadata_batch_id string"
    name = "dev.silver.audit_t"
    first = spark.createDataFrame([("a", 1, "7"), ("b", 1, "8")], schema)
    tables.upsert(name, first, ["k", "metadata_batch_id"], batches=["7", "8"], partition_by=["metadata_batch_id"])
    files = {f for f in tables.read(name).inputFiles() if "metadata_batch_id=8" in f}
    second = spark.createDataFrame([("a", 2, "7"), ("c", 2, "7")], schema)
    tables.upsert(name, second, ["k", "metadata_batch_id"], batches=["7"], partition_by=["metadata_batch_id"])
    assert rows(tables.read(name)) == [("a", 2, "7"), ("b", 1, "8"), ("c", 2, "7")]
    assert files == {f for f in tables.read(name).inputFiles() if "metadata_batch_id=8" in f}
    with pytest.raises(ValueError, match="rerun_null_keys"):
        tables.upsert(name, second, ["k", "metadata_batch_id"], rerun_null_keys=True)


def test_comments(spark, tables):
    tables.create(NAME, spark.createDataFrame([], SCHEMA).schema, comments={"v": "it's a value"}, description="it's a table")
    assert tables.comments(NAME) == {"v": "it's a value"}
    commented = with_comments(spark.createDataFrame([(1,)], "v int"), {"v": "from the spec"})
    tables.replace(commented, "dev.bronze.other")
    assert tables.comments("dev.bronze.other") == {"v": "from the spec"}


def test_comment_rows_without_a_call_per_column(spark, tables, monkeypatch):
    names = [f"c{i}" for i in range(2000)]
    wide = record(**{c: "integer" for c in names})
    tables.create("dev.bronze.wide", wide, comments={c: f"it's {c}" for c in names})
    tables.create("dev.bronze.split", record(v="string", day="string"), ["day"], {"day": "Partition"})

    def listed(*_):
        raise AssertionError("A call per column")

    monkeypatch.setattr(type(spark.catalog), "listColumns", listed)
    found = rows(tables.comment_rows(["dev.bronze.wide", "dev.bronze.split"]))
    expected = [("dev.bronze.wide", c, "int", f"it's {c}") for c in names]
    expected += [("dev.bronze.split", "v", "string", None), ("dev.bronze.split", "day", "string", "Partition")]
    assert found == sorted(expected, key=repr)
    assert tables.comment_rows([]).collect() == []


def test_clear_and_drop(spark, tables):
    tables.replace(spark.createDataFrame([(1,)], "v int"), NAME)
    tables.clear(NAME)
    assert tables.exists(NAME) and tables.read(NAME).isEmpty()
    tables.drop([NAME])
    assert not tables.exists(NAME)


def test_sql_binds_values_and_tables(spark, tables):
    tables.replace(spark.createDataFrame([(1, "it's"), (2, "b")], "v int, s string"), NAME)
    assert rows(tables.sql("SELECT v FROM {t} WHERE s = :s", {"s": "it's"}, t=NAME)) == [(1,)]


def test_csv_export(spark, tables, tmp_path):
    df = spark.createDataFrame([("a,b", 'q"t', None), ("", " ", "x")], "a string, b string, c string")
    tables.replace(df, NAME)
    tables.export_csv(NAME, str(tmp_path / "out"))
    back = spark.read.schema(df.schema).option("header", True).option("escape", '"').csv(str(tmp_path / "out"))
    # Delimited text has no way to tell an empty field from a missing one.
    assert rows(back) == [("a,b", 'q"t', None), (None, " ", "x")]
    write_csv(df, str(tmp_path / "semi"), ";")
    assert spark.read.option("header", True).option("sep", ";").csv(str(tmp_path / "semi")).columns == ["a", "b", "c"]


def test_rows_of_an_unlisted_batch_fail_the_write(spark, tables):
    schema = "k int, metadata_batch_id string"
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], schema)
    tables.overwrite_batches(old, "c.s.t", ["a", "b"])
    new = spark.createDataFrame([(9, "a"), (9, "b")], schema)
    with pytest.raises(Exception, match="Row outside the listed values of metadata_batch_id: b"):
        tables.overwrite_batches(new, "c.s.t", ["a"])
    with pytest.raises(Exception, match="Row outside the listed values"):
        tables.upsert("c.s.t", new, ["k", "metadata_batch_id"], batches=["a"])
    with pytest.raises(ValueError, match="needs an id"):
        tables.overwrite_batches(new, "c.s.t", ["a", ""])
    assert rows(tables.read("c.s.t")) == [(1, "a"), (2, "b"), (3, "b")]


def keyed(spark, tables, n=2000, parts=8):
    df = spark.range(n).selectExpr("id AS k", "id % 7 AS v", "CAST(NULL AS TIMESTAMP) AS t")
    tables.create_keyed("c.s.keyed", df.schema, ["k"], parts=parts, buckets=4)
    tables.merge("c.s.keyed", df, ["k"])
    return df


def files_of(df):
    return {r[0] for r in df.selectExpr("_metadata.file_path").distinct().collect()}


def test_merge_by_key_rewrites_the_parts_of_its_keys_only(spark, tables):
    old = keyed(spark, tables)
    assert rows(tables.read_keyed("c.s.keyed")) == rows(old)
    before = files_of(tables.read("c.s.keyed"))
    source = spark.createDataFrame([(5, 100), (5000, 200)], "k int, v int")
    touched = tables.touched_parts("c.s.keyed", source, ["k"])
    assert 0 < len(touched) <= 2
    options = {"created_col": "t", "updated_col": "t", "at": "2024-01-01 00:00:00"}
    tables.merge("c.s.keyed", source, ["k"], **options)
    from tierflow.operators.upsert import upsert

    assert rows(tables.read_keyed("c.s.keyed")) == rows(upsert(old, source, ["k"], **options))
    after = files_of(tables.read("c.s.keyed"))
    of_part = lambda files: {f for f in files if any(f"metadata_key_part={p}/" in f for p in touched)}
    # The other parts' files are the same ones.
    assert before - of_part(before) == after - of_part(after) and not of_part(before) & after


def test_merge_by_key_does_not_shuffle_the_table(spark, tables):
    keyed(spark, tables)
    source = spark.createDataFrame([(5, 100)], "k long, v long")
    merged = tables.merged_parts("c.s.keyed", source, ["k"])
    plan = merged._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "FileScan parquet" in line and "keyed" in line)
    assert "Bucketed: true" in scan and "PartitionFilters: [metadata_key_part" in scan.replace("isnotnull(metadata_key_part#", "metadata_key_part#")
    # One exchange: that of the source.
    assert plan.split("+- == Initial")[0].count("Exchange hashpartitioning") == 1


def test_merge_by_key_fails_on_repeated_and_missing_keys(spark, tables):
    keyed(spark, tables, 10)
    for values, message in ([(1, 1), (1, 2)], "Several source rows"), ([(None, 1)], "NULL in a key"):
        with pytest.raises(Exception, match=message):
            tables.merge("c.s.keyed", spark.createDataFrame(values, "k long, v long"), ["k"])
    assert tables.read("c.s.keyed").count() == 10
    tables.merge("c.s.keyed", spark.createDataFrame([], "k long, v long"), ["k"])
    assert tables.read("c.s.keyed").count() == 10
