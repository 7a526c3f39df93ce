import pytest

from tests import visits
from tests.conftest import rows
from tierflow.operators.conform import (
    BATCH,
    column_differences,
    conform,
    conformed_names,
    fail_on_null,
    null_counts,
    require_columns,
    require_not_null,
)
from tierflow.sources.landing import COMMA, SEMICOLON, discover, headers, profile_files, read_files


def test_discovery_and_headers(spark, tmp_path):
    visits.write(tmp_path / "in", "report_7.txt", "a@x.y,,,,1,")
    visits.write(tmp_path / "in" / "sub", "report_08_late.txt", header="﻿email,jk")
    found = discover(spark, str(tmp_path / "in"))
    assert rows(found, "file_name", "batch_id") == [("report_08_late.txt", "08"), ("report_7.txt", "7")]
    assert sorted(headers(spark, [r.path for r in found.collect()]).values()) == ["email,jk", visits.HEADER]


def test_paths_with_blanks_and_large_files(spark, tmp_path):
    folder = tmp_path / "in coming%20x"
    visits.write(folder, "report_7.txt", *[f"{i},é" for i in range(20_000)], header="a,b c")
    visits.write(folder, "report_8 b.txt", "1,2", header="b c,a")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = read_files(spark, discover(spark, str(folder)))
        assert df.count() == 20_001 and rows(df.where("a = '2'"), "bc") == [("1",), ("é",)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_file_without_a_header(spark, tmp_path):
    visits.write(tmp_path, "report_7.txt", "1", header="a")
    (tmp_path / "report_8.txt").write_text("\n1\n")
    with pytest.raises(ValueError, match="no header line"):
        read_files(spark, discover(spark, str(tmp_path)))


def test_files_with_swapped_columns_are_matched_by_name(spark, tmp_path):
    visits.write(tmp_path, "report_7.txt", "1,2", header="a,b c")
    visits.write(tmp_path, "report_8.txt", "1,2", '"x,""y""",', header="b c,a")
    df = read_files(spark, discover(spark, str(tmp_path)))
    assert rows(df, "a", "bc", BATCH) == [("1", "2", "7"), ("2", "1", "8"), (None, 'x,"y"', "8")]


def test_values_stay_text(spark, tmp_path):
    visits.write(tmp_path, "report_7.txt", "007;1.50", header="a;b")
    df = read_files(spark, discover(spark, str(tmp_path)), SEMICOLON)
    assert df.dtypes == [("a", "string"), ("b", "string"), (BATCH, "string")]
    assert rows(df) == [("007", "1.50", "7")]


def test_header_must_match_the_spec(spark, tmp_path):
    visits.write(tmp_path, "report_7.txt", "1", header="a")
    files = discover(spark, str(tmp_path))
    with pytest.raises(ValueError, match="Declared but not delivered: b; Delivered but not declared: a .*report_7"):
        read_files(spark, files, COMMA, {}, ["b"])
    with pytest.raises(ValueError, match="No files"):
        read_files(spark, files.where("batch_id = 'none'"))


def test_alias_conflicts_and_differences():
    assert conformed_names(["jk", "Fecha envio"], {"jk": "jyv"}) == ["jyv", "Fechaenvio"]
    with pytest.raises(ValueError, match="more than once: jyv"):
        conformed_names(["jk", "jyv"], {"jk": "jyv"})
    assert column_differences(["a", "x"], ["b", "a"]) == (["b"], ["x"])
    require_columns(["a", "b"], ["b", "a"])


def test_conform_and_null_check(spark, tmp_path):
    visits.write(tmp_path, "report_7.txt", "a@x.y,,SI,08/02/2013 18:30,x,-", header=visits.HEADER.replace("jyv", "fgh"))
    spec = visits.asset().raw
    raw = conform(read_files(spark, discover(spark, str(tmp_path)), aliases=spec.aliases), spec, "2024-01-01 00:00:00")
    assert raw.columns == spec.names + ["metadata_batch_id", "metadata_loaded_at", "metadata_etl_module"]
    assert rows(raw, "email", "Opens", "metadata_batch_id", "metadata_etl_module") == [("a@x.y", None, "7", "visits__load")]
    assert raw.schema["email"].metadata == {"comment": "Visitor"}
    assert rows(null_counts(raw, ["email", "Opens"])) == [("Opens", 1), ("email", 0)]
    require_not_null(raw, ["email"])
    assert fail_on_null(raw, ["email"]).count() == 1
    with pytest.raises(Exception, match="Required but empty: jyv"):
        fail_on_null(raw, ["email", "jyv", "Opens"]).count()
    with pytest.raises(ValueError, match="Required but empty: jyv, Opens"):
        require_not_null(raw, ["email", "jyv", "Opens"])


def test_profile_of_a_delivery(spark, tmp_path):
    visits.write(tmp_path, "report_7.txt", "a@x.y,1", "a@x.y,2", ",2", header="email,jk")
    visits.write(tmp_path, "report_8.txt", "a@x.y,2", header="fgh,email".replace("fgh,email", "email,fgh"))
    out = profile_files(spark, str(tmp_path), "email", aliases={"jk": "jyv", "fgh": "jyv"})
    assert rows(out["files"]) == [("7", 3, 2), ("8", 1, 1)]
    assert rows(out["keys"]) == [(4, 2)]
    assert ("jyv", "2", 3) in rows(out["values"])
    assert rows(out["columns"]) == [("email", 4, 2, 1), ("jyv", 4, 2, 0)]


def test_headers_of_many_files_are_read_in_one_job(spark, tmp_path):
    paths = []
    for i in range(20):
        paths.append(str(tmp_path / f"report_{i}.csv"))
        (tmp_path / f"report_{i}.csv").write_text(f"a,b{i}\n1,2\n")
    spark.sparkContext.setJobGroup("headers", "headers")
    try:
        found = headers(spark, paths)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("headers")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(found.values()) == sorted(f"a,b{i}" for i in range(20)) and len(jobs) == 1
