from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tests import visits
from tests.conftest import rows
from tierflow.plans import runs
from tierflow.plans.governance import EVENT_ERRORS, INGESTIONS, init_governance
from tierflow.plans.runs import Run, export, process, read_history, summarize, summarize_batches
from tierflow.streaming.ingest import ingest_available

TARGETS = {"visitor": "out.db.visitor", "statistic": "out.db.statistic", "event_errors": "out.db.event_errors"}
GOLD = "domain_dev.gold_analytics.visitor"


def deliver(folder):
    visits.write(
        folder / "1",
        "report_7.txt",
        "ana@x.y,,SI,08/02/2013 18:30,1,unknown",
        "bob@x.y,,YES,2013-02-08 18:30,1000,a",
        "dup@x.y,,,08/02/2013 18:30,1,",
        "dup@x.y,,,08/02/2013 18:31,99,",
        "bad,,,08/02/2013 18:30,1,-",
    )
    visits.write(folder / "1", "report_8.txt", 'ana@x.y,,"a,,b",09/02/2013 18:30,SI,2', header="email,jk,Links,Fecha envio,Baja,Opens")
    visits.write(folder / "2", "report_9.txt", "cyd@x.y,,,01/03/2013 00:00,0,", "ana@x.y,,SI,01/03/2013 00:00,3,b", header=visits.HEADER.replace("jyv", "fgh"))


def state(tables, asset):
    names = [asset.raw.name, asset.audit.name, EVENT_ERRORS, INGESTIONS, GOLD, *TARGETS.values()]
    return [rows(tables.read(n)) for n in names] + [rows(read_history(tables, asset.historic.name))]


@pytest.fixture
def setup(spark, tables, tmp_path):
    init_governance(tables, "analytics", "someone", "2013-01-01 00:00:00")
    deliver(tmp_path / "landing")
    return tables, visits.asset(), tmp_path / "landing"


def full_run(run, asset, path):
    landed = process(run, asset, str(path))
    summarize(run, asset, GOLD, "FechaEnvio")
    export(run, asset, GOLD, TARGETS)
    return landed


def test_two_runs_and_reruns(setup):
    tables, asset, landing = setup
    first = Run(tables, "20130208_000000", "2013-02-08 20:00:00")
    assert full_run(first, asset, landing / "1") == ["7", "8"]

    audit = tables.read(asset.audit.name)
    assert rows(audit, "metadata_batch_id", "Email", "Baja", "Opens", "Links", "metadata_audit_id", "metadata_audit_passed") == sorted(
        [
            ("7", "ana@x.y", "SI", 1, None, 1, True),
            ("7", "bob@x.y", None, None, '["a"]', 2, False),
            ("7", None, None, 1, None, 2, False),
            ("8", "ana@x.y", "SI", 2, '["a","b"]', 1, True),
        ],
        key=repr,
    )
    assert rows(tables.read(EVENT_ERRORS), "record_identifier", "column_name", "screen_code", "original_value") == sorted(
        [
            ("bob@x.y", "Baja", "is_in_list", "YES"),
            ("bob@x.y", "FechaEnvio", "is_date_format", "2013-02-08 18:30"),
            ("bob@x.y", "Opens", "is_in_bounds", "1000"),
            ("dup@x.y", "Email", "is_primary_key", "dup@x.y"),
            ("dup@x.y", "Opens", "is_in_bounds", "99"),
            ("bad", "Email", "is_email_format", "bad"),
        ]
    )
    assert rows(tables.read(INGESTIONS), "table_name", "batch_id", "initial_rows", "final_rows", "accumulated_rows") == [
        ("audit_visits", "7", 5, 3, 4),
        ("audit_visits", "8", 1, 1, 4),
        ("historic_visits", "all", 0, 1, 1),
        ("raw_visits", "7", 5, 5, 6),
        ("raw_visits", "8", 1, 1, 6),
    ]
    assert rows(tables.read(GOLD), "Email", "visitasTotales", "visitasAnioActual", "visitasMesActual") == [("ana@x.y", 2, 2, 2)]
    assert rows(tables.read(TARGETS["statistic"]), "Email", "metadata_batch_id") == [("ana@x.y", "7"), ("ana@x.y", "8")]

    before = state(tables, asset)
    assert full_run(first, asset, landing / "1") == []
    assert state(tables, asset) == before

    second = Run(tables, "20130214_000000", "2013-03-02 00:00:00")
    assert full_run(second, asset, landing / "2") == ["9"]
    history = read_history(tables, asset.historic.name)
    assert rows(history.selectExpr("Email", "Opens", "is_current", "cast(valid_from as string)", "cast(valid_to as string)")) == [
        ("ana@x.y", 2, False, "2013-02-08 20:00:00", "2013-03-02 00:00:00"),
        ("ana@x.y", 3, True, "2013-03-02 00:00:00", "2200-01-01 00:00:00"),
        ("cyd@x.y", 0, True, "2013-03-02 00:00:00", "2200-01-01 00:00:00"),
    ]
    assert rows(tables.read(TARGETS["visitor"]), "Email", "visitasTotales", "visitasMesActual") == [("ana@x.y", 3, 2), ("cyd@x.y", 1, 0)]
    assert tables.read(TARGETS["event_errors"]).count() == 6
    assert dict(tables.read(TARGETS["visitor"]).dtypes)["visitasTotales"] == "int"
    before = state(tables, asset)
    full_run(second, asset, landing / "2")
    assert state(tables, asset) == before


def test_run_that_failed_in_audit_is_resumed(setup, monkeypatch):
    tables, asset, landing = setup
    run = Run(tables, "20130208_000000", "2013-02-08 20:00:00")

    def fail(*args, **kwargs):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(runs, "audit_rows", fail)
        with pytest.raises(RuntimeError):
            process(run, asset, str(landing / "1"))
    assert process(run, asset, str(landing / "1")) == []
    assert tables.read(asset.audit.name).count() == 4
    assert read_history(tables, asset.historic.name).count() == 1


def test_history_that_failed_is_caught_up_by_the_next_run(setup, monkeypatch):
    tables, asset, landing = setup

    def fail(*args, **kwargs):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(runs, "scd2_changes", fail)
        with pytest.raises(RuntimeError):
            process(Run(tables, "20130208_000000", "2013-02-08 20:00:00"), asset, str(landing / "1"))
    assert process(Run(tables, "20130214_000000", "2013-03-02 00:00:00"), asset, str(landing / "2")) == ["9"]
    assert rows(read_history(tables, asset.historic.name), "Email", "Opens", "is_current") == [
        ("ana@x.y", 3, True),
        ("cyd@x.y", 0, True),
    ]


def test_run_reads_only_its_batches_for_the_history(setup, monkeypatch):
    tables, asset, landing = setup
    process(Run(tables, "20130208_000000", "2013-02-08 20:00:00"), asset, str(landing / "1"))
    seen = []
    real = runs.scd2_changes
    monkeypatch.setattr(runs, "scd2_changes", lambda current, snapshot, *a: seen.append(snapshot) or real(current, snapshot, *a))
    process(Run(tables, "20130214_000000", "2013-03-02 00:00:00"), asset, str(landing / "2"))
    assert rows(seen[0].select("metadata_batch_id").distinct()) == [("9",)]


def history_of(tables, asset):
    return rows(read_history(tables, asset.historic.name), "Email", "Opens", "is_current")


def line(email, opens):
    return f"{email},,SI,08/02/2013 18:30,{opens},"


def test_steps_of_one_run_keep_each_others_closed_versions(setup, tmp_path):
    """Three deliveries under one run id, each closing another key's version."""
    tables, asset, _ = setup
    run = Run(tables, "20130208_000000", "2013-02-08 20:00:00")
    late = Run(tables, "20130208_000000", "2013-02-09 20:00:00")
    visits.write(tmp_path / "a", "report_1.txt", line("ana@x.y", 1), line("bob@x.y", 1))
    visits.write(tmp_path / "b", "report_2.txt", line("ana@x.y", 2))
    visits.write(tmp_path / "c", "report_3.txt", line("bob@x.y", 2))
    for step, folder in ((run, "a"), (late, "b"), (late, "c")):
        process(step, asset, str(tmp_path / folder))
    expected = [("ana@x.y", 1, False), ("ana@x.y", 2, True), ("bob@x.y", 1, False), ("bob@x.y", 2, True)]
    assert history_of(tables, asset) == expected
    process(late, asset, str(tmp_path / "b"))
    runs.audit_to_historic(late, asset, ["3"])
    assert history_of(tables, asset) == expected


def test_micro_batches_keep_each_others_closed_versions(setup, tmp_path):
    tables, asset, _ = setup
    visits.write(tmp_path / "in", "report_1.txt", line("ana@x.y", 1), line("bob@x.y", 1))
    first = Run(tables, "20130208_000000", "2013-02-08 20:00:00")
    ingest_available(first, asset, str(tmp_path / "in"), str(tmp_path / "c"), max_files=1).awaitTermination()
    visits.write(tmp_path / "in", "report_2.txt", line("ana@x.y", 2))
    visits.write(tmp_path / "in", "report_3.txt", line("bob@x.y", 2))
    second = Run(tables, "20130209_000000", "2013-02-09 20:00:00")
    ingest_available(second, asset, str(tmp_path / "in"), str(tmp_path / "c"), max_files=1).awaitTermination()
    assert history_of(tables, asset) == [("ana@x.y", 1, False), ("ana@x.y", 2, True), ("bob@x.y", 1, False), ("bob@x.y", 2, True)]


def test_key_that_fails_when_screened_again_is_closed(setup, tmp_path):
    tables, asset, _ = setup
    visits.write(tmp_path / "in" / "a", "report_1.txt", line("ana@x.y", 15), line("bob@x.y", 1))
    visits.write(tmp_path / "in" / "b", "report_2.txt", line("bob@x.y", 1))
    process(Run(tables, "20130208_000000", "2013-02-08 20:00:00"), asset, str(tmp_path / "in"))
    bounds = {"validation": "is_in_bounds", "min_allowed": 0, "max_allowed": 10}
    columns = tuple(replace(c, validations=(bounds,)) if c.name == "Opens" else c for c in asset.audit.columns)
    strict = replace(asset, audit=replace(asset.audit, columns=columns))
    again = Run(tables, "20130209_000000", "2013-02-09 20:00:00")
    runs.raw_to_audit(again, strict, ["1"])
    runs.audit_to_historic(again, strict, ["1"])
    assert history_of(tables, strict) == [("ana@x.y", 15, False), ("bob@x.y", 1, True)]


def test_empty_delivery_is_recorded_once(setup, tmp_path):
    tables, asset, _ = setup
    visits.write(tmp_path / "a", "report_1.txt")
    run = Run(tables, "20130208_000000", "2013-02-08 20:00:00")
    assert process(run, asset, str(tmp_path / "a")) == ["1"]
    assert rows(tables.read(INGESTIONS).where("batch_id = '1'"), "table_name", "initial_rows", "final_rows") == [
        ("audit_visits", 0, 0),
        ("raw_visits", 0, 0),
    ]
    assert process(run, asset, str(tmp_path / "a")) == []


def test_file_without_a_batch_id_is_refused(setup, tmp_path):
    tables, asset, _ = setup
    visits.write(tmp_path / "a", "report.txt", line("ana@x.y", 1))
    with pytest.raises(Exception, match="No batch id in the file name report.txt"):
        process(Run(tables, "20130208_000000", "2013-02-08 20:00:00"), asset, str(tmp_path / "a"))
    assert tables.read(INGESTIONS).isEmpty()


def with_key(asset, *names):
    def keyed(spec):
        return replace(spec, columns=tuple(replace(c, is_primary_key=c.name.lower() in names) for c in spec.columns))

    return replace(asset, raw=keyed(asset.raw), audit=keyed(asset.audit))


def test_table_without_a_key(setup, tmp_path):
    tables, asset, _ = setup
    asset = with_key(asset)
    visits.write(tmp_path / "a", "report_1.txt", line("ana@x.y", 1), line("ana@x.y", 1), line("bad", 1))
    run = Run(tables, "20130208_000000", "2013-02-08 20:00:00")
    runs.land_to_raw(run, asset, runs.discover(tables.spark, str(tmp_path / "a")), ["1"])
    for _ in range(2):
        runs.raw_to_audit(run, asset, ["1"])
        assert rows(tables.read(asset.audit.name), "Email", "metadata_audit_id") == [("ana@x.y", 1), ("ana@x.y", 1), (None, 2)]
    with pytest.raises(ValueError, match="no key"):
        summarize(run, asset, GOLD, "FechaEnvio")


def test_composite_key_in_summary_and_export(setup, tmp_path):
    tables, asset, _ = setup
    asset = with_key(asset, "email", "opens")
    visits.write(tmp_path / "a", "report_1.txt", line("ana@x.y", 1), line("ana@x.y", 2))
    visits.write(tmp_path / "a", "report_2.txt", line("ana@x.y", 2))
    full_run(Run(tables, "20130208_000000", "2013-02-08 20:00:00"), asset, tmp_path / "a")
    assert rows(tables.read(TARGETS["visitor"]), "Email", "Opens", "visitasTotales") == [("ana@x.y", 1, 1), ("ana@x.y", 2, 2)]
    assert dict(tables.read(TARGETS["visitor"]).dtypes)["Opens"] == "int"


def test_audit_again_updates_instead_of_adding(setup):
    tables, asset, landing = setup
    run = Run(tables, "20130208_000000", "2013-02-08 20:00:00")
    process(run, asset, str(landing / "1"))
    again = Run(tables, "20130208_000000", "2013-02-09 20:00:00")
    runs.raw_to_audit(again, asset, ["7"])
    audit = tables.read(asset.audit.name)
    assert audit.count() == 4
    times = audit.where("Email = 'ana@x.y' AND metadata_batch_id = '7'").selectExpr(
        "cast(metadata_created_at as string)", "cast(metadata_updated_at as string)", "metadata_deleted_at"
    )
    assert rows(times) == [("2013-02-08 20:00:00", "2013-02-09 20:00:00", None)]
    assert tables.read(EVENT_ERRORS).count() == 6


def test_history_without_passed_rows_closes_everything(setup):
    tables, asset, landing = setup
    process(Run(tables, "20130208_000000", "2013-02-08 20:00:00"), asset, str(landing / "1"))
    failed = tables.read(asset.audit.name).withColumn("metadata_audit_passed", F.lit(False))
    tables.replace(failed, asset.audit.name)
    runs.audit_to_historic(Run(tables, "20130209_000000", "2013-02-09 00:00:00"), asset)
    assert rows(read_history(tables, asset.historic.name), "Email", "is_current") == [("ana@x.y", False)]


def test_rejected_delivery_leaves_no_trace(setup):
    tables, asset, landing = setup
    visits.write(landing / "3", "report_10.txt", "1", header="other")
    with pytest.raises(ValueError, match="Declared but not delivered"):
        process(Run(tables, "20130220_000000", "2013-02-20 00:00:00"), asset, str(landing / "3"))
    assert tables.read(INGESTIONS).isEmpty()


def test_null_in_a_required_column_rejects_the_delivery(setup):
    tables, asset, landing = setup
    strict = replace(asset, raw=replace(asset.raw, columns=tuple(replace(c, is_nullable=c.name != "Opens") for c in asset.raw.columns)))
    visits.write(landing / "4", "report_11.txt", "ana@x.y,,SI,08/02/2013 18:30,1,", "bob@x.y,,SI,08/02/2013 18:30,,")
    run = Run(tables, "20130220_000000", "2013-02-20 00:00:00")
    with pytest.raises(Exception, match="Required but empty: Opens"):
        process(run, strict, str(landing / "4"))
    assert tables.read(asset.raw.name).isEmpty() and tables.read(INGESTIONS).isEmpty()


def test_stream_ingests_each_file_once(setup, tmp_path):
    tables, asset, landing = setup
    arriving = tmp_path / "arriving"
    checkpoint = str(tmp_path / "checkpoint")
    visits.write(arriving, "report_7.txt", "ana@x.y,,SI,08/02/2013 18:30,1,")
    ingest_available(Run(tables, "20130208_000000", "2013-02-08 20:00:00"), asset, str(arriving), checkpoint).awaitTermination()
    assert tables.read(asset.audit.name).count() == 1
    visits.write(arriving, "report_8.txt", "cyd@x.y,,SI,08/02/2013 18:30,1,")
    second = Run(tables, "20130209_000000", "2013-02-09 20:00:00")
    ingest_available(second, asset, str(arriving), checkpoint).awaitTermination()
    assert rows(tables.read(asset.audit.name), "Email") == [("ana@x.y",), ("cyd@x.y",)]
    assert rows(tables.read(INGESTIONS).where("table_name = 'raw_visits'"), "batch_id", "rundate") == [
        ("7", "20130208_000000"),
        ("8", "20130209_000000"),
    ]


def test_summary_kept_by_batches(setup):
    """Equal to the full summary after each run, screened-again batches and runs that stopped before it included."""
    tables, asset, landing = setup
    kept, state = f"{GOLD}_kept", f"{GOLD}_state"

    def both(run):
        summarize(run, asset, GOLD, "FechaEnvio")
        summarize_batches(run, asset, kept, "FechaEnvio", state)
        assert rows(tables.read(kept)) == rows(tables.read(GOLD))

    first = Run(tables, "20130208_000000", "2013-02-08 20:00:00")
    process(first, asset, str(landing / "1"))
    both(first)
    assert {r[0] for r in tables.read(state).select("metadata_batch_id").distinct().collect()} == {"7", "8"}
    # This run stops before its summary; the next one catches up.
    process(Run(tables, "20130301_000000", "2013-03-01 20:00:00"), asset, str(landing / "2"))
    later = Run(tables, "20130305_000000", "2013-03-05 20:00:00")
    both(later)
    assert {r[0] for r in tables.read(state).select("metadata_batch_id").distinct().collect()} == {"7", "8", "9"}
    # A batch is screened again by other rules.
    strict = replace(asset, hook=lambda df: df.withColumn("Email", F.lit(None).cast("string")))
    runs.raw_to_audit(Run(tables, "20130306_000000", "2013-03-06 20:00:00"), strict, ["8"])
    both(Run(tables, "20130306_000000", "2013-03-06 20:00:00"))
    both(Run(tables, "20130307_000000", "2013-03-07 20:00:00"))
