import pytest

from tests.conftest import rows
from tierflow.plans import governance
from tierflow.plans.governance import (
    CATALOGS,
    DETAILS,
    INGESTIONS,
    SCHEMAS,
    TABLES,
    fetch_spec,
    init_governance,
    register_specs,
    reset,
)
from tierflow.plans.spec import ColumnSpec, TableSpec, layer_attributes, resolve_layers, screen_plan
from tierflow.sources.specs import read_specs

YAML = """
name: {name}
layers:
  raw:
    write_mode: overwrite_partition
    version: 1
    description: As delivered
    owner: someone
    retention_policy: permanent
    schema:
      email: {{data_type: string, is_pii: True, is_primary_key: True, is_nullable: False, is_partition: False, comment: Visitor}}
      Fechaenvio: {{data_type: string, is_nullable: True, is_partition: False, comment: Time}}
  audit:
    write_mode: merge_incremental
    version: 1
    description: Audited
    owner: someone
    retention_policy: permanent
    schema:
      Email:
        rename_from: email
        validations:
          - validation: is_not_null
          - validation: is_email_format
      Fechaenvio:
        data_type: timestamp
        validations:
          - validation: is_date_format
            format: 'dd/MM/yyyy HH:mm'
  historic:
    write_mode: historic
    version: 1
    description: With history
    owner: someone
    retention_policy: permanent
    schema:
      Email: {{track_changes: True}}
      Fechaenvio: {{track_changes: True, comment: Own}}
"""


@pytest.fixture
def specs(spark, tmp_path):
    folder = tmp_path / "assets" / "domain" / "analytics"
    folder.mkdir(parents=True)
    for name in ("visits", "orders"):
        (folder / f"{name}.yml").write_text(YAML.format(name=name))
    return read_specs(spark, str(tmp_path / "assets"))


def test_rows_and_inheritance(specs):
    assert specs.count() == 12
    resolved = resolve_layers(specs.where("asset = 'visits'"))
    assert rows(resolved, "layer", "column_name", "rename_from", "data_type", "is_primary_key", "is_pii", "comment") == sorted(
        [
            ("raw", "email", None, "string", True, True, "Visitor"),
            ("raw", "Fechaenvio", None, "string", None, None, "Time"),
            ("audit", "Email", "email", "string", True, True, "Visitor"),
            ("audit", "Fechaenvio", "Fechaenvio", "timestamp", None, None, "Time"),
            ("historic", "Email", "Email", "string", True, True, "Visitor"),
            ("historic", "Fechaenvio", "Fechaenvio", "timestamp", None, None, "Own"),
        ],
        key=repr,
    )
    named = layer_attributes(resolved).select("catalog_name", "schema_name", "table_name", "etl_module", "quality").distinct()
    assert rows(named) == [
        ("domain_dev", "bronze_analytics", "raw_visits", "visits__load", "bronze"),
        ("domain_dev", "silver_analytics", "audit_visits", "visits__audit", "silver"),
        ("domain_dev", "silver_analytics", "historic_visits", "visits__hist", "silver"),
    ]


def test_registration_is_complete_and_repeatable(specs, tables):
    init_governance(tables, "analytics", "someone", "2025-01-01 00:00:00")
    assert tables.read(CATALOGS).count() == 3 and tables.read(SCHEMAS).count() == 8
    for _ in range(2):
        register_specs(tables, specs, "2025-01-01 00:00:00")
        assert rows(tables.read(TABLES), "table_id", "table_name", "schema_id") == [
            (1, "raw_orders", 3),
            (2, "audit_orders", 4),
            (3, "historic_orders", 4),
            (4, "raw_visits", 3),
            (5, "audit_visits", 4),
            (6, "historic_visits", 4),
        ]
        details = tables.read(DETAILS)
        own = sorted(details.where("table_id = 5").collect(), key=lambda r: r.ordinal_position)
        assert [(r.column_name, r.ordinal_position) for r in own] == [("Email", 1), ("Fechaenvio", 2)]
        assert {r.column_id for r in own} == {9, 10}
        assert sorted(r[0] for r in details.select("column_id").collect()) == list(range(1, 13))
    spec = fetch_spec(tables, "domain_dev.silver_analytics.audit_visits")
    assert spec.key == ["Email"] and spec.table_id == 5 and spec.write_mode == "merge_incremental"
    assert [c.data_type for c in spec.columns] == ["string", "timestamp"]
    assert spec.pattern(spec.columns[1]) == "dd/MM/yyyy HH:mm"
    assert screen_plan(spec)[0] == ("Email", "is_not_null", {})
    historic = fetch_spec(tables, "domain_dev.silver_analytics.historic_visits")
    assert historic.tracked == ["Email", "Fechaenvio"]
    with pytest.raises(ValueError, match="No registered table"):
        fetch_spec(tables, "domain_dev.silver_analytics.none")


def test_unknown_catalog_fails(specs, tables):
    init_governance(tables, "analytics", "someone", "2025-01-01 00:00:00")
    with pytest.raises(Exception, match="No catalog_id for"):
        register_specs(tables, specs, "2025-01-01 00:00:00", environment="test")


def test_comments_and_reset(tables):
    init_governance(tables, "analytics", "someone", "2025-01-01 00:00:00")
    assert tables.comments(INGESTIONS)["rundate"] == "Run that loaded the batch"
    reset(tables, ["domain_dev.bronze_analytics.raw_visits"])
    assert tables.read(INGESTIONS).isEmpty()


def test_screen_plan_of_relational_screens():
    spec = TableSpec(
        "c",
        "s",
        "t",
        (
            ColumnSpec("a", "integer", validations=({"validation": "unique", "unique_group": "g"},)),
            ColumnSpec("b", "integer", validations=({"validation": "unique", "unique_group": "g"}, {"validation": "is_not_lower_than", "reference": "a"})),
            ColumnSpec("f", validations=({"validation": "is_in_list", "schema": "s", "table": "u", "reference": "id"},)),
        ),
    )
    assert screen_plan(spec) == [
        ("b", "is_not_lower_than", {"reference": "a", "data_type": "integer"}),
        ("f", "is_in_foreign_column", {"schema": "s", "table": "u", "reference": "id"}),
        ("a,b", "is_unique", {"columns": ["a", "b"]}),
    ]
    with pytest.raises(ValueError, match="No such declared type"):
        TableSpec("c", "s", "t", (ColumnSpec("a", "money"),))


def test_every_governance_column_has_a_comment(tables):
    governance.init_governance(tables, "analytics", "someone", "2025-01-01 00:00:00")
    for name, comments in governance.COMMENTS.items():
        assert set(comments) == set(tables.read(name).columns) == set(tables.comments(name)), name


def test_specs_written_as_documents(spark, tmp_path):
    """Read back they are the same rows, numbers in screens included."""
    from tierflow.plans.spec import SPEC_SCHEMA
    from tierflow.sources.specs import read_specs, write_specs

    def spec(asset, layer, position, name, **given):
        row = {"asset": asset, "domain": "d", "subdomain": "s p", "layer": layer, "ordinal_position": position, "column_name": name, "version": 1}
        return tuple((row | given).get(c) for c in SPEC_SCHEMA.names)

    specs = spark.createDataFrame(
        [
            spec("b", "raw", 1, "z", data_type="integer", is_primary_key=True),
            spec("b", "raw", 2, "a", comment="It's: \"odd\"\nü"),
            spec("b", "audit", 1, "Z", rename_from="z", validations='[{"validation":"is_in_bounds","min_allowed":0,"max_allowed":1.5}]'),
            spec("a", "raw", 1, "only"),
        ],
        SPEC_SCHEMA,
    )
    write_specs(specs, str(tmp_path / "assets"))
    back = read_specs(spark, str(tmp_path / "assets"))
    import json

    plain = lambda df: sorted((repr({**r.asDict(), "validations": json.dumps(json.loads(r.validations or "null"), sort_keys=True)}) for r in df.collect()))
    assert plain(back) == plain(specs)
    assert sorted(p.name for p in (tmp_path / "assets").rglob("*.yml")) == ["a.yml", "b.yml"]


ODD = """
layers:
  audit: {schema: {B: {rename_from: b, comment: 'x << y & z'}, C: }, version: 2}
  other: {schema: {q: {data_type: string}}}
  historic:
name: odd
"""
ANCHORED = "name: n\nlayers: {raw: {schema: {a: &c {data_type: string}, b: *c, d: {<<: *c, comment: x}, a: {comment: last}}}}"


@pytest.mark.parametrize("text", [ODD, ANCHORED, "name: n\nlayers: {raw: {version: 1}}"])
def test_columns_read_one_by_one_are_those_of_the_whole_document(text):
    import yaml
    from tierflow.sources import specs

    document = yaml.safe_load(text)
    whole = [(l, p, n, (c or {}).get("comment"), (c or {}).get("data_type")) for l, p, n, c in specs._whole_columns(document)]
    found = list(specs.spec_rows(text, "d/s/t.yml"))
    assert [(r["layer"], r["ordinal_position"], r["column_name"], r["comment"], r["data_type"]) for r in found] == whole
    assert all((r["asset"], r["version"]) == (document["name"], document["layers"][r["layer"]].get("version")) for r in found)


def test_a_long_document_is_not_held_as_a_whole():
    import json
    import tracemalloc
    from tierflow.sources import specs

    columns = {f"c{i}": {"data_type": "string", "comment": f"no {i}"} for i in range(3000)}
    text = json.dumps({"name": "n", "layers": {"raw": {"schema": columns}}})
    tracemalloc.start()
    try:
        assert sum(1 for _ in specs.spec_rows(text, "d/s/t.yml")) == len(columns)
        assert tracemalloc.get_traced_memory()[1] < 10 * len(text)
    finally:
        tracemalloc.stop()
