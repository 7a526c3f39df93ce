"""A small delivery of visit reports, and the specs to take it through the layers."""

from tierflow.functions.cleaning import cleaning_hook
from tierflow.plans.runs import Asset
from tierflow.plans.spec import ColumnSpec, TableSpec

PATTERN = "dd/MM/yyyy HH:mm"
HEADER = "email,jyv,Baja,Fecha envio,Opens,Links"


def write(folder, name, *lines, header=HEADER):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join([header, *lines]) + "\n", encoding="utf-8")


def asset():
    raw = TableSpec(
        "domain_dev",
        "bronze_analytics",
        "raw_visits",
        etl_module="visits__load",
        quality="bronze",
        table_id=1,
        aliases={"jk": "jyv", "fgh": "jyv"},
        columns=(
            ColumnSpec("email", is_primary_key=True, comment="Visitor"),
            ColumnSpec("jyv"),
            ColumnSpec("Baja", is_nullable=True),
            ColumnSpec("Fechaenvio"),
            ColumnSpec("Opens", "integer"),
            ColumnSpec("Links"),
        ),
    )
    audit = TableSpec(
        "domain_dev",
        "silver_analytics",
        "audit_visits",
        etl_module="visits__audit",
        write_mode="merge_incremental",
        quality="silver",
        table_id=2,
        columns=(
            ColumnSpec(
                "Email",
                rename_from="email",
                is_primary_key=True,
                validations=({"validation": "is_not_null"}, {"validation": "is_email_format"}),
                comment="Visitor",
            ),
            ColumnSpec("Jyv", rename_from="jyv"),
            ColumnSpec("Baja", validations=({"validation": "is_in_list", "allowed": "SI"},)),
            ColumnSpec(
                "FechaEnvio",
                "timestamp",
                rename_from="Fechaenvio",
                validations=({"validation": "is_date_format", "format": PATTERN},),
            ),
            ColumnSpec(
                "Opens", "integer", validations=({"validation": "is_in_bounds", "min_allowed": 0, "max_allowed": 20},)
            ),
            ColumnSpec("Links"),
        ),
    )
    historic = TableSpec(
        "domain_dev",
        "silver_analytics",
        "historic_visits",
        etl_module="visits__hist",
        write_mode="historic",
        quality="silver",
        table_id=3,
        columns=tuple(ColumnSpec(c.name, c.data_type, c.name, track_changes=True) for c in audit.columns),
    )
    return Asset(raw, audit, historic, cleaning_hook(["Links"], ["Links"]))
