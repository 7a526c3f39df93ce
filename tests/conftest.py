import pytest
from pyspark.sql import SparkSession

from tierflow.session import configure
from tierflow.sources.tables import Tables


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tierflow-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.warehouse.dir", str(base / "warehouse"))
        .config("spark.checkpoint.dir", str(base / "checkpoint"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return configure(session)


@pytest.fixture
def tables(spark, tmp_path):
    """A table store; its databases are dropped afterwards."""
    store = Tables(spark, str(tmp_path / "tables"))
    yield store
    for database in spark.sql("SHOW DATABASES").collect():
        if database[0] != "default":
            spark.sql(f"DROP DATABASE `{database[0]}` CASCADE")


def rows(df, *columns):
    """Sorted tuples of a frame, for comparing without order."""
    selected = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in selected.collect()), key=repr)
