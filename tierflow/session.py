"""Session settings the library relies on, and the shared folder for written intermediates."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

# Runtime settings only: sizing (executors, memory, shuffle partitions) belongs to the cluster.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator expects (UTC, AQE, partition handling)."""
    for name, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the checkpoint folder that the cluster names.

    Only a local master may fall back to a folder of its own: on a cluster a machine-local
    folder would be lost with the machine, so an unset setting is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = tempfile.mkdtemp(prefix="tierflow-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir() or base
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


# Intermediates that are written and not yet removed, by the path of their folder.
_written: list[str] = []


def written() -> list[str]:
    """The folders of the intermediates that this process has written and not removed."""
    return list(_written)


def remove(spark: SparkSession, folders: Iterable[str]) -> None:
    """Delete intermediates that nothing reads any more, wherever they lie."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for folder in folders:
        path = hadoop.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if folder in _written:
            _written.remove(folder)


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate to the shared folder and go on from there.

    For frames that a plan reads several times: the work is done once, the lineage ends, and a
    lost executor costs a re-read instead of a recomputation.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
