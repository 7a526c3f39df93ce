"""Incremental ingestion: a file stream finds new deliveries, each micro-batch is one run step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tierflow.functions.types import record
from tierflow.plans.runs import Asset, Run, process_files
from tierflow.session import configure
from tierflow.sources.landing import with_batch

FILE_SCHEMA = record(path="string", modificationTime="timestamp", length="long", content="binary")


def file_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """New files below `path` as (path, file_name, batch_id, length); contents are not read."""
    reader = configure(spark).readStream.format("binaryFile").schema(FILE_SCHEMA)
    reader = reader.option("recursiveFileLookup", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return with_batch(reader.load(path))


def ingest_available(
    run: Run,
    asset: Asset,
    path: str,
    checkpoint: str,
    max_files: int | None = None,
    process: Callable[..., list[str]] = process_files,
) -> StreamingQuery:
    """Process all files that arrived since the last call, then stop.

    The checkpoint remembers seen files. A micro-batch that is repeated after a failure is
    harmless: each layer skips the batches it has metrics for, and its writes replace. Versions
    that a micro-batch closes stay apart from those of others, though all carry the run's id.
    """

    def step(files: DataFrame, _: int) -> None:
        if not files.isEmpty():
            process(run, asset, files)

    stream = file_stream(run.tables.spark, path, max_files)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
