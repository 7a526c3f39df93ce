"""The pipeline over a corpus: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage is a function of (spark, docs, sf_dir). What it returns is written as Parquet to the
shared folder and read again as the next one's `docs`, so a stage never runs twice and lost
executors cost one stage at most. When a stage begins, what the one before it wrote for itself is
deleted: its result has been written by then.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tierflow.llm import greedy_tiling, hash_tree, line_frequency, set_relations, splitting_tree
from tierflow.llm.queries import SHARDS
from tierflow.session import materialize, remove, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
# What the last stage wrote for itself.
_left: list[str] = []


def stage(function: Stage) -> Stage:
    """A stage that first deletes the intermediates of the one before."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove(spark, _left)
        before = set(written())
        try:
            return function(spark, docs, sf_dir)
        finally:
            _left[:] = [folder for folder in written() if folder not in before]

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules, without frequent lines, if enough of their words is left."""
    return line_frequency.cleaned(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return set_relations.one_of_each(docs)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that contain a benchmark item."""
    return greedy_tiling.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: a row for each time that a document is taken."""
    return splitting_tree.mixed(docs)


@stage
def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix with shard and slot of each row."""
    tree = hash_tree.even_tree(SHARDS)
    return hash_tree.sharded(docs, tree, hash_tree.one_more(tree))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

# Tiling and near duplicates are beyond SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), set()
    for name, run_stage in STAGES[:-1]:
        before = set(written())
        docs = materialize(run_stage(spark, docs, sf_dir), name)
        # The result that this stage has read; its own intermediates go when the next one begins.
        remove(spark, last)
        last = set(written()) - before - set(_left)
    return STAGES[-1][1](spark, docs, sf_dir)
