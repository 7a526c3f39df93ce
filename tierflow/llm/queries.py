"""Queries over whole tables, one for each operator, and their DuckDB SQL where there is one."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tierflow.llm import (
    conversation_oracles,
    conversation_repair,
    entropy_secrets,
    greedy_tiling,
    hash_tree,
    line_frequency,
    link_graph,
    maximal_repeats,
    oracles,
    prefix_trie,
    set_relations,
    splitting_tree,
    substring_dedup,
    unigram_counts,
    vector_packing,
)

# Shards of the sharding query, and after growth by one.
SHARDS = 16
# A vocabulary file of a public tokenizer.
VOCABULARY = os.environ.get("TOKENIZER_MODEL", "/opt/tokenizers/piece_bpe_32k.model")

# A tokenizer file of a public tokenizer.
TOKENIZER = os.environ.get("TOKENIZER_JSON", "byte_bpe_50k.json")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    """The text of TOKENIZER: a path, or the name of a public file."""
    path = TOKENIZER
    if not os.path.exists(path):
        import public_tokenizers

        path = public_tokenizers.path(path)
    with open(path, encoding="utf-8") as file:
        return file.read()


TREE = hash_tree.even_tree(SHARDS)


@query("op1_hash_tree", oracles.hash_tree(TREE, hash_tree.one_more(TREE)))
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.hash_tree(table(spark, sf_dir, "documents"), TREE, hash_tree.one_more(TREE))


@query("op2_unigram_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_counts.unigram_counts(table(spark, sf_dir, "documents"), unigram_counts.Vocabulary.read(VOCABULARY))


@query("op3_substring_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


@query("op4_set_relations")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_relations.set_relations(table(spark, sf_dir, "documents"))


@query("op5_line_frequency", oracles.line_frequency())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.line_frequency(table(spark, sf_dir, "documents"))


@query("op6_maximal_repeats")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximal_repeats.suffix_dedup(table(spark, sf_dir, "documents"))


@query("op7_link_graph", oracles.link_graph())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_graph.link_graph(table(spark, sf_dir, "pages"))


@query("op8_splitting_tree", oracles.splitting_mix())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting_tree.splitting_mix(table(spark, sf_dir, "documents"))


@query("op9_greedy_tiling")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy_tiling.greedy_tiling(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_entropy_secrets", oracles.entropy_secrets())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_secrets.entropy_secrets(table(spark, sf_dir, "documents"))


@query("op11_suffix_dawg", conversation_oracles.suffix_dawg())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.suffix_dawg(table(spark, sf_dir, "conversations"))


@query("op12_vector_packing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())


@query("op13_prefix_trie", conversation_oracles.prefix_trie())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))
