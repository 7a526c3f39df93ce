"""Prefix trie of conversations by whole-sequence collapse.

A conversation is the sequence of its turns (role and text). Equal sequences are collapsed into one
with a weight and the list of conversations that end there; sequences that are a proper prefix of
another are dropped by an anti-join, and what is left are the leaves. The weighted prefixes of the
different sequences are then aggregated into nodes, each a distinct prefix, the root being the
empty one.

A prefix is identified by a chain of SHA-256 hashes over its turns, built in one pass along each
conversation; from then on no text is touched. Sums over a subtree need no descent. Of the
conversations below a node the least id owns it, and what a sequence owns is the end of its path,
from some depth on. So a sequence knows, for each of its prefixes, which words below are its own:

    sum over the subtree of (members - 1) * words
      = over the sequences below: weight * words from here on - words from here on that it owns

and in the same way how many children and leaves it brings. One aggregate by node adds these up,
with partial sums before the shuffle, so the root and other nodes that very many share are no
bottleneck. Copies of a sequence travel as its weight.

Along a conversation its turns are a sorted stream, as are the ids of an end list, whose digest is
work for one task: nothing is gathered, however long.

Rows without `conv_id` belong to no conversation. A NULL turn comes first, NULL role and text are
empty; turns with one number are ordered by role and a hash of role and text. A table without rows gives
none. Only `conv_id`, `turn`, `role` and `text` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierflow.llm.streams import dealt, record_batch, turn_order
from tierflow.llm.words import words
from tierflow.operators.skew import HOT_ROWS, lookup_join
from tierflow.session import materialize

# Rebuilding: conversations that share the first turns of one, and how many turns at most.
FAMILY, SHARED = 20, 3
ROOT = hashlib.sha256(b"").digest()
NOTHING = hashlib.sha256(b"").hexdigest()
BATCH_ROWS = 10_000

PATHS = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("depth", pa.int64()),
        ("node", pa.binary()),
        ("parent", pa.binary()),
        ("words", pa.int64()),
        ("before", pa.int64()),
        ("is_end", pa.bool_()),
    ]
)
PATH = "conv_id long, depth long, node binary, parent binary, words long, before long, is_end boolean"
ENDS = pa.schema([("node", pa.binary()), ("ends", pa.string())])


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turn_hash, words): the turns without texts, numbered from 1. Written once."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    narrow = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.unhex(F.sha2(F.encode(whole, "UTF-8"), 256)).alias("turn_hash"),
        F.size(words(text)).cast("long").alias("words"),
    )
    order = Window.partitionBy("conv_id").orderBy(*turn_order(["turn", "role", "turn_hash"]))
    out = narrow.select("conv_id", F.row_number().over(order).cast("long").alias("place"), "turn_hash", "words")
    return materialize(out, "turn-hashes")


def rebuilt(rows: DataFrame) -> DataFrame:
    """Turns of the conversations that begin with the first turns of another; place 0 marks each conversation.

    Conversation c takes the first h turns of c - c % 20 and its own after the first h, with h = crc32(c) % 4.
    """
    h = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % (SHARED + 1)
    family = rows.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"), h.alias("h"))
    # At most SHARED turns of a conversation, for at most FAMILY of them and as many with negative ids.
    heads = rows.where((F.col("place") <= SHARED) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "first")
    heads = family.join(heads, "first").where("place <= h").select("conv_id", "place", "turn_hash", "words")
    own = rows.where(F.col("place") > h).withColumn("place", F.col("place") + SHARED)
    marks = family.select("conv_id", F.lit(0).cast("long").alias("place"))
    return heads.unionByName(own).unionByName(marks, allowMissingColumns=True)


def marked(rows: DataFrame) -> DataFrame:
    """Turns with the mark (place 0) that each conversation begins with."""
    marks = rows.select("conv_id").distinct().withColumn("place", F.lit(0).cast("long"))
    return rows.unionByName(marks, allowMissingColumns=True)


def along(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefixes of each conversation, from its turns in order behind its mark."""
    out, last = [], None
    for batch in batches:
        for conv, place, turn_hash, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if place == 0:
                if last is not None:
                    out.append((*last, True))
                last = (conv, 0, ROOT, None, 0, 0)
                continue
            out.append((*last, False))
            _, depth, node, _, n_last, before = last
            last = (conv, depth + 1, hashlib.sha256(node + turn_hash).digest(), node, n, before + n_last)
        if len(out) > BATCH_ROWS:
            yield record_batch(out, PATHS)
            out = []
    if last is not None:
        out.append((*last, True))
    yield record_batch(out, PATHS)


def paths(rows: DataFrame) -> DataFrame:
    """PATH: each prefix of each conversation; `before` are the words before its last turn. Written once."""
    stream = dealt(rows, "conv_id", "place").select("conv_id", "place", "turn_hash", "words")
    return materialize(stream.mapInArrow(along, PATH), "conversation-paths")


def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of the ids of each end node, from (node, conv_id) in order."""
    out, last, digest = [], None, None
    for batch in batches:
        for node, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if node == last:
                digest.update(b",")
            else:
                if last is not None:
                    out.append((last, digest.hexdigest()))
                last, digest = node, hashlib.sha256()
            digest.update(str(conv).encode())
        if len(out) > BATCH_ROWS:
            yield record_batch(out, ENDS)
            out = []
    if last is not None:
        out.append((last, digest.hexdigest()))
    yield record_batch(out, ENDS)


def collapsed(every: DataFrame) -> DataFrame:
    """(seq, node, depth, total, weight): a row for each different sequence; `seq` is its least conversation.

    `node` is where the sequence ends, `total` its words. The end lists are the conversations by `node`.
    """
    ends = every.where("is_end")
    total = F.first(F.col("before") + F.col("words")).alias("total")
    out = ends.groupBy("node").agg(F.min("conv_id").alias("seq"), F.first("depth").alias("depth"), total, F.count("*").alias("weight"))
    return materialize(out, "sequences")


def leaves(sequences: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The sequences that are no proper prefix of another."""
    inner = prefixes.where("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct()
    return sequences.join(inner, "node", "left_anti")


def trie(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The nodes of a trie; `rows` holds (conv_id, place, turn_hash, words) and a place 0 for each conversation.

    Per node: conv_id (its least member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, and ends_sha256 of the conversations that end there.
    """
    every = paths(rows)
    sequences = collapsed(every)
    own = sequences.select(F.col("seq").alias("conv_id"), F.lit(True).alias("_own"))
    # The paths of the different sequences, each once.
    prefixes = lookup_join(every, own, ["conv_id"], "inner", hot_rows).drop("_own").withColumnRenamed("conv_id", "seq")
    prefixes = materialize(prefixes, "weighted-prefixes")
    # Owners: from which depth on a sequence is the least below its nodes, and who owns the node above that.
    of_node = [F.first(c).alias(c) for c in ("depth", "parent", "before")]
    owners = materialize(prefixes.groupBy("node").agg(F.min("seq").alias("seq"), *of_node), "node-owners")
    begins = owners.groupBy("seq").agg(F.min(F.struct("depth", "parent", "before")).alias("top"))
    begins = begins.select("seq", F.col("top.depth").alias("begin"), F.col("top.parent").alias("parent"), F.col("top.before").alias("unowned"))
    above = owners.select(F.col("node").alias("parent"), F.col("seq").alias("above"))
    begins = lookup_join(begins, above, ["parent"], "left", hot_rows).drop("parent")
    tips = leaves(sequences, prefixes).select("seq", F.lit(1).cast("long").alias("leaf"))
    lists = dealt(every.where("is_end").select("node", "conv_id"), "node", "conv_id").mapInArrow(listed, "node binary, ends string")
    heads = sequences.withColumnRenamed("depth", "length").join(begins, "seq", "left").join(tips, "seq", "left")
    heads = materialize(heads.join(lists, "node").drop("node"), "sequence-heads")
    return nodes(lookup_join(prefixes, heads, ["seq"], "inner", hot_rows))


def nodes(prefixes: DataFrame) -> DataFrame:
    """What the prefixes of all sequences bring to their nodes, added up."""
    from_here = F.col("total") - F.col("before")
    owned = F.when(F.col("depth") >= F.col("begin"), from_here).otherwise(F.col("total") - F.col("unowned"))
    child = (F.col("depth") < F.col("length")) & (F.col("depth") + 1 >= F.col("begin"))
    # Only the owner knows the parent's: itself, or who owns the node above its own.
    parent = F.when(F.col("depth") > F.col("begin"), F.col("seq")).when(F.col("depth") == F.col("begin"), F.col("above"))
    out = prefixes.groupBy("node").agg(
        F.min("seq").alias("conv_id"),
        F.first("depth").alias("depth"),
        F.max(parent).alias("parent_conv_id"),
        F.sum("weight").alias("n_convs"),
        F.sum(F.when(child, 1).otherwise(0)).cast("long").alias("n_children"),
        F.coalesce(F.sum("leaf"), F.lit(0)).cast("long").alias("n_leaves"),
        # A sequence whose nodes all belong to others owns nothing.
        F.sum(F.col("weight") * from_here - F.coalesce(owned, F.lit(0))).cast("long").alias("saved_tokens"),
        F.coalesce(F.max(F.when(F.col("depth") == F.col("length"), F.col("ends"))), F.lit(NOTHING)).alias("ends_sha256"),
    )
    return out.drop("node")


def conversation_trie(conversations: DataFrame, **options) -> DataFrame:
    """The trie of the conversations as they are."""
    return trie(marked(turns(conversations)), **options)


def prefix_trie(conversations: DataFrame, **options) -> DataFrame:
    """The trie of the conversations, each rebuilt with the first turns of another."""
    return trie(rebuilt(turns(conversations)), **options)
