"""Sharding by a hierarchical weighted hash tree.

Shards stand in racks and racks in regions. Every node draws `-ln(u) / weight`, with `u` from the
hash of the key and the node's place and `weight` the sum of the shards below it. A key descends: to
the region with the least draw, there to the rack with the least draw, there to the shard. Only the
children of the nodes on the way are drawn, so the cost of a key is depth times fan-out.

A draw depends on the key, the node and its weight only. Where weights change below a node, draws
change on the path to it and nowhere else: rows move into a heavier subtree or out of a lighter one,
and no row moves between other subtrees.

What a tree gains later is a generation of its own (`added`): the root draws for each region of each
generation, by the weight that it had or gained then. A generation's draws never change, so growth
moves rows into the added shards only, wherever they stand.

Slots number the rows of a shard without gaps. They come from the counts of sub-buckets of each
shard, so no task sees a whole shard; sub-buckets follow the number of rows.

NULL `doc_id` is a key of its own, NULL text has no bytes. Equal rows get slots of their own, in
blocks, however many they are. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierflow.llm.words import aside, back
from tierflow.session import materialize

# Rows that one task numbers, and equal rows that one task writes out.
SLOT_ROWS = 50_000
COPY_ROWS = 10_000
# Hexadecimal digits of a draw: 52 bits, exact in a double.
DIGITS = 13


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    number: int
    weight: float = 1.0
    generation: int = 0


# What tells the children of a node apart, from the root downwards.
LEVELS = (("generation", "region"), ("rack",), ("number",))


def even_tree(shards: int, per_rack: int = 4, per_region: int = 8) -> list[Shard]:
    """Equal shards, filled into racks and regions in order."""
    return [Shard(i // per_region, i // per_rack, i) for i in range(shards)]


def added(shards: Sequence[Shard], more: Sequence[Shard]) -> list[Shard]:
    """The tree with more shards, or more weight of its shards, as its next generation."""
    last = max((s.generation for s in shards), default=-1)
    return [*shards, *(replace(s, generation=last + 1) for s in more)]


def one_more(shards: Sequence[Shard], per_rack: int = 4, per_region: int = 8) -> list[Shard]:
    """An even tree with its next shard."""
    n = len(shards)
    return added(shards, [Shard(n // per_region, n // per_rack, n)])


@dataclass(frozen=True)
class Node:
    label: str
    shards: tuple[Shard, ...]

    @property
    def weight(self) -> float:
        return float(sum(s.weight for s in self.shards))

    def children(self, depth: int) -> list[Node]:
        groups: dict[tuple, list[Shard]] = {}
        for shard in self.shards:
            groups.setdefault(tuple(getattr(shard, f) for f in LEVELS[depth]), []).append(shard)
        return [Node(".".join([self.label, *map(str, k)]), tuple(group)) for k, group in groups.items()]


def draw(key: Column, node: Node) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{node.label}"))), 1, DIGITS)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(16**DIGITS))
    return -F.ln(u) / F.lit(node.weight)


def least(key: Column, children: Sequence[tuple[int, Node]]) -> Column:
    """The number of the child with the least draw, the first one at a tie."""
    if len(children) == 1:
        return F.lit(children[0][0])
    draws = [F.struct(draw(key, node), F.lit(i), F.lit(number).alias("number")) for i, (number, node) in enumerate(children)]
    return F.array_min(F.array(*draws))["number"]


def place(rows: DataFrame, key: Column, trees: dict[str, Sequence[Shard]]) -> DataFrame:
    """Add a column per tree: the shard of each row. One column per level, so no draw is made twice."""
    for shards in trees.values():
        if any(s.weight <= 0 for s in shards) or len({(s.number, s.generation) for s in shards}) < len(shards):
            raise ValueError("Shards need a positive weight and a number of their own")
    for name, shards in trees.items():
        nodes, at = [Node("", tuple(shards))], None
        for depth in range(len(LEVELS)):
            below: list[Node] = []
            chosen = None if at is None else F.when(F.lit(False), F.lit(None).cast("int"))
            for i, node in enumerate(nodes):
                inner = node.children(depth)
                last = depth == len(LEVELS) - 1
                numbers = [c.shards[0].number if last else len(below) + k for k, c in enumerate(inner)]
                below += inner
                value = least(key, list(zip(numbers, inner, strict=True)))
                chosen = value if chosen is None else chosen.when(F.col(at) == i, value)
            nodes, at = below, f"_{name}_{depth}"
            rows = rows.withColumn(at, chosen)
        rows = rows.withColumnRenamed(at, name).drop(*[f"_{name}_{d}" for d in range(len(LEVELS) - 1)])
    return rows


def numbered(rows: DataFrame, group: str, by: Sequence[str], n_rows: int, groups: int, slot: str = "slot") -> DataFrame:
    """Number the rows of each group from 0 without gaps, in sub-buckets."""
    buckets = max(1, -(-n_rows // (groups * SLOT_ROWS)))
    text = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by])
    bucket = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % buckets
    others = [c for c in rows.columns if c not in (group, *by)]
    # Equal rows travel as one row with a count.
    merged = rows.withColumn("_bucket", bucket).groupBy(group, "_bucket", *by, *others).agg(F.count("*").alias("_n"))
    sizes = rows.withColumn("_bucket", bucket).groupBy(group, "_bucket").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(group, "_bucket").orderBy(*by, *others).rowsBetween(Window.unboundedPreceding, -1)
    placed = merged.join(offsets, [group, "_bucket"]).withColumn(
        "_first", F.col("_offset") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    )
    blocks = placed.withColumn("_block", F.explode(F.expr(f"sequence(0L, (_n - 1) div {COPY_ROWS})")))
    last = f"least(_n, (_block + 1) * {COPY_ROWS}) - 1"
    copies = blocks.withColumn("_copy", F.explode(F.expr(f"sequence(_block * {COPY_ROWS}, {last})")))
    return copies.select(*rows.columns, (F.col("_first") + F.col("_copy")).alias(slot))


def hash_tree(docs: DataFrame, shards: Sequence[Shard], grown: Sequence[Shard] | None = None) -> DataFrame:
    """Per row: doc_id, size (UTF-8 bytes and 1), text_crc32, law, shard, slot and grown_shard.

    `grown` is the tree after growth; `grown_shard` tells where each row is then.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    trees = {"shard": shards} | ({"grown_shard": grown} if grown else {})
    rows = place(rows, key, trees)
    if not grown:
        rows = rows.withColumn("grown_shard", F.lit(None).cast("int"))
    rows = materialize(rows, "sharding")
    out = numbered(rows, "shard", ["doc_id", "size", "text_crc32"], rows.count(), len(shards))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def sharded(docs: DataFrame, shards: Sequence[Shard], grown: Sequence[Shard] | None = None) -> DataFrame:
    """The documents with their shard: the columns of `hash_tree`, then those of `docs`.

    Of `docs`, a column with the name of one of the former is called `document_<name>`. Texts move once,
    to the sub-bucket that numbers them; equal rows travel as one with a count.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        *aside(docs),
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = place(rows, key, {"shard": shards} | ({"grown_shard": grown} if grown else {}))
    if not grown:
        rows = rows.withColumn("grown_shard", F.lit(None).cast("int"))
    out = numbered(rows, "shard", ["doc_id", "size", "text_crc32"], docs.count(), len(shards))
    own = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    given = back(out, [f"document_{c}" if c in own else c for c in docs.columns])
    return out.select("doc_id", *own[:2], F.lit("key").alias("law"), *own[3:], *[c for c, name in zip(given, docs.columns, strict=True) if name != "doc_id"])
