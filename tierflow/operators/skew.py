"""Joins and groups that stay balanced when one key holds a large share of the rows.

A join that shuffles by key sends all rows of a key to one task. `hot_keys` counts the rows of
each key (one row per key and task crosses the network) and writes down the keys too large for
that; `lookup_join` deals their rows over several parts by a salt and repeats their lookup row once
per part, in the one join that serves all keys. Rows are read once, whatever the number of hot
keys, which has no limit. (Spark's own skew handling does not apply where one side is an aggregate
by the join key, which is the usual case here.)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierflow.session import materialize

# A key with this many rows is too much for one task of a shuffled join or window.
HOT_ROWS = 10_000_000
# A side that is sent to every task as a whole has at most this many rows and bytes (as JSON).
SMALL_ROWS = 100_000
SMALL_BYTES = 32 * 1024 * 1024
# Slots that keys are counted in, by hash, before the keys of a full slot are counted one by one.
SLOTS = 16384


def is_small(df: DataFrame, small_rows: int = SMALL_ROWS) -> bool:
    """Whether a frame may be sent to every task; measured by one aggregate over it."""
    width = F.octet_length(F.to_json(F.struct(*df.columns)))
    n_rows, n_bytes = df.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return n_rows <= small_rows and n_bytes <= SMALL_BYTES


def key_hash(keys: Sequence[str]) -> Column:
    """64-bit hash of a key; never NULL, so NULL keys are found and split like any other."""
    return F.xxhash64(*[F.col(k) for k in keys])


def sent(df: DataFrame, small_rows: int = SMALL_ROWS) -> DataFrame:
    """A written frame, marked to go to every task if it measures small."""
    return F.broadcast(df) if is_small(df, small_rows) else df


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """(_h, _parts): keys by hash with at least `hot_rows` rows, and the parts their rows are dealt over.

    Counts rows by a slot of the key's hash first: only the keys of a slot with `hot_rows` rows are
    counted one by one, so the keys of a table without a hot one do not cross the network. None if no
    key is hot.
    """
    hashes = df.select(key_hash(keys).alias("_h")).withColumn("_slot", F.pmod("_h", F.lit(SLOTS)))
    full = hashes.groupBy("_slot").agg(F.count("*").alias("_n")).where(F.col("_n") >= hot_rows).select("_slot")
    slots = [r[0] for r in full.collect()]
    if not slots:
        return None
    counts = hashes.where(F.col("_slot").isin(slots)).groupBy("_h").agg(F.count("*").alias("_n"))
    parts = F.ceil(F.col("_n") / hot_rows).cast("long") + 1
    found = materialize(counts.where(F.col("_n") >= hot_rows).select("_h", parts.alias("_parts")), "hot-keys")
    return None if found.isEmpty() else found


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    like: DataFrame | None = None,
    small_rows: int | None = None,
) -> DataFrame:
    """Join `rows` to a lookup that holds each key at most once, whatever the spread of keys.

    With `small_rows`, a lookup that measures small goes to every task and nothing shuffles.
    Otherwise one join by key and salt serves all rows; only hot keys (or a frequent NULL) have
    more than one salt.

    Hot keys are looked for in `like` if given: a frame with the same keys that is cheaper to
    scan than `rows`.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"Unsupported join for a lookup: {how}")
    keys = list(keys)
    if small_rows is not None and is_small(lookup, small_rows):
        return rows.join(F.broadcast(lookup), keys, how)
    found = hot_keys(rows if like is None else like, keys, hot_rows)
    return rows.join(lookup, keys, how) if found is None else salted_join(rows, lookup, keys, how, found)


def salted_join(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str, found: DataFrame) -> DataFrame:
    """`lookup_join` with the hot keys that `hot_keys` found: their rows dealt over salts."""
    hot = sent(found)
    parts = F.coalesce("_parts", F.lit(1).cast("long"))
    salted = rows.withColumn("_h", key_hash(keys)).join(hot, "_h", "left")
    salted = salted.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), parts)).drop("_h", "_parts")
    again = sent(found.select(F.col("_h").alias("_of"), F.col("_parts").alias("_times")))
    times = F.coalesce("_times", F.lit(1).cast("long"))
    repeated = lookup.join(again, key_hash(keys) == F.col("_of"), "left")
    repeated = repeated.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), times - 1))).drop("_of", "_times")
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def semi_join(
    rows: DataFrame, members: DataFrame, key: str, small_rows: int = SMALL_ROWS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Rows whose key is in a list. A short list also lets Spark skip partitions it rules out."""
    return lookup_join(rows, members.select(key).distinct(), [key], "left_semi", hot_rows, small_rows=small_rows)


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with no NULL part. Counts combine before the shuffle."""
    complete = df.dropna(subset=list(keys))
    return complete.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
