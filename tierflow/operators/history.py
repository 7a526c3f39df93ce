"""Change history (type 2): every version of a key's tracked columns with its validity period.

At any time a key has at most one current version; its versions are contiguous and do not
overlap. Values are compared null-safe, column by column.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierflow.operators.skew import HOT_ROWS, SMALL_ROWS, hot_keys, key_hash, lookup_join, sent
from tierflow.session import materialize
from tierflow.plans.spec import OPEN_END

VALIDITY = ["is_current", "valid_from", "valid_to"]
STATE = "_state"


def open_end() -> Column:
    return F.lit(OPEN_END).cast("timestamp")


def _state(tracked: Sequence[str]) -> Column:
    return F.struct(*tracked) if tracked else F.struct(F.lit(True).alias("present"))


def _names(key: Sequence[str], tracked: Sequence[str]) -> tuple[list[str], list[str]]:
    """Key columns may be listed as tracked as well; they cannot change within a key."""
    return list(key), [c for c in tracked if c not in key]


def _dated(rows: DataFrame, version_ts: str) -> DataFrame:
    """`rows`, failing the job that reads one without a time."""
    dateless = F.raise_error(F.lit(f"Row without a version time in {version_ts}")).cast("boolean")
    return rows.where(F.when(F.col(version_ts).isNull(), dateless).otherwise(F.lit(True)))


def _finish(starts: DataFrame, key: Sequence[str], version_ts: str, next_ts: Column, tracked: Sequence[str]) -> DataFrame:
    return starts.select(
        *key,
        *[F.col(f"{STATE}.{c}").alias(c) for c in tracked],
        next_ts.isNull().alias("is_current"),
        F.col(version_ts).cast("timestamp").alias("valid_from"),
        F.coalesce(next_ts.cast("timestamp"), open_end()).alias("valid_to"),
    )


def _rebuild_shuffled(
    changes: DataFrame, key: Sequence[str], tracked: Sequence[str], version_ts: str, tie: Sequence[str]
) -> DataFrame:
    """One exchange and one sort: last row per time, then changed rows, then the next start."""
    by_key = Window.partitionBy(*key).orderBy(version_ts)
    by_tie = Window.partitionBy(*key).orderBy(version_ts, *tie)
    last_of_time = (
        changes.select(*key, version_ts, *tie, _state(tracked).alias(STATE))
        .withColumn("_next", F.lead(version_ts).over(by_tie))
        .where(F.col("_next").isNull() | (F.col("_next") != F.col(version_ts)))
    )
    starts = (
        last_of_time.withColumn("_previous", F.lag(F.struct(STATE)).over(by_tie))
        .where(F.col("_previous").isNull() | ~F.col(f"_previous.{STATE}").eqNullSafe(F.col(STATE)))
        .select(*key, version_ts, STATE)
    )
    ended = starts.withColumn("_next", F.lead(version_ts).over(by_key))
    return _finish(ended, key, version_ts, F.col("_next"), tracked)


def _time_cuts(changes: DataFrame, hot: DataFrame, key: Sequence[str], version_ts: str, most: int) -> DataFrame:
    """(_h, _cuts): the borders between the time slices of each hot key.

    A key has as many slices as `hot` gives it parts, so a slice stays near the size that makes a
    key hot, however many rows the key has. All keys share one grid of quantiles, twice as fine as
    the longest of them asks for, and each takes the points of it that its own number needs.
    Written out, because slices must be the same wherever the plan reads them.
    """
    grid = 2 * most
    shares = F.lit([i / grid for i in range(1, grid)])
    micros = F.unix_micros(F.col(version_ts).cast("timestamp"))
    points = changes.groupBy(key_hash(key).alias("_h")).agg(F.percentile_approx(micros, shares, 10 * grid).alias("_points"))
    numbers = F.sequence(F.lit(1).cast("long"), F.col("_parts") - 1)
    cuts = F.transform(numbers, lambda i: F.get("_points", F.floor(i * grid / F.col("_parts")).cast("int") - 1).cast("long"))
    return materialize(points.join(sent(hot), "_h").select("_h", cuts.alias("_cuts")), "time-cuts")


def _slice_of(micros: Column, most: int) -> Column:
    """Number of cuts up to a time, by halving."""
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(most.bit_length()))])
    return F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get("_cuts", at + step - 1) <= micros, at + step).otherwise(at)
    )


def _rebuild_sliced(
    changes: DataFrame, hot: DataFrame, key: Sequence[str], tracked: Sequence[str], version_ts: str, tie: Sequence[str]
) -> DataFrame:
    """Histories of hot keys: versions within time slices, then stitched at the slice borders."""
    key = list(key)
    most = hot.agg(F.max("_parts")).first()[0]
    cuts = _time_cuts(changes, hot, key, version_ts, most)
    micros = F.unix_micros(F.col(version_ts).cast("timestamp"))
    # One row per key and time, combined before the shuffle.
    one_per_time = changes.groupBy(*key, version_ts).agg(F.max_by(_state(tracked), F.struct(*tie)).alias(STATE))
    sliced = (
        one_per_time.withColumn("_h", key_hash(key))
        .join(sent(cuts), "_h")
        .withColumn("_slice", _slice_of(micros, most))
        .select(*key, "_slice", version_ts, STATE)
    )
    in_slice = Window.partitionBy(*key, "_slice").orderBy(version_ts)
    starts = (
        sliced.withColumn("_previous", F.lag(F.struct(STATE)).over(in_slice))
        .withColumn("_first", F.col("_previous").isNull())
        .where(F.col("_first") | ~F.col(f"_previous.{STATE}").eqNullSafe(F.col(STATE)))
        .drop("_previous")
        .withColumn("_next", F.lead(version_ts).over(in_slice))
    )
    # One row per hot key and slice from here on.
    borders = starts.groupBy(*key, "_slice").agg(
        F.min_by(STATE, version_ts).alias("_entry"),
        F.max_by(STATE, version_ts).alias("_exit"),
        F.min(version_ts).alias("_begin"),
        F.min(F.when(~F.col("_first"), F.col(version_ts))).alias("_second"),
    )
    by_slice = Window.partitionBy(*key).orderBy("_slice")
    stitched = (
        borders.withColumn("_before", F.lag(F.struct("_exit")).over(by_slice))
        .withColumn("_opens", F.col("_before").isNull() | ~F.col("_before._exit").eqNullSafe(F.col("_entry")))
        .withColumn("_start", F.when(F.col("_opens"), F.col("_begin")).otherwise(F.col("_second")))
        .withColumn("_later", F.min("_start").over(by_slice.rowsBetween(1, Window.unboundedFollowing)))
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_slice").alias("_s"), "_opens", "_later")
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)] + [F.col("_slice") == F.col("_s")]
    kept = starts.join(sent(materialize(stitched, "stitched-slices")), same).where(~F.col("_first") | F.col("_opens"))
    return _finish(kept, key, version_ts, F.coalesce("_next", "_later"), tracked)


def scd2_rebuild(
    changes: DataFrame,
    key: Sequence[str],
    tracked: Sequence[str],
    version_ts: str,
    tie: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The whole history from all delivered rows, in order of `version_ts`, not of arrival.

    Of several rows with one key and time the highest by `tie` counts, then by the tracked values. A
    row equal to the one before it opens no version. Keys with `hot_rows` rows and more are built
    slice by slice in time, with about that many rows a slice, all others in one window.
    """
    key, tracked = _names(key, tracked)
    # The tracked values come last: whatever `tie` leaves open must not depend on the order of input.
    tie = list(dict.fromkeys([*tie, *(tracked or key)]))
    changes = _dated(changes, version_ts)
    hot = hot_keys(changes, key, hot_rows)
    if hot is None:
        return _rebuild_shuffled(changes, key, tracked, version_ts, tie)
    listed = sent(hot.select("_h"))
    by_hash = changes.withColumn("_h", key_hash(key))
    few, many = by_hash.join(listed, "_h", "left_anti").drop("_h"), by_hash.join(listed, "_h", "left_semi").drop("_h")
    return _rebuild_shuffled(few, key, tracked, version_ts, tie).unionByName(
        _rebuild_sliced(many, hot, key, tracked, version_ts, tie)
    )


def _around_late(rows: DataFrame, key: Sequence[str], hot_rows: int) -> DataFrame:
    """Of the rows of some keys, one per time: the late ones and those that follow one.

    Keys with `hot_rows` rows and more are cut into time slices. The first row of a slice stays
    too, in place of a look into the slice before: a row that changes nothing opens no version.
    """
    hot = hot_keys(rows, key, hot_rows)
    one_per_time = rows.groupBy(*key, "_at").agg(F.max_by(STATE, "_order").alias(STATE), F.max("_late").alias("_late"))
    if hot is None:
        sliced = one_per_time.withColumn("_slice", F.lit(0))
    else:
        most = hot.agg(F.max("_parts")).first()[0]
        many = rows.withColumn("_h", key_hash(key)).join(sent(hot.select("_h")), "_h", "left_semi").drop("_h")
        cuts = sent(_time_cuts(many, hot, key, "_at", most))
        number = F.coalesce(_slice_of(F.unix_micros("_at"), most), F.lit(0))
        sliced = one_per_time.withColumn("_h", key_hash(key)).join(cuts, "_h", "left").withColumn("_slice", number)
    in_slice = Window.partitionBy(*key, "_slice").orderBy("_at")
    follows = F.coalesce(F.lag("_late").over(in_slice), F.col("_slice") > 0)
    return sliced.withColumn("_needed", F.col("_late") | follows).where("_needed").select(*key, "_at", STATE)


def split_versions(
    history: DataFrame,
    late: DataFrame,
    delivered: DataFrame,
    key: Sequence[str],
    tracked: Sequence[str],
    version_ts: str,
    tie: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows that arrive late, put between the versions they fall into: (kept, replaced, built) versions.

    `built` takes the place of `replaced`, which are the versions of the late keys that end at their
    first late time or after it; `kept` and `replaced` have all columns of `history`. A late row
    splits the version that holds its time. Its own lasts until the key's next delivered row, even
    one that changed nothing when it came: therefore `delivered` gives the rows of all earlier
    deliveries, of which only those of late keys since their first late time are looked at. Of
    several rows with one key and time the highest by `tie` counts, then by the tracked values.
    Closings without a successor stay where they are; a late row after one opens a version.
    """
    key, tracked = _names(key, tracked)
    types = dict(history.dtypes)
    tie = list(dict.fromkeys([*tie, *(tracked or key)]))

    def shaped(rows: DataFrame, is_late: bool) -> DataFrame:
        typed = {c: F.col(c).cast(types[c]) for c in [*key, *tracked]}
        order = F.struct(*[typed.get(c, F.col(c)).alias(f"_o{i}") for i, c in enumerate(tie)])
        state = F.struct(*[typed[c].alias(c) for c in tracked]) if tracked else _state(tracked)
        return _dated(rows, version_ts).select(
            *[typed[k].alias(k) for k in key],
            F.col(version_ts).cast("timestamp").alias("_at"),
            state.alias(STATE),
            order.alias("_order"),
            F.lit(is_late).alias("_late"),
        )

    # Keys go by their 64-bit hash here: a key that shares one is looked at in vain, and stays as it is.
    new = shaped(late, True)
    since = materialize(new.groupBy(key_hash(key).alias("_key")).agg(F.min("_at").alias("_since")), "late-keys")
    first = since.agg(F.min("_since")).first()[0]
    old = shaped(delivered, False).where(F.col("_at") >= F.lit(first).cast("timestamp")).withColumn("_key", key_hash(key))
    old = lookup_join(old, since, ["_key"], "inner", hot_rows, small_rows=SMALL_ROWS).where("_at >= _since")
    rows = materialize(old.drop("_key", "_since").unionByName(new), "late-rows")
    points = _around_late(rows, key, hot_rows).withColumn("_rank", F.lit(2)).withColumn("_gone", F.lit(False))

    known = lookup_join(history.withColumn("_key", key_hash(key)), since, ["_key"], "left", hot_rows, small_rows=SMALL_ROWS)
    late_key = F.col("_since").isNotNull() & (F.col("is_current") | (F.col("valid_to") >= F.col("_since")))
    kept = known.where(~late_key).select(*history.columns)
    replaced = known.where(late_key).select(*history.columns)
    # What begins at a time counts more than what ends there, and delivered rows more than both.
    begin = F.struct(F.col("valid_from").alias("_at"), F.lit(1).alias("_rank"), F.lit(False).alias("_gone"))
    end = F.struct(F.col("valid_to").alias("_at"), F.lit(0).alias("_rank"), F.lit(True).alias("_gone"))
    borders = F.when(F.col("is_current"), F.array(begin)).otherwise(F.array(begin, end))
    borders = replaced.select(*key, _state(tracked).alias(STATE), F.explode(borders).alias("_b")).select(*key, STATE, "_b.*")
    states = [F.col(f"{STATE}.{c}").alias(c) for c in tracked]
    events = borders.unionByName(points).select(*key, *states, "_at", "_rank", "_gone")
    built = scd2_rebuild(events, key, [*tracked, "_gone"], "_at", ["_rank"], hot_rows)
    return kept, replaced, built.where(~F.col("_gone")).select(*key, *tracked, *VALIDITY)


def scd2_insert(
    history: DataFrame,
    late: DataFrame,
    delivered: DataFrame,
    key: Sequence[str],
    tracked: Sequence[str],
    version_ts: str,
    tie: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """`history` with late rows put where their times belong: the rebuild of `delivered` and `late`.

    Versions of other keys, and those that ended before a key's first late row, stay as they are.
    See `split_versions`.
    """
    key, tracked = _names(key, tracked)
    kept, _, built = split_versions(history, late, delivered, key, tracked, version_ts, tie, hot_rows)
    return kept.select(*key, *tracked, *VALIDITY).unionByName(built)


def _compared(
    current: DataFrame,
    snapshot: DataFrame,
    key: Sequence[str],
    tracked: Sequence[str],
    order: Sequence[str],
    deletes: bool,
) -> DataFrame:
    """(key, _old, _new, action): the current version and the latest snapshot row per key.

    Both inputs go into one aggregate by key instead of a join: a single exchange, to which each
    task sends one row per key however often the snapshot repeats it, and NULL keys compare
    equal. The latest row is the highest by `order`, then by the tracked values.
    """
    old = current.select(*key, *tracked, "valid_from", F.lit(False).alias("_given"))
    new = snapshot.select(
        *key, *tracked, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.lit(True).alias("_given")
    )
    state = _state(tracked).alias(STATE)
    newest = F.struct(*[f"_o{i}" for i in range(len(order))], state)
    action = (
        F.when(F.col("_new").isNull(), F.lit("DELETE" if deletes else "NO_ACTION"))
        .when(F.col("_old").isNull(), F.lit("INSERT"))
        .when(F.col(f"_old.{STATE}").eqNullSafe(F.col(f"_new.{STATE}")), F.lit("NO_ACTION"))
        .otherwise(F.lit("UPDATE"))
    )
    return (
        old.unionByName(new, allowMissingColumns=True)
        .groupBy(*key)
        .agg(
            F.max(F.when(~F.col("_given"), F.struct("valid_from", state))).alias("_old"),
            F.max(F.when(F.col("_given"), newest)).alias("_new"),
        )
        .withColumn("action", action)
    )


def scd2_changes(
    current: DataFrame,
    snapshot: DataFrame,
    key: Sequence[str],
    tracked: Sequence[str],
    now: datetime | str,
    order: Sequence[str] = (),
    deletes: bool = True,
) -> DataFrame:
    """The versions that follow from the current ones and a snapshot: still open or just closed.

    Versions closed earlier are not needed and not touched. Each key gives one or two rows.
    """
    key, tracked = _names(key, tracked)
    at = F.lit(now).cast("timestamp")
    compared = _compared(current, snapshot, key, tracked, order, deletes)

    def version(state: str, is_current: bool, valid_from: Column, valid_to: Column) -> Column:
        return F.struct(
            F.col(f"{state}.{STATE}").alias(STATE),
            F.lit(is_current).alias("is_current"),
            valid_from.alias("valid_from"),
            valid_to.alias("valid_to"),
        )

    kept = version("_old", True, F.col("_old.valid_from"), open_end())
    closed = version("_old", False, F.col("_old.valid_from"), at)
    opened = version("_new", True, at, open_end())
    versions = (
        F.when(F.col("action") == "NO_ACTION", F.array(kept))
        .when(F.col("action") == "INSERT", F.array(opened))
        .when(F.col("action") == "DELETE", F.array(closed))
        .otherwise(F.array(closed, opened))
    )
    return compared.select(*key, F.explode(versions).alias("v")).select(
        *key, *[F.col(f"v.{STATE}.{c}").alias(c) for c in tracked], *[F.col(f"v.{c}") for c in VALIDITY]
    )


def close_absent(versions: DataFrame, present: DataFrame, key: Sequence[str], now: datetime | str) -> DataFrame:
    """`versions` with the current ones closed whose key is not among `present` (distinct keys)."""
    names = [f"_k{i}" for i in range(len(key))]
    listed = present.select(*[F.col(k).alias(n) for k, n in zip(key, names, strict=True)]).withColumn("_present", F.lit(True))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(key, names, strict=True)]
    gone = F.col("is_current") & F.col("_present").isNull()
    joined = versions.join(listed, same, "left")
    return joined.withColumns(
        {
            "valid_to": F.when(gone, F.lit(now).cast("timestamp")).otherwise(F.col("valid_to")),
            "is_current": F.col("is_current") & ~gone,
        }
    ).select(*versions.columns)


def scd2_apply(
    history: DataFrame,
    snapshot: DataFrame,
    key: Sequence[str],
    tracked: Sequence[str],
    now: datetime | str,
    order: Sequence[str] = (),
    deletes: bool = True,
) -> DataFrame:
    """`history` after comparing its current versions with a snapshot of all valid rows.

    New keys open a version, changed ones close theirs at `now` and open another, keys missing
    from the snapshot close theirs (unless `deletes` is off). Closed versions always stay.
    """
    key, tracked = _names(key, tracked)
    columns = [*key, *tracked, *VALIDITY]
    closed = history.where(~F.col("is_current")).select(*columns)
    current = history.where("is_current")
    return closed.unionByName(scd2_changes(current, snapshot, key, tracked, now, order, deletes).select(*columns))


def scd2_actions(
    history: DataFrame,
    snapshot: DataFrame,
    key: Sequence[str],
    tracked: Sequence[str],
    order: Sequence[str] = (),
    deletes: bool = True,
) -> DataFrame:
    """Number of keys per action (NO_ACTION, INSERT, UPDATE, DELETE)."""
    key, tracked = _names(key, tracked)
    compared = _compared(history.where("is_current"), snapshot, key, tracked, order, deletes)
    return compared.groupBy("action").agg(F.count("*").alias("n"))


def empty_history(snapshot: DataFrame, key: Sequence[str], tracked: Sequence[str]) -> DataFrame:
    """A history without versions, for the first run."""
    types = dict(snapshot.dtypes)
    columns = ", ".join(f"`{c}` {types[c]}" for c in dict.fromkeys([*key, *tracked]))
    schema = f"{columns}, is_current boolean, valid_from timestamp, valid_to timestamp"
    return snapshot.sparkSession.createDataFrame([], schema)


def current_versions(history: DataFrame) -> DataFrame:
    return history.where("is_current")


def versions_at(history: DataFrame, at: datetime | str) -> DataFrame:
    """The versions valid at one point in time."""
    moment = F.lit(at).cast("timestamp")
    return history.where((F.col("valid_from") <= moment) & (moment < F.col("valid_to")))
