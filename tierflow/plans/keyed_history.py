"""Change history whose current versions lie by key and whose closed ones by time.

A delivery of a few keys reads and rewrites the parts of the current versions that hold these keys,
not all current versions, and never a closed one. Closed versions stand in a partition for the
month in which their validity ended and, below it, one for the step that closed them; a question
about a moment skips the months before it.

A step that runs again after a failure gives the same tables: closed versions are written before
the current ones change, to partitions that the step itself replaces.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierflow.operators.history import VALIDITY, scd2_changes, split_versions, versions_at
from tierflow.operators.skew import sent
from tierflow.session import materialize
from tierflow.sources.tables import KEY_PART, Tables

ENDED_IN, CLOSED_BY = "metadata_ended_in", "metadata_closed_by"


def _month(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


@dataclass(frozen=True)
class KeyedHistory:
    """The history `name`: tables `<name>_current`, kept by key, and `<name>_closed`."""

    tables: Tables
    name: str
    key: Sequence[str]
    tracked: Sequence[str]

    @property
    def columns(self) -> list[str]:
        return [*self.key, *[c for c in self.tracked if c not in self.key], *VALIDITY]

    @property
    def current(self) -> str:
        return f"{self.name}_current"

    @property
    def closed(self) -> str:
        return f"{self.name}_closed"

    def create(self, schema: T.StructType, parts: int = 64, buckets: int = 64) -> None:
        """Define both tables; `schema` holds key and tracked columns."""
        fields = [schema[c] for c in self.columns[: -len(VALIDITY)]]
        kinds = (T.BooleanType(), T.TimestampType(), T.TimestampType())
        versions = T.StructType([*fields, *[T.StructField(c, k) for c, k in zip(VALIDITY, kinds, strict=True)]])
        self.tables.create_keyed(self.current, versions, self.key, parts, buckets)
        marked = T.StructType([*versions.fields, T.StructField(ENDED_IN, T.StringType()), T.StructField(CLOSED_BY, T.StringType())])
        self.tables.create(self.closed, marked, [ENDED_IN, CLOSED_BY])

    def changes(self, snapshot: DataFrame, now: datetime | str, order: Sequence[str] = ()) -> DataFrame:
        """Open and just closed versions of the parts that hold a key of `snapshot`, with the column that places them."""
        part = self.tables.key_part(self.current, self.key)
        touched = self.tables.touched_parts(self.current, snapshot, self.key)
        known = self.tables.read(self.current).where(F.col(KEY_PART).isin(touched)).drop(KEY_PART)
        versions = scd2_changes(known, snapshot, self.key, self.tracked, now, order, deletes=False)
        return versions.select(*self.columns).withColumn(KEY_PART, part)

    def apply(self, snapshot: DataFrame, now: datetime | str, step: str, order: Sequence[str] = ()) -> None:
        """Compare the delivered keys with their current versions; keys that are not delivered stay as they are."""
        versions = self.changes(snapshot, now, order)
        ended = versions.where(~F.col("is_current")).drop(KEY_PART)
        marked = ended.withColumn(ENDED_IN, _month(F.col("valid_to"))).withColumn(CLOSED_BY, F.lit(step))
        self.tables.write_partitions(marked, self.closed, [ENDED_IN, CLOSED_BY])
        self.tables.rewrite_parts(self.current, versions.where("is_current"))

    def insert(self, late: DataFrame, delivered: DataFrame, version_ts: str, step: str, tie: Sequence[str] = ()) -> None:
        """Put rows that arrive late between the versions into which their times fall.

        `delivered` gives the rows of all earlier deliveries with the times at which they were
        applied (see `split_versions`). Of the current versions the parts of the late keys are read and
        rewritten; of the closed ones the months since the first late row are read and the partitions
        that hold a replaced version are rewritten. New versions are written before the replaced ones
        go, so that the step can run again after a failure at any point.
        """
        first = late.agg(F.min(F.col(version_ts).cast("timestamp"))).first()[0]
        if first is None and late.isEmpty():
            return
        placed = [ENDED_IN, CLOSED_BY]
        touched = self.tables.touched_parts(self.current, late, self.key)
        known = self.tables.read(self.current).where(F.col(KEY_PART).isin(touched)).drop(KEY_PART)
        known = known.withColumns({c: F.lit(None).cast("string") for c in placed})
        ended = self.tables.read(self.closed).where(F.col(ENDED_IN) >= _month(F.lit(first).cast("timestamp")))
        kept, replaced, built = split_versions(
            known.unionByName(ended), late, delivered, self.key, self.tracked, version_ts, tie
        )
        left = materialize(replaced.where(F.col(CLOSED_BY).isNotNull()).select(*placed).distinct(), "replaced-partitions")
        rest = kept.where(F.col(CLOSED_BY).isNotNull()).join(sent(left), placed, "left_semi").where(F.col(CLOSED_BY) != step)
        rest = materialize(rest.select(*self.columns, *placed), "kept-versions")
        part = self.tables.key_part(self.current, self.key)
        now = kept.where("is_current").select(*self.columns).unionByName(built.where("is_current").select(*self.columns))
        now = materialize(now.withColumn(KEY_PART, part), "current-versions")
        marked = built.where(~F.col("is_current")).select(*self.columns)
        marked = marked.withColumn(ENDED_IN, _month(F.col("valid_to"))).withColumn(CLOSED_BY, F.lit(step))
        marked = materialize(marked, "closed-versions")
        self.tables.write_partitions(marked, self.closed, placed)
        self.tables.write_partitions(rest, self.closed, placed)
        # Partitions of which nothing stays: at most one for each month and step.
        filled = rest.select(*placed).unionByName(marked.select(*placed)).distinct()
        for month, by in left.join(filled, placed, "left_anti").collect():
            self.tables.clear_partition(self.closed, {ENDED_IN: month, CLOSED_BY: by})
        self.tables.rewrite_parts(self.current, now)

    def read(self) -> DataFrame:
        """All versions."""
        return self.tables.read_keyed(self.current).unionByName(self.tables.read(self.closed).drop(ENDED_IN, CLOSED_BY))

    def at(self, moment: datetime | str) -> DataFrame:
        """The versions valid at one point in time; months that ended before it are not read."""
        ended = self.tables.read(self.closed)
        later = ended.where(F.col(ENDED_IN) >= _month(F.lit(moment).cast("timestamp"))).drop(ENDED_IN, CLOSED_BY)
        return versions_at(self.tables.read_keyed(self.current).unionByName(later), moment)
