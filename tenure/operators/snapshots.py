"""What changed between full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def validity_intervals(df: DataFrame, group: str, key: str, snapshot: str, version: str, compared: dict[str, Column]) -> DataFrame:
    """Gaps and islands over (key, row hash): one row per unbroken run of equal content.

    Columns: group, key, row_hash, first_no, last_no (numbers of the group's snapshots), valid_from (date of
    first_no), ended_on (date of the snapshot after last_no, null if there is none).

    A key's row in a snapshot is the one with the latest ``version`` (nulls first; ties: the greatest
    content). Rows with a null group, key or snapshot count for nothing; repeated rows weigh once. Snapshots
    are numbered within their group by the dates that occur in it. A key has one row per snapshot after the
    map-side combine, so no window partition is longer than the number of snapshots.
    """
    content = F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in compared.items()])), 256)
    rows = df.where(F.col(group).isNotNull() & F.col(key).isNotNull() & F.col(snapshot).isNotNull()).select(
        F.col(group).alias("g"), F.col(key).alias("k"), F.col(snapshot).alias("d"), F.struct(F.col(version).alias("v"), content.alias("h")).alias("s")
    )
    latest = rows.groupBy("g", "k", "d").agg(F.max("s").alias("s")).select("g", "k", "d", F.col("s.h").alias("h"))
    dates = df.where(F.col(group).isNotNull() & F.col(snapshot).isNotNull()).groupBy(F.col(group).alias("g"), F.col(snapshot).alias("d")).count().drop("count")
    per_group = Window.partitionBy("g").orderBy("d")
    calendar = dates.select("g", "d", F.row_number().over(per_group).alias("no"), F.lead("d").over(per_group).alias("next_d"))
    numbered = latest.join(calendar, ["g", "d"])
    per_key = Window.partitionBy("g", "k").orderBy("no")
    starts = F.coalesce((F.lag("no").over(per_key) != F.col("no") - 1) | (F.lag("h").over(per_key) != F.col("h")), F.lit(True))
    islands = numbered.withColumn("__start", starts.cast("int")).withColumn("__island", F.sum("__start").over(per_key))
    return islands.groupBy("g", "k", "__island").agg(
        F.max("h").alias("row_hash"), F.min("no").alias("first_no"), F.max("no").alias("last_no"), F.min("d").alias("valid_from"), F.max_by("next_d", "no").alias("ended_on")
    ).select(F.col("g").alias(group), F.col("k").alias(key), "row_hash", "first_no", "last_no", "valid_from", "ended_on")


def change_events(intervals: DataFrame, group: str, key: str, snapshot: str) -> DataFrame:
    """(group, key, snapshot, change_kind) from validity intervals: added, removed, changed.

    An interval that begins where another ends is a change; one that begins alone an addition, unless in the
    group's first snapshot; one that ends alone before the last snapshot a removal.
    """
    per_key = Window.partitionBy(group, key).orderBy("first_no")
    around = intervals.withColumns({"__before": F.lag("last_no").over(per_key), "__after": F.lead("first_no").over(per_key)})
    begins = F.when(F.col("__before") == F.col("first_no") - 1, "changed").when(F.col("first_no") > 1, "added")
    ends = F.when(F.col("ended_on").isNotNull() & F.coalesce(F.col("__after") != F.col("last_no") + 1, F.lit(True)), "removed")
    events = F.array(F.struct(F.col("valid_from").alias("d"), begins.alias("kind")), F.struct(F.col("ended_on").alias("d"), ends.alias("kind")))
    return around.select(group, key, F.explode(events).alias("e")).where("e.kind is not null").select(group, key, F.col("e.d").alias(snapshot), F.col("e.kind").alias("change_kind"))
