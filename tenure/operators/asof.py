"""Attributes as they were known when an event took place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.operators.ranges import Scan, ranged_scan


def known_at_event(
    events: DataFrame, event_key: list[str], event_time: str, changes: DataFrame, change_key: list[str], valid_from: str, known_from: Column, rank: list[str], attributes: list[str]
) -> DataFrame:
    """Each event with the attribute row valid and known at its time; events without one are left out.

    A change counts from ``greatest(valid_from, known_from)``. Among the changes that count, the one with
    the greatest ``rank`` columns wins (ties: the greatest attribute values), so a late correction of an
    old state never displaces a newer one. On the same day a change comes before the event.

    Events and changes are united, sorted by entity, time and tie priority, and the greatest change so far
    is carried forward. The sort runs in ranges, so an entity with a third of all rows is no long task.
    Events with a null time or key, and changes with a null time or key, count for nothing. Repeated changes
    weigh once; repeated events come back repeated. Columns of both sides may clash: only the named ones are
    used, the event's columns win, and ``rank``/``attributes`` must be named differently from them.
    """
    extra = [c for c in events.columns if c not in event_key]
    e_keys = [F.col(c).alias(f"__e{i}") for i, c in enumerate(event_key)]
    left = events.where(F.col(event_time).isNotNull())
    for k in event_key:
        left = left.where(F.col(k).isNotNull())
    payload = F.struct(*[F.col(c) for c in extra])
    left = left.select(*e_keys, F.col(event_time).cast("timestamp_ntz").alias("__at"), F.lit(1).alias("__turn"), F.xxhash64(*[F.col(c) for c in extra]).alias("__tie"), payload.alias("__event"))

    at = F.greatest(F.col(valid_from).cast("timestamp_ntz"), known_from.cast("timestamp_ntz"))
    state = F.struct(*[F.col(c) for c in rank], *[F.col(c) for c in attributes if c not in rank])
    right = changes.where(F.col(valid_from).isNotNull() & known_from.isNotNull())
    for k in change_key:
        right = right.where(F.col(k).isNotNull())
    right = right.select(*[F.col(c).alias(f"__e{i}") for i, c in enumerate(change_key)], at.alias("__at"), F.lit(0).alias("__turn"), state.alias("__state"))
    # quantiles of the order do not need the aggregate
    order = ["__at", "__turn", "__tie"]
    keys = [f"__e{i}" for i in range(len(event_key))]
    sampled = left.select(*keys, *order).unionByName(right.withColumn("__tie", F.lit(0).cast("bigint")).select(*keys, *order))
    # of the changes of one moment only the greatest can ever be carried on
    right = right.groupBy(*[f"__e{i}" for i in range(len(change_key))], "__at", "__turn").agg(F.max("__state").alias("__state")).withColumn("__tie", F.lit(0).cast("bigint"))
    both = left.unionByName(right, allowMissingColumns=True)
    carried = ranged_scan(both, keys, order, {"__known": Scan("max", F.col("__state"))}, sampled=sampled)
    found = carried.where((F.col("__turn") == 1) & F.col("__known").isNotNull())
    names = [*rank, *[c for c in attributes if c not in rank]]
    return found.select(*[F.col(f"__e{i}").alias(c) for i, c in enumerate(event_key)], *[F.col(f"__event.{c}").alias(c) for c in extra], *[F.col(f"__known.{c}").alias(c) for c in names])
