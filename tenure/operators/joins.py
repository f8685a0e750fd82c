"""Joins that stay even when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.session import shuffle_partitions

#: Parts over which the rows of a hot key are spread, the share of a partition from which a key is hot, and the rows that one task bears in any case.
PARTS, HOT_SHARE, BEARABLE = 32, 0.25, 50_000


def hot_keys(df: DataFrame, key: str) -> list:
    """The keys that alone fill a good part of an even partition: at most partitions / HOT_SHARE of them, however many rows there are."""
    rows = df.where(F.col(key).isNotNull())
    total = rows.count()
    limit = max(BEARABLE, int(HOT_SHARE * total / shuffle_partitions(df.sparkSession)))
    if total <= limit:
        return []
    return [r[0] for r in rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit).select(key).collect()]


def hot_key_lookup(left: DataFrame, key: str, right: DataFrame, right_key: str, values: Sequence[str], parts: int = PARTS) -> DataFrame:
    """left with the values of right's row of that key, or nulls; right must hold a key once.

    Rows of the hot keys of left are salted over ``parts`` parts, and right's rows of those keys repeated as
    often, so that no task meets more than a part of any key. Null keys find nothing. Values must not be
    columns of left. left is read to find the hot keys: it should be cheap to read again.
    """
    side = right.select(F.col(right_key).alias("__k"), *values)
    hot = hot_keys(left, key)
    if not hot:
        return left.join(side, F.col(key) == F.col("__k"), "left").select(*left.columns, *values)
    known = F.array(*[F.lit(h) for h in hot])
    salt = F.when(F.array_contains(known, F.col(key)), F.pmod(F.xxhash64(*left.columns), F.lit(parts)).cast("int")).otherwise(0)
    copies = F.when(F.array_contains(known, F.col("__k")), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    salted, spread = left.withColumn("__part", salt), side.withColumn("__p", F.explode(copies))
    return salted.join(spread, (F.col(key) == F.col("__k")) & (F.col("__part") == F.col("__p")), "left").select(*left.columns, *values)
