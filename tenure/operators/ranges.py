"""Key-wise work in which no task grows with the largest key.

Rows are cut into ranges of (key, secondary order) at sampled quantiles, so a heavy key spans as many
ranges as its share of the rows demands. Each range is worked alone; afterwards the partial states of the
keys that span several ranges are stitched together. A cut falls inside at most one key, so ``n`` ranges
leave at most ``n - 1`` states to hand on, whatever the size of the data: only those are broadcast.

The cuts are plain literals in the plan. A retried or re-planned stage therefore puts every row into the
same range again, which ``spark_partition_id`` after ``repartitionByRange`` would not promise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenure.session import shuffle_partitions

RANGE = "__range"
#: Sampled rows per range from which the quantiles are taken; bounds what the driver receives.
SAMPLE_PER_RANGE = 40
#: Cuts up to which their search is compiled into the plan.
FEW_CUTS = 128


@dataclass(frozen=True)
class Scan:
    """A running value over the rows of a key up to and including the row itself.

    kind: ``sum``, ``count`` (of non-null values), ``max`` or ``min``; of a column expression.
    ``max`` of a struct whose first field is the order carries the last known row forward.
    """

    kind: str
    value: Column

    def aggregate(self, value: Column) -> Column:
        return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[self.kind](value)

    def merge(self, before: Column, own: Column) -> Column:
        if self.kind in ("sum", "count"):
            return F.when(before.isNull(), own).when(own.isNull(), before).otherwise(before + own)
        return (F.greatest if self.kind == "max" else F.least)(before, own)


def range_cuts(df: DataFrame, columns: Sequence[str], ranges: int, total: int | None = None, seed: int = 7) -> list[tuple]:
    """At most ``ranges - 1`` cut points over the columns, as sampled quantiles. ``total``: the number of rows, where known."""
    if ranges <= 1:
        return []
    rows = df.select(*columns)
    total = rows.count() if total is None else total
    wanted = ranges * SAMPLE_PER_RANGE
    if total == 0:
        return []
    if total > wanted:
        rows = rows.sample(False, min(1.0, wanted / total), seed)
    sampled = [tuple(r) for r in rows.collect()]
    sampled.sort(key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r))
    if not sampled:
        return []
    cuts = [sampled[len(sampled) * i // ranges] for i in range(1, ranges)]
    return list(dict.fromkeys(cuts))


def range_of(df: DataFrame, columns: Sequence[str], cuts: Sequence[tuple]) -> Column:
    """The number of the range a row falls into, by bisection: as many comparisons as log2(ranges).

    A few cuts are a tree of CASEs, which compiles; many are one array literal that is searched, so that the
    plan does not grow with the number of partitions.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])

    def literal(cut: tuple) -> Column:
        return F.struct(*[F.lit(v).cast(types[c]).alias(f"c{i}") for i, (c, v) in enumerate(zip(columns, cut))])

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(row < literal(cuts[middle]), tree(low, middle)).otherwise(tree(middle + 1, high))

    if len(cuts) <= FEW_CUTS:
        return tree(0, len(cuts))
    table = F.array(*[literal(c) for c in cuts])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])

    def search(passed: Column, step: Column) -> Column:
        at = passed + step
        return F.when((at <= len(cuts)) & (F.try_element_at(table, at) <= row), at).otherwise(passed)

    return F.aggregate(steps, F.lit(0), search)


def split_into_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int | None = None, sampled: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """df with the column ``__range``. Null keys and null order values sort first and are kept.

    The quantiles are those of ``sampled`` (total: its rows), df itself if not given: rows of about the same
    distribution that are cheaper to read, such as those that df aggregates.
    """
    ranges = ranges or shuffle_partitions(df.sparkSession)
    columns = [*keys, *order]
    return df.withColumn(RANGE, range_of(df, columns, range_cuts(df if sampled is None else sampled, columns, ranges, total)))


def ranged_aggregate(df: DataFrame, keys: Sequence[str], order: Sequence[str], aggregates: Mapping[str, Scan], ranges: int | None = None, total: int | None = None) -> DataFrame:
    """One row per key with each aggregate, from one partial state per key and range.

    The states of a (range, key) are combined before the shuffle; a key's states then number at most
    ``ranges``, so stitching them costs no task more than that. Null keys form a group of their own;
    an empty input gives no row; repeated rows count each.
    """
    split = split_into_ranges(df, keys, order, ranges, total=total)
    states = split.groupBy(RANGE, *keys).agg(*[s.aggregate(s.value).alias(n) for n, s in aggregates.items()])
    stitch = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
    return states.groupBy(*keys).agg(*[stitch[s.kind](n).alias(n) for n, s in aggregates.items()])


def ranged_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], scans: Mapping[str, Scan], ranges: int | None = None, sampled: DataFrame | None = None) -> DataFrame:
    """df with a running value per scan over (keys, order), equal to an unbounded-preceding window.

    The order should make rows of a key distinct: rows that tie in it fall in either order. Costs one
    shuffle of the rows on (range, key) in groups of bounded size, and one of partial states.
    """
    split = split_into_ranges(df, keys, order, ranges, sampled)
    return scan_ranges(split, keys, order, scans)


def scan_ranges(split: DataFrame, keys: Sequence[str], order: Sequence[str], scans: Mapping[str, Scan]) -> DataFrame:
    """``ranged_scan`` for rows that already carry ``__range``; drops it."""
    named = list(scans.items())
    rows = split.withColumns({f"__v{i}": s.value for i, (_, s) in enumerate(named)})
    states = rows.groupBy(RANGE, *keys).agg(*[s.aggregate(F.col(f"__v{i}")).alias(f"__s{i}") for i, (_, s) in enumerate(named)])
    # only a key that spans ranges has anything to hand on
    per_key = Window.partitionBy(*keys)
    spanning = states.withColumn("__spans", F.count(F.lit(1)).over(per_key)).where("__spans > 1")
    earlier = per_key.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    merge = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
    before = spanning.select(RANGE, *keys, *[merge[s.kind](f"__s{i}").over(earlier).alias(f"__b{i}") for i, (_, s) in enumerate(named)])
    before = before.select(F.col(RANGE).alias("__r"), *[F.col(k).alias(f"__k{j}") for j, k in enumerate(keys)], *[f"__b{i}" for i in range(len(named))])
    inside = Window.partitionBy(RANGE, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumns({f"__l{i}": s.aggregate(F.col(f"__v{i}")).over(inside) for i, (_, s) in enumerate(named)})
    on = F.col(RANGE) == F.col("__r")
    for j, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"__k{j}"))
    # at most 2 * (ranges - 1) rows, see the module's text
    joined = local.join(F.broadcast(before), on, "left")
    return joined.select(*[c for c in split.columns if c != RANGE], *[s.merge(F.col(f"__b{i}"), F.col(f"__l{i}")).alias(n) for i, (n, s) in enumerate(named)])
