"""Relational building blocks: latest rows, documents from rows, lookups by range, audited filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.functions.text import is_blank
from tenure.operators.ranges import Scan, ranged_scan


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that is greatest in the order columns, then in all other columns, nulls lowest.

    One aggregate of structs, combined before the shuffle: a key with a third of the rows is one state.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"__best.{c}") for c in df.columns])


def least_named(df: DataFrame, key: str, role: str, name: str, roles: Mapping[str, str]) -> DataFrame:
    """key and, per output column of roles, the least non-blank name in that role; keys without any have nulls."""
    return df.groupBy(key).agg(*[F.min(F.when((F.col(role) == value) & ~is_blank(F.col(name)), F.col(name))).alias(out) for out, value in roles.items()])


def documents_of(df: DataFrame, key: str, first: Sequence[str], order: Sequence[str], items: Mapping[str, str]) -> DataFrame:
    """Rows grouped into documents: the first columns of the least row in the order, item columns as sorted sets.

    Null and empty items are dropped; a document without items has an empty list.
    """
    place = F.struct(*[F.col(c) for c in order])
    value = F.min(F.struct(place.alias("o"), *[F.col(c).alias(f"f{i}") for i, c in enumerate(first)]))
    lists = [F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c)))).alias(out) for out, c in items.items()]
    grouped = df.groupBy(key).agg(value.alias("__v"), *lists)
    return grouped.select(key, *[F.col(f"__v.f{i}").alias(c) for i, c in enumerate(first)], *items)


def exploded_items(df: DataFrame, items: str, out: str) -> DataFrame:
    """One row per document and distinct item that is neither null nor empty."""
    return df.withColumn(out, F.explode(F.array_distinct(items))).where(F.col(out).isNotNull() & (F.col(out) != "")).drop(items)


#: Levels of the dyadic grid: whole numbers below 2 to this power.
LEVELS = 48


def range_lookup(left: DataFrame, on: Sequence[str], value: str, ranges: DataFrame, low: str, high: str, pick: str) -> DataFrame:
    """left with the least ``pick`` of the ranges with equal keys that hold the value, or null.

    Values and ends are whole numbers from 0; others, nulls and ends in the wrong order match nothing. Every range is cut
    into the few dyadic cells that make it up (two a level at most) and joined on equal keys, level and cell: a
    hash join that meets only ranges that hold the value, however many share its keys. left's rows must be distinct.
    """
    lo, hi = F.col("__low"), F.col("__high")
    right = ranges.select(*[F.col(c).alias(f"__{c}") for c in on], F.col(low).cast("bigint").alias("__low"), F.col(high).cast("bigint").alias("__high"), F.col(pick).alias("__pick")).where((lo >= 0) & (lo <= hi))
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def step(state: Column, level: Column) -> Column:
        """The ends of what is left at a level, once its odd cells at the two ends are taken."""
        a, b = state["a"], state["b"]
        cell = lambda there, at: F.when(there, F.array(F.struct(level.cast("int").alias("level"), at.alias("cell")))).otherwise(F.array().cast("array<struct<level:int,cell:bigint>>"))
        odd_a, odd_b = (a < b) & (a % 2 == 1), (a < b) & (b % 2 == 1)
        return F.struct(F.shiftright(F.when(odd_a, a + 1).otherwise(a), 1).alias("a"), F.shiftright(F.when(odd_b, b - 1).otherwise(b), 1).alias("b"), F.concat(state["cells"], cell(odd_a, a), cell(odd_b, b - 1)).alias("cells"))

    start = F.struct(lo.alias("a"), (hi + 1).alias("b"), F.array().cast("array<struct<level:int,cell:bigint>>").alias("cells"))
    cells = F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, step)["cells"]
    right = right.withColumn("__c", F.explode(cells)).select("*", F.col("__c.level").alias("__level"), F.col("__c.cell").alias("__cell")).drop("__c", "__low", "__high")
    # only levels that some range uses are asked: at most LEVELS + 1 numbers
    used = sorted(r[0] for r in right.select("__level").distinct().collect())
    if not used:
        return left.withColumn(pick, F.lit(None).cast(ranges.schema[pick].dataType))
    v = F.col(value).cast("bigint")
    asked = left.withColumn("__l", F.explode(F.when((v >= zero) & (v < one * (1 << LEVELS)), F.array(*[F.lit(u) for u in used])).otherwise(F.array(F.lit(None).cast("int")))))
    asked = asked.withColumn("__at", F.expr(f"shiftright(cast(`{value}` as bigint), __l)"))
    match = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__{c}") for c in on] + [F.col("__l") == F.col("__level"), F.col("__at") == F.col("__cell")])
    return asked.join(right, match, "left").groupBy(*left.columns).agg(F.min("__pick").alias(pick))


def audited_filter(df: DataFrame, cuts: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """The rows that pass all cuts in order, and (stage, cut, rows_in, rows_out) of each cut.

    A null condition drops the row. All counts come from one pass: cut k is passed by rows that pass 1..k.
    """
    passed: list[Column] = []
    counts = [F.count(F.lit(1)).alias("c0")]
    for i, (_, condition) in enumerate(cuts, 1):
        passed.append(F.coalesce(condition, F.lit(False)))
        counts.append(F.count_if(reduce(lambda a, b: a & b, passed)).alias(f"c{i}"))
    rows = [F.struct(F.lit(i).alias("stage"), F.lit(name).alias("cut"), F.col(f"c{i - 1}").alias("rows_in"), F.col(f"c{i}").alias("rows_out")) for i, (name, _) in enumerate(cuts, 1)]
    audit = df.agg(*counts).select(F.inline(F.array(*rows)))
    return df.where(reduce(lambda a, b: a & b, passed)), audit


def union_by_name(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key-value store semantics: a key's row in new replaces the one in old; the last write of new wins by its columns."""
    stamped = union_by_name(old.withColumn("__write", F.lit(0)), new.withColumn("__write", F.lit(1)))
    return latest_per_key(stamped, keys, ["__write"]).drop("__write")


def row_index(df: DataFrame, order: Sequence[str], name: str = "row_no") -> DataFrame:
    """df with the number of each row in the order, from 0. Worked in ranges: no task sees all rows. Rows that tie get either number."""
    ranked = ranged_scan(df.withColumn("__all", F.lit(0)), ["__all"], order, {"__no": Scan("sum", F.lit(1))})
    return ranked.select(*df.columns, (F.col("__no") - 1).alias(name))


def value_summary(df: DataFrame, keys: Sequence[str], latest: str, listed: str) -> DataFrame:
    """Per key the greatest non-blank text of one column and the sorted distinct non-blank values of another, which should have few."""
    there = lambda c: F.when(~is_blank(F.col(c)), F.col(c))
    return df.groupBy(*keys).agg(F.max(there(latest)).alias(latest), F.array_join(F.array_sort(F.collect_set(there(listed))), "|").alias(listed))
