"""Range-split work against plain windows and aggregates."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tenure.operators import joins
from tenure.operators.joins import hot_key_lookup
from tenure.operators.ranges import Scan, range_cuts, ranged_aggregate, ranged_scan, split_into_ranges
from tenure.operators.skew import concentration, heavy_keys, key_totals


def rows_of(df, *columns):
    return sorted([tuple(r[c] for c in columns) for r in df.collect()], key=repr)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    data = [("hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{rng.randrange(40)}", i if i % 7 else None, rng.randrange(100) if i % 9 else None) for i in range(3000)]
    return spark.createDataFrame(data, "k string, o int, v int")


def test_heavy_key_spans_ranges(skewed):
    split = split_into_ranges(skewed, ["k"], ["o"], 8)
    sizes = dict(rows_of(split.groupBy("__range").count(), "__range", "count"))
    assert len(sizes) > 4 and max(sizes.values()) < 1000
    assert split.where("k = 'hot'").select("__range").distinct().count() >= 2


def test_cuts_are_bounded(skewed):
    assert len(range_cuts(skewed, ["k", "o"], 8)) <= 7


def test_aggregate_equals_group_by(skewed):
    got = ranged_aggregate(skewed, ["k"], ["o"], {"n": Scan("sum", F.lit(1)), "s": Scan("sum", F.col("v")), "m": Scan("max", F.col("v")), "c": Scan("count", F.col("v")), "l": Scan("min", F.col("v"))}, 8)
    want = skewed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.max("v").alias("m"), F.count("v").alias("c"), F.min("v").alias("l"))
    assert rows_of(got, "k", "n", "s", "m", "c", "l") == rows_of(want, "k", "n", "s", "m", "c", "l")


def test_scan_equals_window(skewed):
    one = skewed.where("o is not null")
    got = ranged_scan(one, ["k"], ["o"], {"s": Scan("sum", F.col("v")), "m": Scan("max", F.col("v")), "n": Scan("count", F.col("v"))}, 8)
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    want = one.select("*", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("m"), F.count("v").over(w).alias("n"))
    assert rows_of(got, "k", "o", "s", "m", "n") == rows_of(want, "k", "o", "s", "m", "n")


def test_many_ranges(spark, skewed, monkeypatch):
    """The search in an array literal gives each row the range that the compiled tree gives."""
    from tenure.operators import ranges

    cuts = range_cuts(skewed, ["k", "o"], 60)
    tree = rows_of(skewed.withColumn("r", ranges.range_of(skewed, ["k", "o"], cuts)), "k", "o", "r")
    monkeypatch.setattr(ranges, "FEW_CUTS", 3)
    assert rows_of(skewed.withColumn("r", ranges.range_of(skewed, ["k", "o"], cuts)), "k", "o", "r") == tree
    assert len({r[2] for r in tree}) == len(cuts) + 1


def test_empty(spark, skewed):
    empty = skewed.limit(0)
    assert ranged_aggregate(empty, ["k"], ["o"], {"n": Scan("sum", F.lit(1))}).count() == 0
    assert ranged_scan(empty, ["k"], ["o"], {"n": Scan("sum", F.lit(1))}).count() == 0


def test_hot_key_lookup(spark, monkeypatch):
    monkeypatch.setattr(joins, "BEARABLE", 100)
    left = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 7}" if i % 5 else None) for i in range(1000)], "i int, k string")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3)], "k string, v int")
    got = hot_key_lookup(left, "k", right, "k", ["v"], parts=4)
    assert joins.hot_keys(left, "k") == ["hot"]
    assert rows_of(got, "i", "k", "v") == rows_of(left.join(right, "k", "left"), "i", "k", "v")


def test_concentration_closed_form(spark):
    data = [(f"p{i}", "NTA1", "a" if i < 50 else "b" if i < 80 else "c", 1) for i in range(100)] + [(f"t{i}", "TINY", "a", 1) for i in range(3)]
    data += [(f"q{i}", "BLANK", "  " if i % 2 else None, 1) for i in range(10)]
    figures = {r["geo_neighborhood"]: r for r in concentration(spark.createDataFrame(data, "parcel_id string, geo_neighborhood string, owner_key string, res_units int")).collect()}
    assert figures["NTA1"]["n_name_keys"] == 3 and abs(figures["NTA1"]["hhi_parcels"] - 0.38) < 1e-9 and figures["NTA1"]["top5_parcel_share"] == 1.0
    assert figures["TINY"]["suppressed"] and figures["TINY"]["hhi_parcels"] is None and figures["TINY"]["parcels"] == 3
    assert figures["BLANK"]["n_name_keys"] == 10 and abs(figures["BLANK"]["hhi_parcels"] - 0.1) < 1e-9


def test_concentration_nulls_and_clashes(spark):
    schema = "parcel_id string, geo_neighborhood string, owner_key string, res_units int, rank int, n int, u int"
    data = [(None, None, None, None, 1, 2, 3), ("p", " ", "o", 0, 1, 2, 3), ("p", "", "o", 20, 1, 2, 3)]
    (row,) = concentration(spark.createDataFrame(data, schema)).collect()
    assert row["geo_neighborhood"] == "" and row["parcels"] == 3 and row["units"] == 20 and row["n_name_keys"] == 2
    assert concentration(spark.createDataFrame([], schema)).count() == 0


def test_heavy_keys_threshold(spark):
    df = spark.createDataFrame([("a", str(i)) for i in range(97)] + [("b", "x")] * 3 + [(" ", "y")] * 5 + [(None, None)] * 5, "k string, o string")
    assert rows_of(heavy_keys(df, "k", ["o"], 3 / 110), "key_value", "n_rows") == [("a", 97), ("b", 3)]
    assert heavy_keys(df.limit(0), "k", ["o"], 0.03).count() == 0
    assert dict(rows_of(key_totals(df.withColumn("w", F.lit(2)), "k", ["o"], "w"), "k", "units"))["a"] == 194
