"""Results per key when a few keys hold most rows: totals per owner, concentration per neighborhood."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.functions.text import is_blank
from tenure.operators.ranges import Scan, ranged_aggregate, ranged_scan
from tenure.session import checkpoint

#: Suppression limit and the ranks whose shares are published.
MIN_UNITS = 10
TOP = (5, 10, 20)


def heavy_keys(df: DataFrame, key: str, order: list[str], least_share: float) -> DataFrame:
    """(key_value, n_rows): non-blank values of key that hold at least the share of all rows.

    All rows count towards the whole, those with a blank or null key too. Empty input: no rows.
    """
    # one number; parquet knows it without reading the rows
    total = df.count()
    counted = ranged_aggregate(df.select(key, *order), [key], order, {"n_rows": Scan("sum", F.lit(1))}, total=total)
    return counted.where(~is_blank(F.col(key)) & (F.col("n_rows") >= least_share * total)).select(F.col(key).alias("key_value"), "n_rows")


def key_totals(df: DataFrame, key: str, order: list[str], units: str) -> DataFrame:
    """(key, parcels, units) for every value of key, blank and null ones as they stand; null units add 0."""
    return ranged_aggregate(
        df.select(key, *order, units), [key], order, {"parcels": Scan("sum", F.lit(1)), "units": Scan("sum", F.coalesce(F.col(units).cast("bigint"), F.lit(0)))}
    )


def concentration(df: DataFrame, hood: str = "geo_neighborhood", owner: str = "owner_key", parcel: str = "parcel_id", units: str = "res_units") -> DataFrame:
    """HHI and top-5/10/20 shares per neighborhood, in the columns of concentration_by_neighborhood.

    A blank or null neighborhood is the group "". A blank owner key never merges: each of its parcels is an
    owner of its own. Null units add 0. Neighborhoods under 10 units are suppressed: counts stay, shares are null. Shares of
    zero units are 0. Ties in rank share the same value, so their order does not show. Empty input: no rows.

    Owners are combined map-side first; ranks come from two ranged scans over (neighborhood, size), so
    neither the largest neighborhood nor the blank owner makes a long task.
    """
    rows = df.select(
        F.when(is_blank(F.col(hood)), "").otherwise(F.col(hood)).alias("hood"),
        F.when(is_blank(F.col(owner)), F.concat(F.lit("_blank:"), F.coalesce(F.col(parcel), F.lit("")))).otherwise(F.col(owner)).alias("owner"),
        F.coalesce(F.col(units).cast("bigint"), F.lit(0)).alias("u"),
    )
    owners = rows.groupBy("hood", "owner").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("u"))
    owners = checkpoint(owners.withColumns({"by_n": -F.col("n"), "by_u": -F.col("u")}))

    def ranked(size: str) -> DataFrame:
        """Per neighborhood, sums over the owners in order of size."""
        rank = ranged_scan(owners.select("hood", "owner", f"by_{size}", size), ["hood"], [f"by_{size}", "owner"], {"rank": Scan("sum", F.lit(1))})
        return rank.groupBy("hood").agg(
            F.count(F.lit(1)).alias(f"owners_{size}"),
            F.sum(size).alias(f"sum_{size}"),
            F.sum(F.col(size).cast("double") * F.col(size)).alias(f"sq_{size}"),
            *[F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col(size))), F.lit(0)).alias(f"top{k}_{size}") for k in TOP],
        )

    sums = ranked("n").join(ranked("u"), "hood").withColumnsRenamed({"sum_n": "parcels", "sum_u": "units", "owners_n": "n_name_keys"})

    def share(value: Column, whole_: Column) -> Column:
        return F.when(F.col("units") < MIN_UNITS, None).otherwise(F.when(whole_ == 0, F.lit(0.0)).otherwise(F.try_divide(value.cast("double"), whole_)))

    shares = [share(F.col("sq_n"), F.col("parcels").cast("double") * F.col("parcels")).alias("hhi_parcels"), share(F.col("sq_u"), F.col("units").cast("double") * F.col("units")).alias("hhi_units")]
    for k in TOP:
        shares += [share(F.col(f"top{k}_n"), F.col("parcels")).alias(f"top{k}_parcel_share"), share(F.col(f"top{k}_u"), F.col("units")).alias(f"top{k}_unit_share")]
    return sums.select(
        F.col("hood").alias("geo_neighborhood"), F.col("parcels").cast("double").alias("parcels"), F.col("units").cast("double").alias("units"), "n_name_keys", *shares, (F.col("units") < MIN_UNITS).alias("suppressed")
    )
