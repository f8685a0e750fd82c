"""Transfers joined to the stock: flows by period, and the stock as it stood on past dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenure.functions.scalars import ratio


def attach_parcels(lots: DataFrame, parcels: DataFrame, attributes: Sequence[str], billing: DataFrame | None = None) -> DataFrame:
    """lots (doc_id, parcel_id, ...) with the parcel's attributes: by its own id, else by its billing lot; others drop out.

    parcels holds an id once; billing (parcel_id, billing_id) maps ids whose parcel is another. One row per
    lot: both matches are tried in one pass, not as two unions.
    """
    own = parcels.select(F.col("parcel_id").alias("__own"), *[F.col(a).alias(f"__o_{a}") for a in attributes])
    rows = lots.join(own, F.col("parcel_id") == F.col("__own"), "left")
    if billing is None:
        return rows.where("__own is not null").select(*lots.columns, *[F.col(f"__o_{a}").alias(a) for a in attributes])
    via = billing.select(F.col("parcel_id").alias("__from"), F.col("billing_id").alias("__via"))
    bill = parcels.select(F.col("parcel_id").alias("__bill"), *[F.col(a).alias(f"__b_{a}") for a in attributes])
    rows = rows.join(via, F.col("parcel_id") == F.col("__from"), "left").join(bill, F.col("__via") == F.col("__bill"), "left")
    return rows.where("__own is not null or __bill is not null").select(*lots.columns, *[F.when(F.col("__own").isNotNull(), F.col(f"__o_{a}")).otherwise(F.col(f"__b_{a}")).alias(a) for a in attributes])


def flow_shares(lots: DataFrame, doc: str, groups: Sequence[str], units: str, entity: Column) -> DataFrame:
    """Per group: documents, their units, and how many go to entities. Attributes of a document are those of its least lot.

    A null group keeps its totals but counts no entities; shares of nothing are null.
    """
    order = F.struct("parcel_id", *groups)
    docs = lots.groupBy(doc).agg(F.min(F.struct(order.alias("o"), *[F.col(g) for g in groups])).alias("g"), F.sum(units).alias("units"), F.max(entity).alias("entity"))
    docs = docs.select(doc, *[F.col(f"g.{g}").alias(g) for g in groups], "units", "entity")
    known = F.lit(True)
    for g in groups:
        known &= F.col(g).isNotNull()
    bought = F.coalesce(F.col("entity"), F.lit(False)) & known
    table = docs.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("sales"), F.coalesce(F.sum("units"), F.lit(0)).cast("bigint").alias("units"), F.count_if(bought).alias("entity_sales"), F.coalesce(F.sum(F.when(bought, F.col("units"))), F.lit(0)).cast("bigint").alias("entity_units")
    )
    return table.select("*", ratio(F.col("entity_sales"), F.col("sales")).alias("sale_share"), ratio(F.col("entity_units"), F.col("units")).alias("unit_share"))


def owner_intervals(deeds: DataFrame, parcel: str, recorded: str, order: Sequence[str]) -> DataFrame:
    """Each deed with the date its parcel's next deed was recorded (null for the last): its validity interval."""
    turn = Window.partitionBy(parcel).orderBy(recorded, *order)
    return deeds.where(F.col(recorded).isNotNull()).withColumn("until", F.lead(recorded).over(turn))


def as_of_years(intervals: DataFrame, recorded: str, first: int, last: int) -> DataFrame:
    """A row per interval and year end on which it held: the years are exploded, no join with a calendar.

    A deed recorded on the last day of a year counts for that year; one replaced the same day never held.
    """
    start = F.greatest(F.lit(first), F.year(recorded))
    end = F.coalesce(F.year("until") - 1, F.lit(last))
    end = F.least(end, F.lit(last))
    return intervals.where(start <= end).withColumn("year", F.explode(F.sequence(start, end)))


def history_shares(held: DataFrame, stock_size: int, years: Sequence[int], informative: Column, entity: Column, private: Column, units: str) -> DataFrame:
    """One row per year: rebuilt private stock, its entity shares, those of the informative types, and the share of today's stock covered.

    Rows without a type are out of the universe; years in which nothing was held have zeros.
    """
    u = F.coalesce(F.col(units), F.lit(0))
    count = lambda what: F.count_if(private & what)
    total = lambda what: F.coalesce(F.sum(F.when(private & what, u)), F.lit(0)).cast("bigint")
    all_ = F.lit(True)
    rows = held.groupBy("year").agg(
        F.count(F.lit(1)).alias("covered"), count(all_).alias("parcels"), total(all_).alias("units"), count(entity).alias("entity_parcels"), total(entity).alias("entity_units"),
        count(informative).alias("sfr_condo_parcels"), total(informative).alias("sfr_condo_units"), total(informative & entity).alias("sfr_condo_entity_units"),
    )
    spark = held.sparkSession
    every = spark.createDataFrame([(y,) for y in years], "year int").join(rows, "year", "left").na.fill(0)
    share = lambda a, b: F.coalesce(ratio(F.col(a), F.col(b)), F.lit(0.0))
    return every.select(
        "year", "parcels", "units", "entity_parcels", "entity_units", share("entity_parcels", "parcels").alias("parcel_share"), share("entity_units", "units").alias("unit_share"), "sfr_condo_parcels", "sfr_condo_units",
        share("sfr_condo_entity_units", "sfr_condo_units").alias("sfr_condo_entity_unit_share"), F.coalesce(ratio(F.col("covered"), F.lit(stock_size)), F.lit(0.0)).alias("coverage_parcels"),
    )
