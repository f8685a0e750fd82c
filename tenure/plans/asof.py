"""Problem 4: each parcel of a transfer with the building type known at recording."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.functions.text import is_blank
from tenure.operators.asof import known_at_event
from tenure.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    transfers = table(spark, sf_dir, "transfers").where("recorded_date is not null")
    events = transfers.select("metro_id", "doc_id", "recorded_date", F.explode("parcel_ids").alias("parcel_id")).where(~is_blank(F.col("parcel_id"))).distinct()
    changes = table(spark, sf_dir, "parcels_snapshot").select("metro_id", "parcel_id", "snapshot_date", "retrieved_at", "building_type")
    key = ["metro_id", "parcel_id"]
    known = known_at_event(events, key, "recorded_date", changes, key, "snapshot_date", F.to_date("retrieved_at"), ["snapshot_date", "retrieved_at"], ["building_type"])
    return known.select("metro_id", "doc_id", "parcel_id", F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot_date"), "building_type").distinct()


QUERIES = {"p4_found": p4_found}
ORACLE = {
    "p4_found": """
        with e as (select distinct metro_id, doc_id, recorded_date, parcel_id
                   from (select metro_id, doc_id, recorded_date, unnest(parcel_ids) as parcel_id from transfers where recorded_date is not null)
                   where trim(coalesce(parcel_id, '')) <> ''),
        r as (select e.*, s.snapshot_date, s.building_type,
                     row_number() over (partition by e.metro_id, e.doc_id, e.recorded_date, e.parcel_id
                                        order by s.snapshot_date desc, s.retrieved_at desc, s.building_type desc nulls last) as rn
              from e join parcels_snapshot s on s.metro_id = e.metro_id and s.parcel_id = e.parcel_id
                   and s.snapshot_date <= e.recorded_date and cast(s.retrieved_at as date) <= e.recorded_date)
        select distinct metro_id, doc_id, parcel_id, cast(snapshot_date as varchar) as snapshot_date, building_type from r where rn = 1""",
}
