"""Problem 7: what changed between full snapshots of the parcels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.functions.text import fold
from tenure.operators.snapshots import change_events, validity_intervals
from tenure.session import table

KEY = ("metro_id", "parcel_id", "snapshot_date")


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "parcels_snapshot")
    compared = {c: fold(F.col(c)) for c in ("building_type", "owner_name_raw", "owner_mailing_address_raw")} | {"res_units": F.col("res_units")}
    return validity_intervals(rows, *KEY, "retrieved_at", compared)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = change_events(_intervals(spark, sf_dir), *KEY)
    return events.withColumn("snapshot_date", F.date_format("snapshot_date", "yyyy-MM-dd"))


def p7_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _intervals(spark, sf_dir).select("metro_id", "parcel_id", "first_no", "last_no", "valid_from", "ended_on")


QUERIES = {"p7_found": p7_found, "p7_intervals": p7_intervals}

_NUMBERED = r"""
    d as (select metro_id, snapshot_date, row_number() over (partition by metro_id order by snapshot_date) as no,
                 lead(snapshot_date) over (partition by metro_id order by snapshot_date) as next_date
          from (select distinct metro_id, snapshot_date from parcels_snapshot)),
    c as (select metro_id, parcel_id, snapshot_date, retrieved_at,
                 concat_ws('|', coalesce(cast(res_units as varchar), '-'),
                     lower(trim(regexp_replace(coalesce(building_type, ''), '\s+', ' ', 'g'))),
                     lower(trim(regexp_replace(coalesce(owner_name_raw, ''), '\s+', ' ', 'g'))),
                     lower(trim(regexp_replace(coalesce(owner_mailing_address_raw, ''), '\s+', ' ', 'g')))) as h
          from parcels_snapshot where parcel_id is not null),
    l as (select metro_id, parcel_id, snapshot_date, arg_max(h, retrieved_at) as h from c group by 1, 2, 3),
    n as (select l.*, d.no, d.next_date from l join d using (metro_id, snapshot_date))"""
ORACLE = {
    "p7_found": f"""
        with {_NUMBERED},
        m as (select metro_id, max(no) as last_no from d group by 1)
        select a.metro_id, a.parcel_id, cast(a.snapshot_date as varchar) as snapshot_date, case when b.h is null then 'added' else 'changed' end as change_kind
        from n a left join n b on a.metro_id = b.metro_id and a.parcel_id = b.parcel_id and b.no = a.no - 1
        where a.no > 1 and (b.h is null or a.h <> b.h)
        union all
        select b.metro_id, b.parcel_id, cast(b.next_date as varchar), 'removed'
        from n b join m on b.metro_id = m.metro_id and b.no < m.last_no
        where not exists (select 1 from n a where a.metro_id = b.metro_id and a.parcel_id = b.parcel_id and a.no = b.no + 1)""",
    "p7_intervals": f"""
        with {_NUMBERED},
        s as (select *, case when lag(no) over w = no - 1 and lag(h) over w = h then 0 else 1 end as st from n window w as (partition by metro_id, parcel_id order by no)),
        i as (select *, sum(st) over (partition by metro_id, parcel_id order by no) as island from s)
        select metro_id, parcel_id, cast(min(no) as int) as first_no, cast(max(no) as int) as last_no, min(snapshot_date) as valid_from, arg_max_null(next_date, no) as ended_on
        from i group by metro_id, parcel_id, island""",
}
