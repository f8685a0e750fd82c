"""Problem 1: results per key where a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.operators import skew
from tenure.session import table

#: A key value is heavy if it holds this share of all rows.
HEAVY = 0.03
#: Secondary order of opacity_parcels, by which a heavy key is split.
ORDER = ["metro_id", "parcel_id"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "opacity_parcels")
    found = [skew.heavy_keys(rows, field, ORDER, HEAVY).select(F.lit(field).alias("field_name"), "key_value") for field in ("geo_neighborhood", "owner_key")]
    return found[0].unionByName(found[1])


def p1_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures = skew.concentration(table(spark, sf_dir, "opacity_parcels"))
    return figures.select(*[F.round(c, 6).alias(c) if c.startswith(("hhi", "top")) else F.col(c) for c in figures.columns])


def p1_owner_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.key_totals(table(spark, sf_dir, "opacity_parcels"), "owner_key", ORDER, "res_units")


QUERIES = {"p1_found": p1_found, "p1_concentration": p1_concentration, "p1_owner_totals": p1_owner_totals}

_SHARES = ",\n".join(
    f"case when units >= 10 then round(case when {whole} = 0 then 0 else {value} * 1e0 / {whole} end, 6) end as {name}"
    for name, value, whole in [
        ("hhi_parcels", "sq_n", "(parcels * parcels)"),
        ("hhi_units", "sq_u", "(units * units)"),
        *[(f"top{k}_parcel_share", f"top{k}_n", "parcels") for k in (5, 10, 20)],
        *[(f"top{k}_unit_share", f"top{k}_u", "units") for k in (5, 10, 20)],
    ]
)
_TOPS = ", ".join(f"coalesce(sum({x}) filter (where r{x} <= {k}), 0) as top{k}_{x}" for k in (5, 10, 20) for x in ("n", "u"))
ORACLE = {
    "p1_found": """
        with n as (select count(*) as n_all from opacity_parcels),
        c as (select 'geo_neighborhood' as field_name, geo_neighborhood as key_value, count(*) as n from opacity_parcels group by 2
              union all select 'owner_key', owner_key, count(*) from opacity_parcels group by 2)
        select field_name, key_value from c, n where trim(coalesce(key_value, '')) <> '' and c.n >= 0.03 * n_all""",
    "p1_concentration": f"""
        with o as (select case when trim(coalesce(geo_neighborhood, '')) = '' then '' else geo_neighborhood end as hood,
                          case when trim(coalesce(owner_key, '')) = '' then '_blank:' || coalesce(parcel_id, '') else owner_key end as owner,
                          count(*) as n, cast(sum(coalesce(res_units, 0)) as bigint) as u
                   from opacity_parcels group by 1, 2),
        r as (select *, row_number() over (partition by hood order by n desc, owner) as rn, row_number() over (partition by hood order by u desc, owner) as ru from o),
        s as (select hood, cast(sum(n) as double) as parcels, cast(sum(u) as double) as units, count(*) as n_name_keys,
                     sum(n * n * 1e0) as sq_n, sum(u * u * 1e0) as sq_u, {_TOPS} from r group by hood)
        select hood as geo_neighborhood, parcels, units, n_name_keys, {_SHARES}, units < 10 as suppressed from s""",
    "p1_owner_totals": "select owner_key, count(*) as parcels, cast(sum(coalesce(res_units, 0)) as bigint) as units from opacity_parcels group by 1",
}
