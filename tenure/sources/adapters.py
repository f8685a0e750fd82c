"""Raw extracts of a metro brought into the canonical tables: joins, casts and schemas; the rules come from the caller."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.functions import names, scalars
from tenure.functions.text import is_blank, strip
from tenure.operators.joins import hot_key_lookup
from tenure.operators.relational import audited_filter, latest_per_key, range_lookup
from tenure.sources.tables import fold_headers, required

# Columns and types of the canonical tables.
PARCELS = {
    "metro_id": "string", "parcel_id": "string", "snapshot_date": "date", "geo_tract": "string", "geo_neighborhood": "string", "geo_borough": "string", "building_type": "string", "res_units": "bigint",
    "owner_name_raw": "string", "owner_mailing_address_raw": "string", "source_dataset": "string", "source_version": "string",
}
TRANSFERS = {
    "metro_id": "string", "doc_id": "string", "recorded_date": "date", "doc_date": "date", "doc_type_raw": "string", "doc_type_canonical": "string", "consideration": "double", "percent_trans": "double", "parcel_ids": "array<string>",
    "source_dataset": "string", "source_version": "string",
}
PARTIES = {"metro_id": "string", "doc_id": "string", "role": "string", "name_raw": "string", "address_raw": "string"}
# end of fixed values


def canonical(df: DataFrame, schema: Mapping[str, str], columns: Mapping[str, Column]) -> DataFrame:
    """The columns of a canonical table in order and type; those not given are null."""
    return df.select(*[(columns[c] if c in columns else F.lit(None)).cast(t).alias(c) for c, t in schema.items()])


def lot_id(borough: Column, block: Column, lot: Column) -> Column:
    """One digit, five and four, zero-padded; "" if a part is no positive whole number or too long."""
    parts = [scalars.to_whole(x) for x in (borough, block, lot)]
    fits = parts[0].between(1, 9) & parts[1].between(1, 99_999) & parts[2].between(1, 9_999)
    padded = [scalars.zero_pad(p.cast("string"), w) for p, w in zip(parts, (1, 5, 4))]
    return F.when(F.coalesce(fits, F.lit(False)), F.concat(*padded)).otherwise("")


def parcels(raw: DataFrame, columns: Mapping[str, Column], cuts: Sequence[tuple[str, Column]], extracts: Sequence[tuple[DataFrame, str, str]] = ()) -> tuple[DataFrame, DataFrame]:
    """(canonical parcels, audit). extracts: (table, raw's column, its key column) of owners, units, flags or geography, attached before the cuts.

    An extract's key may repeat: its greatest row counts. Its columns come as they are named there; clashing
    ones of the extract are dropped. Headers are folded to lower case. Keys may be skewed: tracts with a third of the rows are salted.
    """
    rows = fold_headers(raw)
    for extract, at, key in extracts:
        side = fold_headers(extract)
        new = [c for c in side.columns if c not in rows.columns and c != key]
        single = latest_per_key(side.where(~is_blank(F.col(key))).select(F.col(key).alias("__key"), *new), ["__key"], [])
        rows = hot_key_lookup(rows, at, single, "__key", new)
    kept, audit = audited_filter(rows, cuts) if cuts else (rows, raw.sparkSession.createDataFrame([], "stage int, cut string, rows_in bigint, rows_out bigint"))
    return canonical(kept, PARCELS, columns), audit


def transfers(documents: DataFrame, lots: DataFrame | None, document: str, columns: Mapping[str, Column], version: str | None = None, lot: Column | None = None) -> DataFrame:
    """Canonical transfers: a row per document, as last delivered, with the set of its lots.

    documents may hold a document several times (``version``: the greatest counts). lots holds a row per document
    and lot, repeated over deliveries; blank lots drop out, a document without lots has an empty list. Without
    a table of lots the caller's ``parcel_ids`` stand.
    """
    rows = fold_headers(documents)
    required(rows, [document])
    rows = latest_per_key(rows.where(~is_blank(F.col(document))), [document], [version] if version else [])
    if lots is not None:
        sides = fold_headers(lots).select(F.col(document).alias("__doc"), lot.alias("__lot")).where(~is_blank(F.col("__lot")))
        sets = sides.groupBy("__doc").agg(F.array_sort(F.collect_set("__lot")).alias("__lots"))
        rows = rows.join(sets, F.col(document) == F.col("__doc"), "left")
        columns = {**columns, "parcel_ids": F.coalesce("__lots", F.array().cast("array<string>"))}
    return canonical(rows, TRANSFERS, {"doc_id": F.col(document).cast("string"), **columns})


def parties(raw: DataFrame, document: str, role: Column, name: Column, address: Column, metro: str) -> DataFrame:
    """Canonical parties, each once; rows without a role (other kinds of party) drop out."""
    rows = fold_headers(raw).withColumn("__role", role).where("__role is not null")
    return canonical(rows, PARTIES, {"metro_id": F.lit(metro), "doc_id": F.col(document), "role": F.col("__role"), "name_raw": name, "address_raw": address}).distinct()


def billing_lots(units: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """(parcel_id, billing_id, is_condo_unit) for every distinct lot of units: by its own row of the crosswalk, else by the range that holds it, else itself.

    units: (parcel_id) of ten digits. crosswalk: (parcel_id, billing_id, condo, low, high): lots of one borough and block, low and
    high as lot numbers. Ranges count only for condos. Ids of another shape map to themselves.
    """
    ids = units.select("parcel_id").where(~is_blank(F.col("parcel_id"))).distinct()
    exact = crosswalk.where(~is_blank(F.col("billing_id"))).groupBy("parcel_id").agg(F.min("billing_id").alias("own"), F.bool_or("condo").alias("own_condo"))
    shaped = F.col("parcel_id").rlike(r"^\d{10}$")
    rows = ids.join(exact, "parcel_id", "left").withColumns({"block": F.when(shaped, F.left("parcel_id", F.lit(6))), "lot": F.when(shaped, F.right("parcel_id", F.lit(4)).cast("bigint"))})
    ranges = crosswalk.where("condo and low is not null and high is not null").select(F.left("parcel_id", F.lit(6)).alias("block"), "low", "high", "billing_id")
    found = range_lookup(rows.select("parcel_id", "block", "lot"), ["block"], "lot", ranges, "low", "high", "billing_id").select("parcel_id", F.col("billing_id").alias("ranged"))
    both = rows.join(found, "parcel_id")
    condo = F.when(F.col("own").isNotNull(), F.col("own_condo")).otherwise(F.col("ranged").isNotNull())
    return both.select("parcel_id", F.coalesce("own", "ranged", "parcel_id").alias("billing_id"), (condo & (F.coalesce("own", "ranged") != F.col("parcel_id"))).alias("is_condo_unit"))


def latest_registrations(registrations: DataFrame, number: str, parcel: Column, date: Column) -> DataFrame:
    """(registration_id, parcel_id, registered_on): of each parcel the latest registration; rows without parcel drop out, ties go to the greatest number."""
    rows = fold_headers(registrations).select(F.col(number).alias("registration_id"), parcel.alias("parcel_id"), date.alias("registered_on")).where(~is_blank(F.col("parcel_id")))
    return latest_per_key(rows, ["parcel_id"], ["registered_on", "registration_id"])


def contacts_on_latest(contacts: DataFrame, number: str, latest: DataFrame, person_types: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Contacts of the latest registrations with normal names, keys and the mark of a named person.

    columns: where kind, corporation, first, last, number, street, city, state and zip stand.
    """
    c = {k: F.col(v) for k, v in columns.items()}
    rows = fold_headers(contacts).join(latest.select(F.col("registration_id").alias("__r"), "parcel_id"), F.col(number) == F.col("__r")).drop("__r")
    person = names.clean_name(F.concat_ws(" ", strip(c["first"]), strip(c["last"])))
    corporation = names.clean_name(c["corporation"])
    address = names.clean_address(*[c[k] for k in ("number", "street", "city", "state", "zip")])
    there = ~is_blank(c["first"]) & ~is_blank(c["last"])
    return rows.select(
        F.col(number).alias("registration_id"), "parcel_id", c["kind"].alias("kind"), corporation.alias("corporation_name_normalized"), names.blank_owner_key(names.primary_name(corporation)).alias("corporation_owner_key"), person.alias("person_name_normalized"),
        names.blank_owner_key(person).alias("person_key"), address.alias("address_normalized"), names.address_key(address).alias("address_key"), (c["kind"].isin(*person_types) & there).alias("is_person"),
    )


def registry_matches(registry: DataFrame, name: str, owners: DataFrame) -> DataFrame:
    """The registry's rows whose normal name is an owner's, with owner_key; columns pass through."""
    keyed = fold_headers(registry).withColumn("owner_key", names.blank_owner_key(names.primary_name(names.clean_name(F.col(name)))))
    return keyed.where("owner_key <> ''").join(owners.select("owner_key").distinct(), "owner_key", "left_semi")
