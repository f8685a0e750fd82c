"""Queries over transfers, links and the driver's star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.functions import names
from tenure.functions.text import is_blank
from tenure.operators import flow, graph, relational, shares
from tenure.operators.joins import hot_key_lookup
from tenure.session import table

PLACES = 6


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, PLACES).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def latest_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parties as last delivered."""
    rows = table(spark, sf_dir, "acris_parties")
    return relational.latest_per_key(rows, ["document_id", "party_type", "name", "address_1"], ["good_through_date"])


def primary_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.least_named(table(spark, sf_dir, "transfer_parties"), "doc_id", "role", "name_raw", {"grantee": "grantee", "grantor": "grantor"})


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; a delivered copy adds nothing."""
    rows = table(spark, sf_dir, "transfers")
    return relational.latest_per_key(rows, ["doc_id"], ["source_version", "recorded_date"])


def document_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items grouped into orders: attributes of the first line, all parts and suppliers."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate", F.col("l_partkey").cast("string").alias("part"), F.col("l_suppkey").cast("string").alias("supplier"))
    docs = relational.documents_of(lines, "l_orderkey", ["l_returnflag", "l_shipdate"], ["l_linenumber", "l_shipdate", "part"], {"parts": "part", "suppliers": "supplier"})
    return docs.select("l_orderkey", "l_returnflag", F.to_date("l_shipdate").alias("shipped"), F.array_join("parts", "|").alias("parts"), F.array_join("suppliers", "|").alias("suppliers"))


def exploded_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.exploded_items(_documents(spark, sf_dir).select("doc_id", "metro_id", "parcel_ids"), "parcel_ids", "parcel_id")


def unit_to_billing_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part in the range of keys of its brand and size class."""
    part = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size")
    ranges = part.groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("low"), F.max("p_partkey").alias("high"))
    return relational.range_lookup(part.select("p_brand", "p_partkey"), ["p_brand"], "p_partkey", ranges, "low", "high", "p_size")


def sale_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows before and after each cut, from one pass."""
    cuts = [("sale_deed", F.col("doc_type_canonical") == "sale_deed"), ("recorded", F.col("recorded_date").isNotNull()), ("with_amount", F.col("consideration") > 0), ("with_lots", F.size("parcel_ids") > 0)]
    return relational.audited_filter(_documents(spark, sf_dir), cuts)[1]


def sensitivity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same count under several settings: the settings are a few broadcast rows, the table is scanned once."""
    settings = spark.createDataFrame([("all", -1.0, True), ("positive", 0.01, False), ("above_10k", 10000.0, False), ("above_10k_or_missing", 10000.0, True)], "config string, least double, missing boolean")
    docs = _documents(spark, sf_dir).select("metro_id", "consideration")
    kept = docs.join(F.broadcast(settings), F.when(F.col("consideration").isNull(), F.col("missing")).otherwise(F.col("consideration") >= F.col("least")))
    return _rounded(kept.groupBy("config", "metro_id").agg(F.count(F.lit(1)).alias("documents"), F.sum("consideration").alias("amount")))


def _stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "opacity_parcels").select("parcel_id", "building_type", "res_units", "geo_neighborhood")
    return relational.latest_per_key(rows, ["parcel_id"], ["building_type", "res_units"])


def _attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).where("recorded_date is not null").select("doc_id", "recorded_date", "parcel_ids")
    buyers = primary_parties(spark, sf_dir).select("doc_id", "grantee")
    clean = names.primary_name(names.clean_name(F.col("grantee")))
    owners = table(spark, sf_dir, "owners").select("owner_key", "owner_class")
    buyers = buyers.where("grantee is not null").select("doc_id", names.owner_key(clean).alias("owner_key")).join(owners, "owner_key").select("doc_id", "owner_class")
    lots = relational.exploded_items(docs, "parcel_ids", "parcel_id").join(buyers, "doc_id", "left")
    return flow.attach_parcels(lots.withColumn("year", F.year("recorded_date")), _stock(spark, sf_dir), ["building_type", "res_units", "geo_neighborhood"])


def attached_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attached(spark, sf_dir).select("doc_id", "parcel_id", "year", "owner_class", "building_type", "res_units", "geo_neighborhood")


def flow_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(flow.flow_shares(_attached(spark, sf_dir), "doc_id", ["year"], "res_units", shares.is_entity(F.col("owner_class"))))


def flow_by_year_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(flow.flow_shares(_attached(spark, sf_dir), "doc_id", ["year", "building_type"], "res_units", shares.is_entity(F.col("owner_class"))))


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    deeds = _attached(spark, sf_dir).where("owner_class is not null")
    return flow.owner_intervals(deeds, "parcel_id", "recorded_date", ["doc_id"])


def owner_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who held each parcel at each year's end, rebuilt from its deeds."""
    return flow.as_of_years(_intervals(spark, sf_dir), "recorded_date", 2018, 2024).select("parcel_id", "year", "doc_id", "owner_class")


def history_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stock as it stood at each year's end, rebuilt from deeds: entity shares, those of houses and condos, coverage."""
    held = flow.as_of_years(_intervals(spark, sf_dir), "recorded_date", 2018, 2024).where("building_type is not null")
    owner_class = F.col("owner_class")
    return _rounded(flow.history_shares(held, _stock(spark, sf_dir).count(), range(2018, 2025), F.col("building_type").isin("sfr_1_4", "condo_unit"), shares.is_entity(owner_class), ~owner_class.isin(*shares.EXCLUDED), "res_units"))


def consistency_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the last rebuilt owner has the class of the stock, by type."""
    last = _intervals(spark, sf_dir).where("until is null").select("parcel_id", F.col("owner_class").alias("rebuilt"))
    stock = relational.latest_per_key(table(spark, sf_dir, "opacity_parcels").select("parcel_id", "building_type", "owner_class"), ["parcel_id"], ["building_type", "owner_class"])
    both = stock.join(last, "parcel_id")
    return _rounded(both.groupBy("building_type").agg(F.count(F.lit(1)).alias("compared"), F.count_if(F.col("owner_class") == F.col("rebuilt")).alias("agree")).withColumn("rate", F.col("agree") / F.col("compared")))


def order_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders numbered from the dearest."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (-F.col("o_totalprice")).alias("place"))
    return relational.row_index(orders, ["place", "o_orderkey"]).select("o_orderkey", "row_no")


def sources_by_metro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest version and all datasets of each metro's transfers."""
    return relational.value_summary(table(spark, sf_dir, "transfers"), ["metro_id"], "source_version", "source_dataset")


# joins and sets

def semi_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "metro_id")
    return docs.join(table(spark, sf_dir, "transfer_parties").select("doc_id"), "doc_id", "left_semi")


def anti_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "metro_id")
    return docs.join(table(spark, sf_dir, "transfer_parties").select("doc_id"), "doc_id", "left_anti")


def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "transfer_parties").select("doc_id", F.col("name_raw").alias("name"), "role")
    b = table(spark, sf_dir, "acris_parties").select(F.col("document_id").alias("doc_id"), "name", "zip")
    return relational.union_by_name(a, b).groupBy("role", F.col("zip").isNull().alias("no_zip")).agg(F.count(F.lit(1)).alias("n"))


def intersect_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "transfer_parties").select(F.col("name_raw").alias("name")).intersect(table(spark, sf_dir, "acris_parties").select("name"))


def except_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "transfer_parties").select(F.col("name_raw").alias("name")).exceptAll(table(spark, sf_dir, "acris_parties").select("name")).distinct()


def upserted_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key-value store written twice: parts, then the dearest line of each part as its price."""
    old = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("value"))
    new = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.max("l_extendedprice").alias("value"))
    return _rounded(relational.upsert(old, new, ["key"]))


# links

def _contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "acris_parties").where(~is_blank(F.col("name")) & F.col("address_1").isNotNull())
    return rows.select(names.owner_key(names.clean_name(F.col("name"))).alias("owner_key"), names.clean_address(F.col("address_1"), F.col("zip")).alias("address"))


def star_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.star_links(_contacts(spark, sf_dir), "owner_key", "address")


def address_degree_denylist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.denylist(_contacts(spark, sf_dir), "owner_key", "address", 4)


def key_pair_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.key_pairs(table(spark, sf_dir, "owner_link"), "owner_key_a", "owner_key_b")


def link_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.star_components(key_pair_links(spark, sf_dir))


def link_component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.component_sizes(link_components(spark, sf_dir))


# the link graph of the entities, from contacts to clusters

#: An address shared by so many owners is an agent's.
AGENT_DEGREE = 4


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entity_nodes(table(spark, sf_dir, "owners"), "owner_key", "name_normalized", "owner_class", shares.ENTITY)


def _entity_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, owner_key, address, role) of the parties that are entities."""
    rows = table(spark, sf_dir, "acris_parties").where(~is_blank(F.col("name")))
    key = names.owner_key(names.primary_name(names.clean_name(F.col("name"))))
    contacts = rows.select("document_id", key.alias("owner_key"), names.clean_address(F.col("address_1"), F.col("zip")).alias("address"), F.col("party_type").alias("role"), names.primary_name(names.clean_name(F.col("name"))).alias("name"))
    return contacts.distinct()


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(owner_key, person): entities with the individuals of the same document."""
    owners = table(spark, sf_dir, "owners").select("owner_key", "owner_class")
    contacts = _entity_contacts(spark, sf_dir).join(owners, "owner_key")
    entities = contacts.where(shares.is_entity(F.col("owner_class"))).select("document_id", "owner_key")
    people = contacts.where("owner_class = 'individual'").select("document_id", F.col("name").alias("person"))
    return entities.join(people, "document_id").select("owner_key", "person").distinct()


def entity_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir)


def _address_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    contacts = _entity_contacts(spark, sf_dir).join(_nodes(spark, sf_dir).select("owner_key"), "owner_key", "left_semi")
    return graph.address_links(contacts, "owner_key", "address", "address", AGENT_DEGREE)


def address_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links over addresses, those of agents taken out before."""
    return _address_links(spark, sf_dir)[0]


def denied_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _address_links(spark, sf_dir)[1]


def person_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.typed_links(_people(spark, sf_dir), "owner_key", "person", "person", "person")


def all_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = key_pair_links(spark, sf_dir).select("a", "b", F.lit("key_pair").alias("link_type"), F.col("b").alias("evidence"))
    return graph.concat_links(address_links(spark, sf_dir), person_links(spark, sf_dir), pairs)


def entity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.link_graph(_nodes(spark, sf_dir), all_links(spark, sf_dir))


def owner_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _people(spark, sf_dir).select("owner_key", F.lit("").alias("address"), F.lit("").alias("role"), "person")
    contacts = _entity_contacts(spark, sf_dir).select("owner_key", "address", "role", F.lit("").alias("person")).distinct()
    return graph.owner_evidence(_nodes(spark, sf_dir), contacts.unionByName(people), denied_addresses(spark, sf_dir))


def parcels_by_cluster_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels with the size of their owner's cluster attached, counted by tier; owners that are no entity have none."""
    parcels = table(spark, sf_dir, "opacity_parcels").select("owner_key", "opacity_tier", "res_units")
    sized = hot_key_lookup(parcels, "owner_key", entity_clusters(spark, sf_dir).select("owner_key", "members"), "owner_key", ["members"])
    size = F.when(F.col("members") == 1, "alone").when(F.col("members") > 1, "linked").otherwise("no entity")
    return sized.groupBy("opacity_tier", size.alias("cluster")).agg(F.count(F.lit(1)).alias("parcels"), F.sum("res_units").alias("units"))


# the star schema

def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return _rounded(lines.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(net), 2).alias("revenue"), F.avg("l_discount").alias("avg_disc"), F.count(F.lit(1)).alias("n")))


def nation_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders, customer, nation, region = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return joined.groupBy("r_name", "n_name").agg(revenue.alias("revenue"), F.count_distinct("o_orderkey").alias("orders"))


def events_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.latest_per_key(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"])


def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = table(spark, sf_dir, "events").groupBy(F.date_trunc("HOUR", "ts").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return windows.withColumn("hour", F.col("hour").cast("string"))


QUERIES = {
    f.__name__: f
    for f in (
        latest_parties, primary_parties, document_grouping, exploded_lots, unit_to_billing_range_join, sale_filter_audit, sensitivity_table, attached_lots, flow_by_year, flow_by_year_type, owner_as_of, history_by_year, consistency_by_type, order_index, sources_by_metro,
        semi_match, anti_unmatched, union_by_name, intersect_names, except_names, upserted_prices, star_links, address_degree_denylist, key_pair_links, link_components, link_component_sizes, entity_nodes, address_links, denied_addresses, person_links, all_links, entity_clusters, owner_evidence, parcels_by_cluster_size, pricing_summary, nation_revenue, events_latest, events_hourly,
    )
}

# SQL

from tenure.plans.ownership import _clean_sql, clean_address_sql  # noqa: E402

_D = """d as (select * from (select *, row_number() over (partition by doc_id order by source_version desc nulls last, recorded_date desc nulls last, metro_id desc nulls last, doc_date desc nulls last, doc_type_raw desc nulls last, doc_type_canonical desc nulls last,
        consideration desc nulls last, percent_trans desc nulls last, parcel_ids desc nulls last, source_dataset desc nulls last) as rn from transfers) where rn = 1)"""
_PP = "pp as (select doc_id, min(name_raw) filter (where role = 'grantee' and trim(coalesce(name_raw, '')) <> '') as grantee, min(name_raw) filter (where role = 'grantor' and trim(coalesce(name_raw, '')) <> '') as grantor from transfer_parties group by 1)"
_ST = "st as (select * from (select parcel_id, building_type, res_units, geo_neighborhood, row_number() over (partition by parcel_id order by building_type desc nulls last, res_units desc nulls last, geo_neighborhood desc nulls last) as rn from opacity_parcels) where rn = 1)"
_A = f"""{_D}, {_PP}, {_ST},
    k as (select doc_id, {_clean_sql('grantee')} as name from pp where grantee is not null),
    b as (select doc_id, owner_class from k join owners o on o.owner_key = left(sha256(trim(coalesce(list_filter(regexp_split_to_array(name, '\\s*/\\s*'), lambda x: trim(x) <> '')[1], ''))), 16)),
    l as (select distinct doc_id, recorded_date, unnest(parcel_ids) as parcel_id from d where recorded_date is not null),
    a as (select l.doc_id, l.parcel_id, recorded_date, cast(year(recorded_date) as int) as year, owner_class, building_type, res_units, geo_neighborhood from l join st using (parcel_id) left join b using (doc_id) where l.parcel_id <> ''),
    i as (select *, lead(recorded_date) over (partition by parcel_id order by recorded_date, doc_id) as until from a where owner_class is not null),
    y as (select i.*, cast(t.y as int) as ye from i, (select unnest(range(2018, 2025)) as y) t where year(recorded_date) <= t.y and (until is null or t.y < year(until)))"""
_E = "coalesce(owner_class in ('llc', 'corp', 'partnership'), false)"


def _flow_sql(groups: str) -> str:
    first = ", ".join(f"arg_min(a.{g}, (parcel_id)) as {g}" if g != "year" else "min(a.year) as year" for g in groups.split(", "))
    known = " and ".join(f"{g} is not null" for g in groups.split(", "))
    return f"""with {_A}, f as (select doc_id, {first}, sum(res_units) as units, bool_or({_E}) as entity from a group by 1),
        t as (select {groups}, count(*) as sales, cast(coalesce(sum(units), 0) as bigint) as units, count(*) filter (where entity and {known}) as entity_sales, cast(coalesce(sum(units) filter (where entity and {known}), 0) as bigint) as entity_units from f group by {groups})
        select *, round(entity_sales * 1e0 / nullif(sales, 0), 6) as sale_share, round(entity_units * 1e0 / nullif(units, 0), 6) as unit_share from t"""


_CO = rf"co as (select left(sha256({_clean_sql('name')}), 16) as owner_key, {clean_address_sql('address_1', 'zip')} as address from acris_parties where trim(coalesce(name, '')) <> '' and address_1 is not null)"
_KP = "e as (select distinct least(owner_key_a, owner_key_b) as a, greatest(owner_key_a, owner_key_b) as b from owner_link where trim(coalesce(owner_key_a, '')) <> '' and trim(coalesce(owner_key_b, '')) <> '' and owner_key_a <> owner_key_b)"
_CC = f"with recursive {_KP}, s as (select a, b from e union select b, a from e), r(k, c) as (select a, a from s union select s.b, r.c from r join s on s.a = r.k), g as (select k as node, min(c) as root from r group by k)"
_N = "n as (select distinct owner_key, name_normalized as name, owner_class from owners where owner_class in ('llc', 'corp', 'partnership') and trim(coalesce(owner_key, '')) <> '')"
_FIRST = "trim(coalesce(list_filter(regexp_split_to_array({}, '\\s*/\\s*'), lambda x: trim(x) <> '')[1], ''))"
_CT = f"""ct as (select document_id, left(sha256({_FIRST.format('clean')}), 16) as owner_key, address, party_type, {_FIRST.format('clean')} as name
    from (select document_id, {_clean_sql('name')} as clean, {clean_address_sql('address_1', 'zip')} as address, party_type from acris_parties where trim(coalesce(name, '')) <> ''))"""
_AL = f"""{_N}, {_CT}, ca as (select distinct owner_key, address from ct where address <> '' and owner_key in (select owner_key from n)), dg as (select address, count(*) as degree from ca group by 1),
    ok as (select * from ca where address in (select address from dg where degree < 4)), hu as (select address, min(owner_key) as a from ok group by 1),
    al as (select a, owner_key as b, 'address' as link_type, min(address) as evidence from ok join hu using (address) where owner_key <> a group by 1, 2)"""
_PL = f"""{_AL}, pe as (select distinct e.owner_key, p.name as person from (select ct.* from ct join owners o using (owner_key) where o.owner_class in ('llc', 'corp', 'partnership')) e
        join (select ct.* from ct join owners o using (owner_key) where o.owner_class = 'individual') p on e.document_id = p.document_id),
    ph as (select person, min(owner_key) as a from pe where trim(person) <> '' group by 1), pl as (select a, owner_key as b, 'person' as link_type, min(person) as evidence from pe join ph using (person) where owner_key <> a group by 1, 2)"""
_LINKS = f"""{_PL}, {_KP}, lr as (select * from al union all select * from pl union all select a, b, 'key_pair', b from e),
    ln as (select least(a, b) as a, greatest(a, b) as b, link_type, min(evidence) as evidence from lr where a <> b group by 1, 2, 3)"""
_GRAPH = """s as (select a, b from ln union select b, a from ln), r(k, c) as (select a, a from s union select s.b, r.c from r join s on s.a = r.k), g as (select k, min(c) as root from r group by k),
    me as (select distinct n.owner_key, coalesce(root, n.owner_key) as cluster from n left join g on g.k = n.owner_key), cl as (select owner_key, cluster, count(*) over (partition by cluster) as members from me)"""
ORACLE = {
    "latest_parties": "select document_id, record_type, party_type, name, address_1, city, state, zip, good_through_date from (select *, row_number() over (partition by document_id, party_type, name, address_1 order by good_through_date desc nulls last, record_type desc nulls last, city desc nulls last, state desc nulls last, zip desc nulls last) as rn from acris_parties) where rn = 1",
    "primary_parties": f"with {_PP} select * from pp",
    "document_grouping": """select l_orderkey, arg_min(l_returnflag, (l_linenumber, l_shipdate, cast(l_partkey as varchar))) as l_returnflag, cast(arg_min(l_shipdate, (l_linenumber, l_shipdate, cast(l_partkey as varchar))) as date) as shipped,
        array_to_string(list_sort(list_distinct(list(cast(l_partkey as varchar)))), '|') as parts, array_to_string(list_sort(list_distinct(list(cast(l_suppkey as varchar)))), '|') as suppliers from lineitem group by 1""",
    "exploded_lots": f"with {_D} select distinct doc_id, metro_id, parcel_id from (select doc_id, metro_id, unnest(parcel_ids) as parcel_id from d) where parcel_id <> ''",
    "unit_to_billing_range_join": "with r as (select p_brand, p_size, min(p_partkey) as low, max(p_partkey) as high from part group by 1, 2) select p.p_brand, p.p_partkey, min(r.p_size) as p_size from part p left join r on r.p_brand = p.p_brand and p.p_partkey between r.low and r.high group by 1, 2",
    "sale_filter_audit": f"""with {_D}, c as (select coalesce(doc_type_canonical = 'sale_deed', false) as a, recorded_date is not null as b, coalesce(consideration > 0, false) as c, coalesce(len(parcel_ids) > 0, false) as e from d),
        n as (select count(*) as n0, count(*) filter (where a) as n1, count(*) filter (where a and b) as n2, count(*) filter (where a and b and c) as n3, count(*) filter (where a and b and c and e) as n4 from c)
        select cast(1 as int) as stage, 'sale_deed' as cut, n0 as rows_in, n1 as rows_out from n union all select 2, 'recorded', n1, n2 from n union all select 3, 'with_amount', n2, n3 from n union all select 4, 'with_lots', n3, n4 from n""",
    "sensitivity_table": f"""with {_D}, s as (select * from (values ('all', -1e0, true), ('positive', 0.01e0, false), ('above_10k', 1e4, false), ('above_10k_or_missing', 1e4, true)) v(config, least_, missing))
        select config, metro_id, count(*) as documents, round(sum(consideration), 6) as amount from d, s where case when consideration is null then missing else consideration >= least_ end group by 1, 2""",
    "attached_lots": f"with {_A} select doc_id, parcel_id, year, owner_class, building_type, res_units, geo_neighborhood from a",
    "flow_by_year": _flow_sql("year"),
    "flow_by_year_type": _flow_sql("year, building_type"),
    "owner_as_of": f"with {_A} select parcel_id, ye as year, doc_id, owner_class from y",
    "history_by_year": f"""with {_A}, h as (select *, owner_class not in ('public', 'nonprofit_religious') as p, building_type in ('sfr_1_4', 'condo_unit') as s, {_E} as e from y where building_type is not null),
        t as (select ye, count(*) as covered, count(*) filter (where p) as parcels, cast(coalesce(sum(res_units) filter (where p), 0) as bigint) as units, count(*) filter (where p and e) as entity_parcels, cast(coalesce(sum(res_units) filter (where p and e), 0) as bigint) as entity_units,
              count(*) filter (where p and s) as sfr_condo_parcels, cast(coalesce(sum(res_units) filter (where p and s), 0) as bigint) as sfr_condo_units, cast(coalesce(sum(res_units) filter (where p and s and e), 0) as bigint) as su from h group by 1)
        select cast(v.y as int) as year, coalesce(parcels, 0) as parcels, coalesce(units, 0) as units, coalesce(entity_parcels, 0) as entity_parcels, coalesce(entity_units, 0) as entity_units, round(coalesce(entity_parcels * 1e0 / nullif(parcels, 0), 0), 6) as parcel_share,
               round(coalesce(entity_units * 1e0 / nullif(units, 0), 0), 6) as unit_share, coalesce(sfr_condo_parcels, 0) as sfr_condo_parcels, coalesce(sfr_condo_units, 0) as sfr_condo_units, round(coalesce(su * 1e0 / nullif(sfr_condo_units, 0), 0), 6) as sfr_condo_entity_unit_share,
               round(coalesce(covered * 1e0 / (select count(*) from st), 0), 6) as coverage_parcels from (select unnest(range(2018, 2025)) as y) v left join t on t.ye = v.y""",
    "consistency_by_type": f"""with {_A}, o as (select * from (select parcel_id, building_type, owner_class, row_number() over (partition by parcel_id order by building_type desc nulls last, owner_class desc nulls last) as rn from opacity_parcels) where rn = 1)
        select o.building_type, count(*) as compared, count(*) filter (where o.owner_class = i.owner_class) as agree, round(count(*) filter (where o.owner_class = i.owner_class) * 1e0 / count(*), 6) as rate from o join i on i.parcel_id = o.parcel_id and i.until is null group by 1""",
    "order_index": "select o_orderkey, row_number() over (order by -o_totalprice, o_orderkey) - 1 as row_no from orders",
    "sources_by_metro": "select metro_id, max(source_version) filter (where trim(source_version) <> '') as source_version, array_to_string(list_sort(list_distinct(list(source_dataset) filter (where trim(source_dataset) <> ''))), '|') as source_dataset from transfers group by 1",
    "semi_match": f"with {_D} select doc_id, metro_id from d where doc_id in (select doc_id from transfer_parties)",
    "anti_unmatched": f"with {_D} select doc_id, metro_id from d where doc_id not in (select doc_id from transfer_parties)",
    "union_by_name": "select role, zip is null as no_zip, count(*) as n from (select doc_id, name_raw as name, role, null as zip from transfer_parties union all select document_id, name, null, zip from acris_parties) group by 1, 2",
    "intersect_names": "select name_raw as name from transfer_parties intersect select name from acris_parties",
    "except_names": "select distinct name from (select name_raw as name from transfer_parties except all select name from acris_parties)",
    "upserted_prices": "with n as (select l_partkey as key, max(l_extendedprice) as value from lineitem group by 1) select key, round(coalesce(n.value, o.value), 6) as value from n full outer join (select p_partkey as key, p_retailprice as value from part) o using (key)",
    "star_links": f"with {_CO}, r as (select distinct owner_key as m, address as s from co where address <> ''), h as (select s, min(m) as a from r group by 1) select distinct a, m as b from r join h using (s) where m <> a",
    "address_degree_denylist": f"with {_CO}, g as (select address as shared, count(distinct owner_key) as degree from co group by 1) select shared, degree, case when degree >= 4 then 'high_degree' else 'blank' end as reason from g where degree >= 4 or trim(shared) = ''",
    "key_pair_links": f"with {_KP} select a, b from e",
    "link_components": f"{_CC} select node, root from g",
    "link_component_sizes": f"{_CC} select root, count(*) as members from g group by 1",
    "entity_nodes": f"with {_N} select * from n",
    "address_links": f"with {_AL} select * from al",
    "denied_addresses": f"with {_AL} select address as shared, degree, 'high_degree' as reason from dg where degree >= 4",
    "person_links": f"with {_PL} select * from pl",
    "all_links": f"with {_LINKS} select * from ln",
    "entity_clusters": f"with recursive {_LINKS}, {_GRAPH} select owner_key, cluster, members from cl",
    "owner_evidence": f"""with {_LINKS}, dn as (select address from dg where degree >= 4), ad as (select distinct owner_key, address, party_type from ct),
        ev as (select owner_key, count(*) filter (where address <> '') as addresses, count(*) filter (where address in (select address from dn)) as denied_addresses, array_to_string(list_sort(list_distinct(list(party_type) filter (where trim(coalesce(party_type, '')) <> ''))), '|') as roles from ad group by 1)
        select n.owner_key, coalesce(addresses, 0) as addresses, coalesce(denied_addresses, 0) as denied_addresses, n.owner_key in (select owner_key from pe) as has_person, coalesce(roles, '') as roles, coalesce(addresses, 0) = coalesce(denied_addresses, 0) as agent_only
        from (select distinct owner_key from n) n left join ev using (owner_key)""",
    "parcels_by_cluster_size": f"""with recursive {_LINKS}, {_GRAPH} select opacity_tier, case when members = 1 then 'alone' when members > 1 then 'linked' else 'no entity' end as cluster, count(*) as parcels, cast(sum(res_units) as bigint) as units
        from opacity_parcels p left join cl using (owner_key) group by 1, 2""",
    "pricing_summary": "select l_returnflag, l_linestatus, round(sum(l_quantity), 6) as sum_qty, round(round(sum(l_extendedprice * (1 - l_discount)), 2), 6) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2",
    "nation_revenue": "select r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(distinct o_orderkey) as orders from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2",
    "events_latest": "select user_id, ts, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc nulls last, event_id desc nulls last, event_type desc nulls last) as rn from events) where rn = 1",
    "events_hourly": "select cast(date_trunc('hour', ts) as varchar) as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
}
