"""Queries over the stock of parcels: shares, mixes, names, and the evaluation of a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.functions import names, scalars
from tenure.operators import evaluation, shares
from tenure.session import table

PLACES = 6
LABELS = ("individual", "trust", "estate", "llc", "corp", "partnership", "unknown")


def _parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "opacity_parcels").distinct()


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, PLACES).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def stock_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(shares.share_table(shares.private_stock(_parcels(spark, sf_dir)), [], "owner_class", "res_units"))


def stock_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(shares.share_table(_parcels(spark, sf_dir), ["building_type"], "owner_class", "res_units"))


def stock_by_geo_type_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = shares.share_table(_parcels(spark, sf_dir), ["geo_neighborhood", "building_type"], "owner_class", "res_units")
    return _rounded(shares.suppressed(cells, ["parcel_share", "unit_share"]))


def stock_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares.all_breakdowns(_parcels(spark, sf_dir), ["metro_id", "building_type", "owner_class"], "res_units")


def stock_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(shares.headline_shares(_parcels(spark, sf_dir), F.col("building_type").isin("sfr_1_4", "condo_unit"), "res_units"))


def corrected_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stock_headlines(spark, sf_dir)
    return _rounded(rows.select("series", "with_trusts", shares.corrected_share(F.col("unit_share"), F.lit(0.9737), F.lit(0.9782)).alias("corrected")))


def stock_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headline shares by series, weight and trusts, raw and corrected for the classifier's errors."""
    return _rounded(shares.sensitivity_cube(stock_headlines(spark, sf_dir), 0.9737, 0.9782, 305))


def mix_adjusted_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standardisation by parcels instead of units."""
    parcels = _parcels(spark, sf_dir)
    sides = [shares.type_rates(parcels.where(F.col("metro_id") == m), "building_type", None) for m in ("nyc", "phl")]
    return _rounded(shares.mix_adjusted(*sides, "building_type"))


def type_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(shares.type_rates(_parcels(spark, sf_dir), "building_type", "res_units"))


def mix_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    parcels = _parcels(spark, sf_dir)
    sides = [shares.type_rates(parcels.where(F.col("metro_id") == m), "building_type", "res_units") for m in ("nyc", "phl")]
    return _rounded(shares.mix_adjusted(*sides, "building_type"))


def neighborhood_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by type rolled up to neighborhoods, suppressed there."""
    cells = shares.share_table(_parcels(spark, sf_dir), ["geo_neighborhood", "building_type"], "owner_class", "res_units")
    entity = shares.is_entity(F.col("owner_class"))
    types = cells.groupBy("geo_neighborhood", "building_type").agg(F.max("parcels").alias("p"), F.max("units").alias("u"), F.sum(F.when(entity, F.col("class_parcels")).otherwise(0)).alias("ep"), F.sum(F.when(entity, F.col("class_units")).otherwise(0)).alias("eu"))
    hoods = types.groupBy("geo_neighborhood").agg(F.sum("p").alias("parcels"), F.sum("u").alias("units"), F.sum("ep").alias("entity_parcels"), F.sum("eu").alias("entity_units"))
    out = hoods.select("*", scalars.ratio(F.col("entity_parcels"), F.col("parcels")).alias("entity_parcel_share"), scalars.ratio(F.col("entity_units"), F.col("units")).alias("entity_unit_share"))
    return _rounded(shares.suppressed(out, ["entity_parcel_share", "entity_unit_share"]))


def top_neighborhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(shares.ranked_bars(neighborhood_rollup(spark, sf_dir), "geo_neighborhood", "entity_unit_share"))


def name_coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighborhoods of an earlier release beside today's, whichever side has them."""
    today = _parcels(spark, sf_dir).groupBy("geo_neighborhood").agg(F.count(F.lit(1)).alias("n_now"))
    before = table(spark, sf_dir, "concentration_by_neighborhood").select("geo_neighborhood", F.col("parcels").alias("n_before"))
    return today.join(before, "geo_neighborhood", "full_outer").withColumn("parcels", F.coalesce("n_now", F.col("n_before").cast("bigint")))


def opacity_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = _parcels(spark, sf_dir).where("opacity_tier is not null")
    return _rounded(shares.share_table(tiers, ["building_type"], "opacity_tier", "res_units"))


def top_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the 20 largest named owners with the neighborhoods they hold, twelve of them at most."""
    held = _parcels(spark, sf_dir).where("trim(owner_key) <> ''").groupBy("owner_key").agg(
        F.count(F.lit(1)).alias("parcels"), F.sum("res_units").alias("units"), F.count_distinct("geo_neighborhood").alias("n_hoods"),
        F.array_join(F.slice(F.array_sort(F.collect_set("geo_neighborhood")), 1, 12), "|").alias("hoods"), (F.count_if(F.col("building_type") == "condo_unit")).alias("condos"),
    )
    return held.orderBy(F.desc("units"), "owner_key").limit(20)


# names

def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "transfer_parties").select("name_raw").unionAll(table(spark, sf_dir, "acris_parties").select(F.col("name").alias("name_raw")))
    return raw.distinct()


def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = names.clean_name(F.col("name_raw"))
    return _written(spark, sf_dir).select("name_raw", clean.alias("name"), names.owner_key(clean).alias("owner_key"), names.blank_owner_key(clean).alias("blank_owner_key"))


def owner_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = names.clean_name(F.col("name_raw"))
    return _written(spark, sf_dir).select("name_raw", names.primary_name(clean).alias("primary_name"), F.size(names.name_parts(clean)).alias("n_parts"), names.is_estate(clean).alias("is_estate"))


def classified_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _written(spark, sf_dir).select(names.classify(names.clean_name(F.col("name_raw"))).alias("c"))
    return rows.groupBy("c.rule_id", "c.owner_class").agg(F.count(F.lit(1)).alias("n"))


def clean_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.col(c) for c in ("address_1", "city", "state", "zip")]
    clean = names.clean_address(*parts)
    return table(spark, sf_dir, "acris_parties").select(*parts).distinct().select(*parts, clean.alias("address"), names.address_key(clean).alias("address_key"), names.is_care_of(*parts).alias("care_of"))


#: Names and addresses as typed, with what the rules make of them, worked out by hand; the SQL gives these results.
NAME_CASES = [
    ("O'BRIEN", "O BRIEN"), ("A\tB", "A B"), ("St.Mary's  Hall,Inc.", "ST MARY S HALL INC"), ("D#1 @ 2", "D 1 2"), ("smith-jones & co/est of", "SMITH-JONES & CO/EST OF"), ("L.L.C", "LLC"), ("Acme L L C", "ACME LLC"), ("Acme, Ltd. Liability Co.", "ACME LLC"),
    ("The Doe Living  Trust", "THE DOE TRUST"), ("Doe Ttee", "DOE TRUSTEE"), ("DOE TR'UST", "DOE TRUST"), ("P.C. Law", "PC LAW"), ("Zoë", "ZO"), ("", ""), (None, ""), ("'", ""),
]
ADDRESS_CASES = [
    ("12-34 Main St.", "12-34 MAIN ST", False), ("C.O. X, 1 Elm", "X 1 ELM", True), ("c/o  Bob, 1 Elm", "BOB 1 ELM", True), ("Care of Bob", "BOB", True), ("COX 1", "COX 1", False), ("C. O. X", "X", False), ("1 O'Dell #4/5", "1 O DELL 4/5", False),
    (" care  of Bob", "BOB", False), ("", "", False), (None, "", False), ("C/O", "", True),
]


def name_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(NAME_CASES)], "case_no int, raw string")
    return rows.select("case_no", names.clean_name(F.col("raw")).alias("name"))


def address_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, raw) for i, (raw, *_) in enumerate(ADDRESS_CASES)], "case_no int, raw string")
    return rows.select("case_no", names.clean_address(F.col("raw")).alias("address"), names.is_care_of(F.col("raw")).alias("care_of"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def first_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir).groupBy(scalars.first_token(F.col("name_raw")).alias("token")).agg(F.count(F.lit(1)).alias("n"))


def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padding, lenient numbers and dates, flags and joined parts over the columns of the parcels."""
    p = table(spark, sf_dir, "parcels_snapshot").select("parcel_id", "snapshot_date", "res_units", "source_version", "geo_tract", "geo_borough").distinct()
    s = F.col
    return p.select(
        "parcel_id", "snapshot_date", "source_version", "res_units", "geo_tract", "geo_borough", scalars.zero_pad(s("res_units").cast("string"), 4).alias("padded"), scalars.to_double(F.concat(s("res_units").cast("string"), F.lit(".70"))).alias("number"), scalars.to_whole(s("source_version")).alias("no_number"),
        scalars.to_date(F.date_format("snapshot_date", "MM/dd/yyyy")).alias("us_date"), scalars.date_of_parts(F.year("snapshot_date").cast("string"), F.month("snapshot_date").cast("string")).alias("month"), scalars.truthy(s("res_units").cast("string")).alias("one_unit"),
        scalars.join_parts(s("geo_tract"), s("geo_borough")).alias("place"), scalars.lookup(F.left("parcel_id", F.lit(1)), {"1": "one", "2": "two"}).alias("digit"),
    )


# evaluation

def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "owners").select("owner_key", F.col("owner_class").alias("truth"), names.classify(F.col("name_normalized")).owner_class.alias("guess"))


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(_judged(spark, sf_dir), "truth", "guess", LABELS)


def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.class_scores(confusion_matrix(spark, sf_dir)))


def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.macro_f1(evaluation.class_scores(confusion_matrix(spark, sf_dir))))


def sens_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.sens_spec(_judged(spark, sf_dir), shares.is_entity(F.col("truth")), shares.is_entity(F.col("guess"))))


def merged_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule classes, and where they leave a name open the table's own class with its confidence as the labeller's."""
    owners = table(spark, sf_dir, "owners").select("owner_key", names.classify(F.col("name_normalized")).owner_class.alias("owner_class"))
    labels = table(spark, sf_dir, "owners").select("owner_key", F.col("owner_class").alias("label"), "confidence")
    return evaluation.merged_labels(owners, "owner_key", "owner_class", labels, [x for x in LABELS if x != "unknown"], 0.5).groupBy("owner_class", "class_source").agg(F.count(F.lit(1)).alias("n"))


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.stratified_sample(table(spark, sf_dir, "owners").select("owner_key", "owner_class"), ["owner_class"], "owner_key", 100)


def split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.halves(table(spark, sf_dir, "owners").select("owner_key", "owner_class"), "owner_class", "owner_key")


def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of the corrected entity share; four counts reach the driver."""
    cells = sens_spec(spark, sf_dir).select("tp", "fn", "tn", "fp").first()
    low, high = evaluation.bootstrap_corrected(tuple(cells), 0.154)
    return spark.createDataFrame([(0.154, low, high)], "observed double, low double, high double")


QUERIES = {
    f.__name__: f
    for f in (
        stock_by_class, stock_by_type, stock_by_geo_type_suppressed, stock_grouping_sets, stock_headlines, corrected_headlines, stock_sensitivity, type_rates, mix_adjusted, mix_adjusted_parcels, neighborhood_rollup, top_neighborhoods, name_coalesced, opacity_by_type, top_owners,
        clean_names, owner_parts, classified_counts, clean_addresses, name_cases, address_cases, first_tokens, scalar_functions, confusion_matrix, class_scores, macro_f1, sens_spec, merged_labels, stratified_sample, split_assign, bootstrap_interval,
    )
}

# SQL

_P = "p as (select distinct * from opacity_parcels)"
_ENTITY = "coalesce({} in ('llc', 'corp', 'partnership'), false)"


def _shares_sql(groups: list[str], member: str, rows: str = "p") -> str:
    by = ", ".join(groups)
    lead = by + ", " if by else ""
    known = " and ".join(f"{g} is not null" for g in groups) or "true"
    join = f"using ({by})" if by else "on true"
    return f"""c as (select {lead}{member}, count(*) as class_parcels, cast(coalesce(sum(res_units), 0) as bigint) as class_units from {rows} where {known} group by {lead}{member}),
        t as (select {lead}cast(sum(class_parcels) as bigint) as parcels, cast(sum(class_units) as bigint) as units from c {'group by ' + by if by else ''}),
        s as (select {lead}{member}, class_parcels, class_units, parcels, units, round(class_parcels * 1e0 / nullif(parcels, 0), 6) as parcel_share, round(class_units * 1e0 / nullif(units, 0), 6) as unit_share from c join t {join})"""


_ROLL = f"""with {_P},
    h as (select geo_neighborhood, count(*) as parcels, cast(coalesce(sum(res_units), 0) as bigint) as units, count(*) filter (where {_ENTITY.format('owner_class')}) as entity_parcels,
                 cast(coalesce(sum(res_units) filter (where {_ENTITY.format('owner_class')}), 0) as bigint) as entity_units
          from p where geo_neighborhood is not null and building_type is not null group by 1),
    r as (select *, case when units >= 10 then round(entity_parcels * 1e0 / nullif(parcels, 0), 6) end as entity_parcel_share, case when units >= 10 then round(entity_units * 1e0 / nullif(units, 0), 6) end as entity_unit_share, units < 10 as suppressed from h)"""
_HEAD = f"""with {_P},
    b as (select * from (values ('all', false), ('all', true), ('informative', false), ('informative', true)) v(series, with_trusts)),
    x as (select series, with_trusts, coalesce(res_units, 0) as u, coalesce(owner_class in ('llc', 'corp', 'partnership'), false) or (with_trusts and coalesce(owner_class = 'trust', false)) as e
          from b left join p on series = 'all' or building_type in ('sfr_1_4', 'condo_unit')),
    h as (select series, with_trusts, count(*) as parcels, cast(sum(u) as bigint) as units, count(*) filter (where e) as entity_parcels, cast(coalesce(sum(u) filter (where e), 0) as bigint) as entity_units from x group by 1, 2)"""
_RATES = "select building_type, cast(sum(coalesce(res_units, 0)) as bigint) as units, cast(coalesce(sum(res_units) filter (where owner_class in ('llc', 'corp', 'partnership')), 0) as bigint) as entity_units from p {} group by 1"
_COUNTS = "select building_type, count(*) as units, count(*) filter (where owner_class in ('llc', 'corp', 'partnership')) as entity_units from p {} group by 1"
_MIX = """j as (select a.units as ua, b.units as ub, a.entity_units * 1e0 / nullif(a.units, 0) as ra, b.entity_units * 1e0 / nullif(b.units, 0) as rb, a.building_type is not null and b.building_type is not null as c from a full outer join b using (building_type)),
        t as (select count(*) filter (where c) as n_common, count(*) filter (where not c) as n_only, sum(ua) filter (where c) as wa, sum(ub) filter (where c) as wb, sum(ua * coalesce(ra, 0)) filter (where c) as aa, sum(ub * coalesce(rb, 0)) filter (where c) as bb, sum(ua * coalesce(rb, 0)) filter (where c) as ab from j),
        r as (select n_common, n_only, aa / nullif(wa, 0) as x, bb / nullif(wb, 0) as y, ab / nullif(wa, 0) as z from t)
        select n_common, n_only, round(x, 6) as reference_rate, round(y, 6) as other_rate, round(z, 6) as other_on_reference_mix, round(x - y, 6) as gap_common, round(x - z, 6) as rate_effect, round(z - y, 6) as mix_effect, case when abs(z - y) >= abs(x - z) then 'mix' else 'rate' end as dominant from r"""
_CLEAN = r"trim(regexp_replace(regexp_replace(upper(coalesce({}, '')), '[^A-Z0-9&/ -]', ' ', 'g'), '\s+', ' ', 'g'))"
_JOINED = "upper(concat_ws(' ', {}))"
_SQUEEZED = r"trim(regexp_replace(regexp_replace({}, '[^A-Z0-9/ -]', ' ', 'g'), '\s+', ' ', 'g'))"


def clean_address_sql(*columns: str) -> str:
    joined = _JOINED.format(", ".join(f"nullif(trim({c}), '')" for c in columns))
    return rf"trim(regexp_replace({_SQUEEZED.format(joined)}, '^(C/O|C O|CARE OF)\b', ''))"


def care_of_sql(*columns: str) -> str:
    joined = _JOINED.format(", ".join(f"nullif(trim({c}), '')" for c in columns))
    return rf"regexp_matches(replace({joined}, '.', ' '), '^(C/O|C O|CARE OF)\b')"


def _clean_sql(column: str) -> str:
    sql = _CLEAN.format(column)
    for pattern, written in names.NAME_PHRASES:
        sql = f"regexp_replace({sql}, '{pattern}', '{written}', 'g')"
    return rf"trim(regexp_replace({sql}, '\s+', ' ', 'g'))"


_W = f"w as (select distinct name_raw from (select name_raw from transfer_parties union all select name from acris_parties)), k as (select name_raw, {_clean_sql('name_raw')} as name from w)"
_PARTS = r"list_filter(list_transform(regexp_split_to_array(name, '\s*/\s*'), lambda x: trim(x)), lambda x: x <> '')"
_ESTATE = f"len(list_intersect({_PARTS}[2:], ['LWT', 'DEF', 'EST', 'ESTATE', 'EST OF', 'ESTATE OF'])) > 0"
_CASE = "case when " + _ESTATE + " then '{parts}' " + " ".join(f"when regexp_matches(coalesce({_PARTS}[1], ''), '{p}') then '{{{r}}}'" for r, _, p in [(r, c, p.replace("{1,4}", "{{1,4}}")) for r, c, p in names.RULES]) + " else '{none}' end"
_RULE = _CASE.format(parts="estate_part", none="none", **{r: r for r, _, _ in names.RULES})
_CLASS = _CASE.format(parts="estate", none="unknown", **{r: c for r, c, _ in names.RULES})
_J = f"j as (select owner_key, owner_class as truth, {_CLASS} as guess from (select *, name_normalized as name from owners))"
_LABELS = ", ".join(f"('{x}')" for x in LABELS)
_M = f"""{_J}, l as (select * from (values {_LABELS}) v(label)),
    m as (select a.label as truth, b.label as guess, count(j.owner_key) as n from l a cross join l b left join j on j.truth = a.label and j.guess = b.label group by 1, 2)"""
_F1 = """f as (select l.label, cast(coalesce((select sum(n) from m where truth = label), 0) as bigint) as support, cast(coalesce((select sum(n) from m where guess = label), 0) as bigint) as g, cast(coalesce((select sum(n) from m where guess = label and truth = label), 0) as bigint) as hit from l),
    q as (select label, support, coalesce(hit * 1e0 / nullif(g, 0), 0) as precision, coalesce(hit * 1e0 / nullif(support, 0), 0) as recall, coalesce(2 * hit * 1e0 / nullif(support + g, 0), 0) as f1 from f)"""
ORACLE = {
    "stock_by_class": f"with {_P}, q as (select * from p where owner_class not in ('public', 'nonprofit_religious')), {_shares_sql([], 'owner_class', 'q')} select * from s",
    "stock_by_type": f"with {_P}, {_shares_sql(['building_type'], 'owner_class')} select * from s",
    "stock_by_geo_type_suppressed": f"""with {_P}, {_shares_sql(['geo_neighborhood', 'building_type'], 'owner_class')}
        select * replace (case when units >= 10 then parcel_share end as parcel_share, case when units >= 10 then unit_share end as unit_share), units < 10 as suppressed from s""",
    "stock_grouping_sets": f"""with {_P} select cast(grouping(metro_id, building_type, owner_class) as bigint) as breakdown, metro_id, building_type, owner_class, count(*) as parcels, cast(coalesce(sum(res_units), 0) as bigint) as units
        from p group by grouping sets ((metro_id), (building_type), (owner_class), ())""",
    "stock_headlines": f"{_HEAD} select *, round(coalesce(entity_parcels * 1e0 / nullif(parcels, 0), 0), 6) as parcel_share, round(coalesce(entity_units * 1e0 / nullif(units, 0), 0), 6) as unit_share from h",
    "corrected_headlines": f"{_HEAD} select series, with_trusts, round((round(coalesce(entity_units * 1e0 / nullif(units, 0), 0), 6) + 0.9782e0 - 1e0) / (0.9737e0 + 0.9782e0 - 1e0), 6) as corrected from h",
    "stock_sensitivity": f"""{_HEAD}, w as (select *, unnest(['parcel', 'unit']) as weight from h), z as (select series, with_trusts as include_trust, parcels, units, entity_parcels, entity_units, weight,
            round(coalesce(case weight when 'parcel' then entity_parcels * 1e0 / nullif(parcels, 0) else entity_units * 1e0 / nullif(units, 0) end, 0), 6) as raw from w)
        select *, case when not include_trust then round((raw + 0.9782e0 - 1e0) / (0.9737e0 + 0.9782e0 - 1e0), 6) end as corrected, case when not include_trust then cast(305 as int) end as n_labeled from z""",
    "type_rates": f"with {_P}, r as ({_RATES.format('')}) select building_type, units, entity_units, round(coalesce(entity_units * 1e0 / nullif(units, 0), 0), 6) as rate, round(coalesce(units * 1e0 / nullif(sum(units) over (), 0), 0), 6) as weight from r",
    "mix_adjusted": f"""with {_P}, a as ({_RATES.format("where metro_id = 'nyc'")}), b as ({_RATES.format("where metro_id = 'phl'")}), {_MIX}""",
    "mix_adjusted_parcels": f"""with {_P}, a as ({_COUNTS.format("where metro_id = 'nyc'")}), b as ({_COUNTS.format("where metro_id = 'phl'")}), {_MIX}""",
    "neighborhood_rollup": f"{_ROLL} select * from r",
    "top_neighborhoods": f"{_ROLL}, t as (select geo_neighborhood, entity_unit_share from r where not suppressed and entity_unit_share is not null order by 2 desc, 1 limit 12) select *, round(coalesce(entity_unit_share / nullif(max(entity_unit_share) over (), 0), 0), 6) as width from t",
    "name_coalesced": f"with {_P}, a as (select geo_neighborhood, count(*) as n_now from p group by 1), b as (select geo_neighborhood, parcels as n_before from concentration_by_neighborhood) select geo_neighborhood, n_now, n_before, coalesce(n_now, cast(n_before as bigint)) as parcels from a full outer join b using (geo_neighborhood)",
    "opacity_by_type": f"with {_P}, q as (select * from p where opacity_tier is not null), {_shares_sql(['building_type'], 'opacity_tier', 'q')} select * from s",
    "top_owners": f"""with {_P} select owner_key, count(*) as parcels, cast(sum(res_units) as bigint) as units, count(distinct geo_neighborhood) as n_hoods,
        array_to_string(list_sort(list_distinct(list(geo_neighborhood)))[1:12], '|') as hoods, count(*) filter (where building_type = 'condo_unit') as condos from p where trim(owner_key) <> '' group by 1 order by units desc, owner_key limit 20""",
    "clean_names": f"with {_W} select name_raw, name, left(sha256(name), 16) as owner_key, case when name = '' then '' else left(sha256(name), 16) end as blank_owner_key from k",
    "owner_parts": f"with {_W} select name_raw, coalesce({_PARTS}[1], '') as primary_name, cast(len({_PARTS}) as int) as n_parts, {_ESTATE} as is_estate from k",
    "classified_counts": f"with {_W} select {_RULE} as rule_id, {_CLASS} as owner_class, count(*) as n from k group by 1, 2",
    "clean_addresses": f"""with d as (select distinct address_1, city, state, zip from acris_parties),
        c as (select *, {clean_address_sql('address_1', 'city', 'state', 'zip')} as address, {care_of_sql('address_1', 'city', 'state', 'zip')} as care_of from d)
        select address_1, city, state, zip, address, case when address = '' then '' else left(sha256(address), 16) end as address_key, care_of from c""",
    "name_cases": "select * from (values " + ", ".join(f"({i}, {_quoted(want)})" for i, (_, want) in enumerate(NAME_CASES)) + ") v(case_no, name)",
    "address_cases": "select * from (values " + ", ".join(f"({i}, {_quoted(want)}, {care})" for i, (_, want, care) in enumerate(ADDRESS_CASES)) + ") v(case_no, address, care_of)",
    "first_tokens": rf"with {_W} select split_part(trim(regexp_replace(upper(coalesce(name_raw, '')), '[,\s]+', ' ', 'g')), ' ', 1) as token, count(*) as n from w group by 1",
    "scalar_functions": r"""with d as (select distinct parcel_id, snapshot_date, res_units, source_version, geo_tract, geo_borough from parcels_snapshot)
        select *, case when length(cast(res_units as varchar)) >= 4 then cast(res_units as varchar) else lpad(cast(res_units as varchar), 4, '0') end as padded, res_units + 0.7e0 as number, cast(null as bigint) as no_number, snapshot_date as us_date,
               cast(date_trunc('month', snapshot_date) as date) as month, coalesce(res_units = 1, false) as one_unit, nullif(concat_ws(', ', nullif(trim(geo_tract), ''), nullif(trim(geo_borough), '')), '') as place,
               case left(parcel_id, 1) when '1' then 'one' when '2' then 'two' end as digit from d""",
    "confusion_matrix": f"with {_M} select * from m",
    "class_scores": f"with {_M}, {_F1} select label, support, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from q",
    "macro_f1": f"with {_M}, {_F1} select round(coalesce(avg(f1) filter (where support > 0), 0), 6) as macro_f1 from q",
    "sens_spec": f"""with {_J}, e as (select {_ENTITY.format('truth')} as t, {_ENTITY.format('guess')} as g from j), c as (select count(*) filter (where t and g) as tp, count(*) filter (where t and not g) as fn, count(*) filter (where not t and not g) as tn, count(*) filter (where not t and g) as fp from e)
        select *, round(coalesce(tp * 1e0 / nullif(tp + fn, 0), 0), 6) as sensitivity, round(coalesce(tn * 1e0 / nullif(tn + fp, 0), 0), 6) as specificity from c""",
    "merged_labels": f"""with g as (select *, {_CLASS} as guess from (select *, name_normalized as name from owners)), m as (select *, guess = 'unknown' and coalesce(owner_class in ('individual', 'trust', 'estate', 'llc', 'corp', 'partnership') and confidence >= 0.5, false) as t from g)
        select case when t then owner_class else guess end as owner_class, case when t then 'model' else 'rules' end as class_source, count(*) as n from m group by 1, 2""",
    "stratified_sample": """with q as (select owner_class, greatest(1, floor(count(*) * 100e0 / (select count(*) from owners) + 0.5)) as quota from owners group by 1),
        r as (select owner_key, owner_class, row_number() over (partition by owner_class order by sha256('s' || owner_key), owner_key) as n from owners) select owner_key, owner_class from r join q using (owner_class) where n <= quota""",
    "split_assign": "select owner_key, owner_class, case when ntile(2) over (partition by owner_class order by sha256('s' || owner_key), owner_key) = 1 then 'dev' else 'test' end as split from owners",
}


