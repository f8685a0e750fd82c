"""Queries of the problems for language-model data, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.llm import addresses, components, contamination, mixing, names, truncation
from tenure.session import checkpoint, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.cluster_ids(table(spark, sf_dir, "owners"), "owner_key", table(spark, sf_dir, "owner_link"), "owner_key_a", "owner_key_b")


def p2_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many owners each group holds."""
    return p2_found(spark, sf_dir).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_owners"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.pairs_of_groups(names.variant_groups(table(spark, sf_dir, "owners"), "owner_key", "name_normalized"), "owner_key", "group_id")


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every owner with the smallest key of its group of spellings."""
    groups = names.variant_groups(table(spark, sf_dir, "owners"), "owner_key", "name_normalized")
    smallest = groups.groupBy("group_id").agg(F.min("owner_key").alias("entity_key"))
    return groups.join(smallest, "group_id").select("owner_key", "entity_key")


def _locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.locations(table(spark, sf_dir, "address_register"), "address_id", "address_raw", "city", "state", "zip")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.pairs_of_groups(_locations(spark, sf_dir), "address_id", "location_id")


def p5_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry with the smallest entry of its location."""
    found = _locations(spark, sf_dir)
    return found.join(found.groupBy("location_id").agg(F.min("address_id").alias("location")), "location_id").select("address_id", "location")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest match of every leak and where it stands."""
    return _leaks(spark, sf_dir)


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus without the documents that leak an item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return contamination.without_leaks(docs, "doc_id", _leaks(spark, sf_dir))


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    counted = mixing.counted_documents(table(spark, sf_dir, "documents"), "doc_id", "source", "text")
    plan = mixing.plan_mixture(counted, "source", table(spark, sf_dir, "source_weights"))
    return mixing.draw(counted, "doc_id", "source", plan), plan


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn, plan = _mixture(spark, sf_dir)
    return mixing.reached(drawn, "source", plan)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.find_truncated(table(spark, sf_dir, "documents"), "doc_id", "source", "text").where("truncated").select("doc_id")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    limits = checkpoint(truncation.storage_limits(docs, "source", "text"))
    return truncation.truncation_rates(truncation.find_truncated(docs, "doc_id", "source", "text", limits), "source", limits)


QUERIES = {"p2_found": p2_found, "p2_sizes": p2_sizes, "p3_found": p3_found, "p3_groups": p3_groups, "p5_found": p5_found, "p5_locations": p5_locations, "p8_found": p8_found, "p8_longest": p8_longest, "p8_clean": p8_clean, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p10_found": p10_found, "p10_rates": p10_rates}

_CLUSTERS = """
    with recursive e as (select owner_key_a as a, owner_key_b as b from owner_link where trim(coalesce(owner_key_a, '')) <> '' and trim(coalesce(owner_key_b, '')) <> '' and owner_key_a <> owner_key_b),
    s as (select a, b from e union select b, a from e),
    r(k, c) as (select distinct owner_key, owner_key from owners union select s.b, r.c from r join s on s.a = r.k),
    g as (select k as owner_key, min(c) as cluster_id from r where k in (select owner_key from owners) group by k)"""
# runs of twelve words in common, with words hyphenated at line breaks joined and, for compounds, apart
_LEAKS = r"""
    with t as (select 'd' as kind, cast(doc_id as bigint) as id, text from documents where text is not null union all select 'i', cast(item_id as bigint), text from eval_items where text is not null),
    c as (select kind, id, replace(replace(replace(regexp_replace(regexp_replace(text, '</?(br|p|div|li|ul|ol|tr|td|th|table|h[1-6]|hr)\b[^<>]*>', ' ', 'gi'), '</?[A-Za-z][^<>]*>', '', 'g'), '&amp;', '&'), '&quot;', '"'), '&#39;', '''') as s from t),
    v as (select kind, id, regexp_extract_all(lower(regexp_replace(s, '([\p{L}\p{N}])[-‐‑][ \t]*(\r\n|\r|\n)\s*([\p{L}\p{N}])', '\1\3', 'g')), '[\p{L}\p{N}]+') as w from c
          union all select kind, id, regexp_extract_all(lower(s), '[\p{L}\p{N}]+') from c),
    g as (select kind, id, array_to_string(w[i : i + 11], ' ') as gram from (select kind, id, w, unnest(range(1, len(w) - 10)) as i from v where len(w) >= 12))
    select distinct d.id as doc_id, i.id as item_id from (select distinct id, gram from g where kind = 'd') d join (select distinct id, gram from g where kind = 'i') i using (gram)"""
ORACLE = {
    "p2_found": f"{_CLUSTERS} select owner_key, cluster_id from g",
    "p2_sizes": f"{_CLUSTERS} select cluster_id, count(*) as n_owners from g group by cluster_id",
    "p8_found": _LEAKS,
    "p8_clean": f"select doc_id, source, n_chars from documents where doc_id is null or doc_id not in (select doc_id from ({_LEAKS}))",
}
