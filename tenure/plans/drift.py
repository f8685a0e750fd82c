"""Problem 6: transfer files whose fields drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.sources.drift import ingested_changes, replay, rescue
from tenure.session import checkpoint, table

TARGET = {"doc_id": "string", "recorded_date": "date", "doc_type_raw": "string", "consideration": "double", "percent_trans": "double", "parcel_ids": "array<string>"}
#: Fields approved for promotion, per column of transfers.
APPROVED = {
    "doc_id": ("string", ["document_id"]),
    "recorded_date": ("date", ["recorded_on", "recording_date", "recorded_datetime"]),
    "doc_type_raw": ("string", ["doc_type", "docType", "DOC_TYPE", "deed_code", "instrument_kind"]),
    "consideration": ("double", ["Consideration", "amt", "document_amt", "sale_price", "total_consideration"]),
    "percent_trans": ("double", ["pct_interest"]),
}


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of a feed's fields, read from the ingested table: typed columns, _rescued and _kinds."""
    return ingested_changes(checkpoint(rescue(table(spark, sf_dir, "transfer_extract"), "payload", TARGET)), TARGET)


def p6_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the feeds once, as last delivered, in the shape of transfers."""
    lines = table(spark, sf_dir, "transfer_extract")
    typed = replay(rescue(lines, "payload", TARGET), APPROVED)
    # the last delivery as one state per document; told apart after the aggregate, so that no filter repeats the parsing
    state = ["file_no", "line_no", "recorded_date", "doc_type_raw", "consideration", "percent_trans", "parcel_ids"]
    last = typed.groupBy("feed", "doc_id").agg(F.max(F.struct(*state)).alias("s"), F.max(F.col("doc_id").isNotNull()).alias("known"))
    rows = last.where("known").select("feed", "doc_id", "s.*")
    return rows.select(
        F.substring_index("feed", "_", 1).alias("metro_id"), "doc_id", "recorded_date", "doc_type_raw", "consideration", "percent_trans", F.array_join("parcel_ids", ";").alias("parcel_ids"), F.col("feed").alias("source_dataset"), F.col("file_no").cast("string").alias("source_version")
    )


def p6_rescued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What p6_table leaves out, per line: fields that no column took, unreadable text, lines without document id."""
    typed = replay(rescue(table(spark, sf_dir, "transfer_extract"), "payload", TARGET), APPROVED)
    kept = checkpoint(typed.select("feed", "file_no", "line_no", F.col("_rescued").alias("rescued"), F.col("_unreadable").alias("unreadable"), F.col("doc_id").isNull().alias("no_document")))
    return kept.where("rescued is not null or unreadable is not null or no_document")


QUERIES = {"p6_found": p6_found, "p6_table": p6_table, "p6_rescued": p6_rescued}


def _first(names: list[str]) -> str:
    return "coalesce(" + ", ".join(f"json_extract_string(payload, '$.{n}')" for n in names) + ")"


_NUMBER = "try_cast(replace(replace({}, '$', ''), ',', '') as double)"
_CODE = f"case when {_first(['doc_type_raw', *APPROVED['doc_type_raw'][1]])} like '{{%' then json_extract_string({_first(['doc_type_raw', *APPROVED['doc_type_raw'][1]])}, '$.code') else {_first(['doc_type_raw', *APPROVED['doc_type_raw'][1]])} end"
_CHANGES = r"""
    with l as (select feed, cast(file_no as bigint) as file_no, payload, json_keys(payload) as ks from transfer_extract where feed is not null and file_no is not null and json_valid(payload) and json_type(payload) = 'OBJECT'),
    u as (select distinct feed, file_no, payload, unnest(ks) as k from l where len(ks) = len(list_distinct(ks))),
    x as (select feed, file_no, k, json_extract_string(payload, '$.document_id') as doc, json_type(payload, '$."' || k || '"') as ty, json_extract(payload, '$."' || k || '"') as v, json_extract_string(payload, '$."' || k || '"') as raw from u),
    y as (select feed, file_no, k, doc, case when ty = 'VARCHAR' then 'string' when ty in ('BIGINT', 'UBIGINT', 'HUGEINT') then 'integer' when ty = 'DOUBLE' then 'decimal' when ty = 'BOOLEAN' then 'boolean' when ty = 'ARRAY' then 'list' when ty = 'OBJECT' then 'object' end as kind,
          lower(trim(regexp_replace(case ty when 'ARRAY' then array_to_string(json_extract_string(v, '$[*]'), ';') when 'OBJECT' then coalesce(json_extract_string(v, '$.code'), array_to_string(json_extract_string(v, '$.*'), ';')) else raw end, '\s+', ' ', 'g'))) as s from x),
    p as (select *, case when regexp_full_match(s, '[$€£]?\s?-?(\d{1,3}(,\d{3})+|\d+)(\.\d*)?') then cast(cast(regexp_replace(s, '[$€£, ]', '', 'g') as double) as varchar)
          when regexp_full_match(s, '\d{1,2}/\d{1,2}/\d{4}') then strftime(strptime(s, '%m/%d/%Y'), '%Y-%m-%d') when regexp_full_match(s, '\d{4}-\d\d-\d\d[t ]00:00(:00(\.0+)?)?z?') then left(s, 10) else nullif(regexp_replace(s, '\s*[;|]\s*', ';', 'g'), '') end as plain from y),
    h as (select feed, file_no, k, list_sort(list_distinct(list(kind) filter (where kind is not null))) as ks from y group by 1, 2, 3),
    n as (select feed, file_no, k, nullif(array_to_string(list_filter(coalesce(ks, []), lambda z: z <> 'integer' or not list_contains(ks, 'decimal')), '+'), '') as kind from h),
    st as (select distinct a.feed, a.file_no from n a join n b on a.feed = b.feed and b.file_no = a.file_no - 1),
    j as (select st.feed, st.file_no, k, kb, kn, bef, now from st join (select coalesce(a.feed, b.feed) as feed, coalesce(a.file_no, b.file_no + 1) as file_no, coalesce(a.k, b.k) as k, b.kind as kb, a.kind as kn, b.k is not null as bef, a.k is not null as now
          from n a full outer join n b on a.feed = b.feed and a.file_no = b.file_no + 1 and a.k = b.k) q on st.feed = q.feed and st.file_no = q.file_no),
    d as (select feed, file_no, doc, k, max(plain) as plain from p where doc is not null and plain is not null group by 1, 2, 3, 4),
    ag as (select o.feed, o.file_no, o.k as ok, w.k as nk, count(*) as compared, count(*) filter (where x.plain = z.plain) as agreed from j o join j w on o.feed = w.feed and o.file_no = w.file_no and o.bef and not o.now and w.now and not w.bef
          join d x on x.feed = o.feed and x.file_no = o.file_no - 1 and x.k = o.k join d z on z.feed = w.feed and z.file_no = w.file_no and z.k = w.k and z.doc = x.doc group by 1, 2, 3, 4),
    rk as (select *, row_number() over (partition by feed, file_no, ok order by agreed desc, ok, nk) as a, row_number() over (partition by feed, file_no, nk order by agreed desc, ok, nk) as b from ag where agreed >= 0.9 * compared),
    rn as (select feed, file_no, ok, nk from rk where a = 1 and b = 1)
    select feed, file_no, 'renamed' as change_kind, ok as field_name, nk as new_field_name from rn
    union all select feed, file_no, 'removed', k, '' from j where bef and not now and (feed, file_no, k) not in (select feed, file_no, ok from rn)
    union all select feed, file_no, 'added', k, '' from j where now and not bef and (feed, file_no, k) not in (select feed, file_no, nk from rn)
    union all select feed, file_no, 'type_changed', k, '' from j where now and bef and kb <> kn
    union all select rn.feed, rn.file_no, 'type_changed', nk, '' from rn join j o on o.feed = rn.feed and o.file_no = rn.file_no and o.k = ok join j w on w.feed = rn.feed and w.file_no = rn.file_no and w.k = nk where o.kb <> w.kn"""
ORACLE = {
    "p6_found": _CHANGES,
    "p6_table": f"""
        with r as (select feed, file_no, line_no, json_extract_string(payload, '$.document_id') as doc_id,
                          try_cast({_first(APPROVED['recorded_date'][1])} as date) as recorded_date, {_CODE} as doc_type_raw,
                          {_NUMBER.format(_first(['consideration', *APPROVED['consideration'][1]]))} as consideration,
                          {_NUMBER.format(_first(['percent_trans', 'pct_interest']))} as percent_trans,
                          json_extract_string(payload, '$.parcel_ids') as ids
                   from (select * from transfer_extract where json_valid(payload) and payload like '{{%')),
        n as (select *, row_number() over (partition by feed, doc_id order by file_no desc, line_no desc) as n from r where doc_id is not null)
        select split_part(feed, '_', 1) as metro_id, doc_id, recorded_date, doc_type_raw, consideration, percent_trans,
               case when ids like '[%' then array_to_string(from_json(ids, '["VARCHAR"]'), ';') else ids end as parcel_ids,
               feed as source_dataset, cast(file_no as varchar) as source_version from n where n = 1""",
}
