"""Traps and closed forms of the reference operators, and every query against its SQL on the smallest tables."""

from __future__ import annotations

import os
from datetime import date

import duckdb
import pytest
from pyspark.sql import functions as F

from tenure.functions import names, scalars
from tenure.operators import evaluation, flow, graph, relational, shares
from tenure.plans import ownership, registry
from tenure.sources import tables
from tenure.streaming import latest


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "clean"), [("Brook & Co., L.L.C.", "BROOK & CO LLC"), ("x limited liability company", "X LLC"), ("A  Trst", "A TRUST"), ("acme Incorporated", "ACME INC"), (None, ""), ("é#1", "1"), ("O'BRIEN", "O BRIEN"), ("A\tB", "A B")])
def test_clean_name(spark, raw, clean):
    assert one(spark, names.clean_name(F.col("v")), v=raw) == clean


def test_name_keys_and_parts(spark):
    c = F.col("v")
    assert one(spark, names.owner_key(c), v="") == "e3b0c44298fc1c14" and one(spark, names.blank_owner_key(c), v="") == ""
    assert one(spark, names.name_parts(c), v="A B / C/ ") == ["A B", "C"] and one(spark, names.primary_name(c), v="") == ""
    assert one(spark, names.is_estate(c), v="A B/EST OF") and not one(spark, names.is_estate(c), v="ESTATE")
    assert one(spark, names.classify(c), v="A LLC TRUST")["owner_class"] == "trust"
    assert one(spark, names.clean_address(c), v="c/o  Bob, 1 Main St.") == "BOB 1 MAIN ST" and one(spark, names.is_care_of(c), v="C/O x")


def test_sql_functions(spark):
    names.register(spark)
    assert spark.sql("select clean_name('Brook & Co., L.L.C.') as a, owner_key('') as b").first() == ("BROOK & CO LLC", "e3b0c44298fc1c14")
    for raw, clean in ownership.NAME_CASES:
        assert spark.sql("select clean_name(:raw) as x", args={"raw": raw}).first()["x"] == clean


def test_name_and_address_cases(spark):
    for i, raw in enumerate(ownership.name_cases(spark, "").orderBy("case_no").collect()):
        assert raw["name"] == ownership.NAME_CASES[i][1]
    assert [(r["address"], r["care_of"]) for r in ownership.address_cases(spark, "").orderBy("case_no").collect()] == [(a, c) for _, a, c in ownership.ADDRESS_CASES]


def test_scalars(spark):
    c = F.col("v")
    assert one(spark, scalars.zero_pad(c, 3), v="1234") == "1234" and one(spark, scalars.zero_pad(c, 3), v="7") == "007"
    assert one(spark, scalars.to_double(c), v="5d") is None and one(spark, scalars.to_whole(c), v=" 12.7 ") == 12
    assert one(spark, scalars.to_date(c), v="2020-02-30") is None and one(spark, scalars.to_date(c), v="1500-01-01") is None
    assert one(spark, scalars.to_date(c), v="2020-02-03T10:00") == date(2020, 2, 3) and one(spark, scalars.date_of_parts(c, F.col("w")), v="2020", w="13") is None
    assert one(spark, scalars.count_of(c), v="Two") == 2 and one(spark, scalars.count_of(c), v="0") is None
    assert one(spark, scalars.join_parts(c, F.col("w")), v=" ", w="x ") == "x" and one(spark, scalars.first_token(c), v=" Doe, Jane") == "DOE"
    assert one(spark, scalars.truthy(c), v=" TRUE") and not one(spark, scalars.truthy(c), v=None) and not one(spark, scalars.truthy(c), v="y")
    assert evaluation.interval_places(1000) == (25, 974) and evaluation.interval_places(1) == (0, 0)


def test_share_table_drops_null_groups_and_guards_zero(spark):
    df = spark.createDataFrame([("a", "llc", 0), (None, "llc", 5), ("b", "corp", 4), ("b", "individual", 12)], "g string, owner_class string, u int")
    rows = {(r["g"], r["owner_class"]): r for r in shares.suppressed(shares.share_table(df, ["g"], "owner_class", "u"), ["unit_share"]).collect()}
    assert set(rows) == {("a", "llc"), ("b", "corp"), ("b", "individual")} and rows["a", "llc"]["unit_share"] is None and rows["a", "llc"]["suppressed"]
    assert rows["b", "corp"]["unit_share"] == 0.25 and not rows["b", "corp"]["suppressed"]
    head = shares.headline_shares(df.limit(0), F.lit(True), "u").collect()
    assert len(head) == 4 and all(r["parcels"] == 0 and r["unit_share"] == 0.0 for r in head)


def test_mix_adds_up(spark):
    a = spark.createDataFrame([("x", 100, 0.3), ("y", 300, 0.1), ("only a", 5, 1.0)], "k string, units long, rate double")
    b = spark.createDataFrame([("x", 300, 0.2), ("y", 100, 0.1)], "k string, units long, rate double")
    r = shares.mix_adjusted(a, b, "k").first()
    assert abs(r["rate_effect"] + r["mix_effect"] - r["gap_common"]) < 1e-12 and r["n_common"] == 2 and r["n_only"] == 1
    assert abs(shares_of(spark, 0.4, 0.97, 0.98) - (0.4 + 0.98 - 1) / (0.97 + 0.98 - 1)) < 1e-12 and shares_of(spark, 0.4, 0.5, 0.5) is None


def shares_of(spark, *v):
    return spark.range(1).select(shares.corrected_share(*[F.lit(x) for x in v]).alias("x")).first()["x"]


def test_flow_null_group_has_no_entities(spark):
    lots = spark.createDataFrame([("d1", "p1", None, 2, True), ("d2", "p2", 2020, 3, True), ("d2", "p3", 2020, 4, True), ("d3", "p4", 2020, 1, None)], "doc_id string, parcel_id string, year int, u int, e boolean")
    rows = {r["year"]: r for r in flow.flow_shares(lots, "doc_id", ["year"], "u", F.col("e")).collect()}
    assert (rows[None]["sales"], rows[None]["entity_sales"]) == (1, 0) and (rows[2020]["units"], rows[2020]["entity_units"], rows[2020]["sale_share"]) == (8, 7, 0.5)


def test_attach_by_billing(spark):
    lots = spark.createDataFrame([("d", "unit"), ("d", "lot"), ("d", "none")], "doc_id string, parcel_id string")
    parcels = spark.createDataFrame([("lot", "sfr"), ("bill", "condo")], "parcel_id string, kind string")
    billing = spark.createDataFrame([("unit", "bill"), ("lot", "bill")], "parcel_id string, billing_id string")
    assert sorted(map(tuple, flow.attach_parcels(lots, parcels, ["kind"], billing).collect())) == [("d", "lot", "sfr"), ("d", "unit", "condo")]


def test_as_of_years(spark):
    deeds = spark.createDataFrame([("p", "a", date(2019, 12, 31)), ("p", "b", date(2021, 12, 31)), ("p", "c", date(2021, 12, 31)), ("q", "d", None)], "p string, d string, r date")
    held = flow.as_of_years(flow.owner_intervals(deeds, "p", "r", ["d"]), "r", 2018, 2022)
    assert sorted((r["year"], r["d"]) for r in held.collect()) == [(2019, "a"), (2020, "a"), (2021, "c"), (2022, "c")]


def test_relational(spark):
    df = spark.createDataFrame([("k", 1, None), ("k", None, "z"), ("k", 1, "a")], "k string, t int, v string")
    assert [tuple(r) for r in relational.latest_per_key(df, ["k"], ["t"]).collect()] == [("k", 1, "a")]
    kept, audit = relational.audited_filter(df, [("t", F.col("t") > 0), ("v", F.col("v") == "a")])
    assert kept.count() == 1 and [tuple(r) for r in audit.orderBy("stage").collect()] == [(1, "t", 3, 2), (2, "v", 2, 1)]
    docs = relational.documents_of(df.withColumn("i", F.lit("")), "k", ["v"], ["t", "v"], {"items": "i"}).first()
    assert docs["items"] == []
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, relational.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_links(spark):
    df = spark.createDataFrame([("a", "s"), ("b", "s"), ("c", "s"), ("d", " "), (None, "s"), ("e", "t")], "m string, s string")
    assert sorted(map(tuple, graph.star_links(df, "m", "s").collect())) == [("a", "b"), ("a", "c")]
    assert {tuple(r) for r in graph.denylist(df, "m", "s", 3, spark.createDataFrame([("t",)], "x string")).collect()} == {("s", 3, "high_degree"), (" ", 1, "blank"), ("t", 1, "seed_agent")}
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(30)] + [("x", "y"), ("y", "x"), ("z", "z")]
    roots = dict(map(tuple, graph.star_components(spark.createDataFrame(chain, "a string, b string")).collect()))
    assert set(roots.values()) == {"n00", "x"} and len(roots) == 33
    assert graph.star_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_evaluation(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("zz", "a"), (None, "b")], "t string, g string")
    matrix = evaluation.confusion(df, "t", "g", ["a", "b", "c"])
    assert matrix.count() == 9 and matrix.agg(F.sum("n")).first()[0] == 3
    scores = {r["label"]: r for r in evaluation.class_scores(matrix).collect()}
    assert abs(scores["a"]["f1"] - 2 / 3) < 1e-12 and scores["c"]["f1"] == 0
    assert abs(evaluation.macro_f1(evaluation.class_scores(matrix)).first()[0] - 2 / 3) < 1e-12
    low, high = evaluation.bootstrap_corrected((90, 10, 180, 20), 0.3)
    assert low <= (0.3 + 0.9 - 1) / (0.9 + 0.9 - 1) <= high
    assert evaluation.leaked_columns(df, ["G", "x"]) == ["g"] and evaluation.is_stable(100, 119) and not evaluation.is_stable(100, 121)


def test_readers(spark, tmp_path):
    (tmp_path / "2020-01-01").mkdir()
    (tmp_path / "2021-01-01").mkdir()
    path = tmp_path / "2020-01-01" / "a.csv"
    path.write_text('Code,Name\n007,""\n008,\n')
    assert tables.newest_extract(spark, str(tmp_path), "a.csv") == str(path)
    df = tables.fold_headers(tables.read_table(spark, str(path)))
    assert [tuple(r) for r in df.collect()] == [("007", ""), ("008", None)] and df.columns == ["code", "name"]
    bare = tmp_path / "b.csv"
    bare.write_text("23,x\n")
    assert tables.read_table(spark, str(bare), ["co_no"], ["CO_NO", "PARCEL"]).first().asDict() == {"CO_NO": "23", "PARCEL": "x"}
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.xls")
    with pytest.raises(ValueError):
        tables.required(df, ["code", "nothing"])
    out = str(tmp_path / "out.csv")
    tables.write_csv(df, out, ["code"], 1)
    assert [tuple(r) for r in tables.read_table(spark, out).collect()] == [("007", ""), ("008", None)]
    assert tables.write_json_document(df.limit(1), str(tmp_path / "d.json"))["code"] == "007"
    store = str(tmp_path / "kv")
    tables.append_store(spark, store, df.withColumn("name", F.lit("old")), ["code"])
    tables.append_store(spark, store, df.withColumn("name", F.lit("new")).limit(1), ["code"])
    assert {r["code"]: r["name"] for r in tables.read_store(spark, store, ["code"]).collect()} == {"007": "new", "008": "old"}
    assert tables.payload(spark.createDataFrame([(float("nan"),)], "x double")).first()[0] == '{"x":null}'
    assert tables.register_tables(spark, {"stock": df}, "nyc") == ["nyc_stock"] and tables.stored(spark, "nyc_stock").count() == 2 and tables.stored(spark, "nothing").count() == 0


def test_paging():
    rows = [{"id": f"{i:02}"} for i in range(7)]
    fetch = lambda last, n: [r for r in rows if last is None or r["id"] > last][:n]
    assert [r for page in tables.keyset_pages(fetch, "id", 3) for r in page] == rows
    assert tables.next_page_size(50, 100, False, True) == 50 and tables.next_page_size(50, 100, False, False) is None and tables.next_page_size(50, 50, True, False) == 50 and tables.next_page_size(0, 50, True, True) is None


def test_streaming(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "t")
    batch = lambda rows: spark.createDataFrame(rows, "k string, at timestamp_ntz, v int").write.mode("append").parquet(source)
    from datetime import datetime

    for rows in ([("a", datetime(2020, 1, 1), 1), ("b", datetime(2020, 1, 1), 1)], [("a", datetime(2020, 1, 3), 3)], [("a", datetime(2020, 1, 2), 2), ("c", datetime(2020, 1, 2), 9)]):
        batch(rows)
        stream = spark.readStream.schema("k string, at timestamp_ntz, v int").parquet(source)
        latest.keep_latest(stream, target, str(tmp_path / "cp"), ["k"], ["at"], 2).awaitTermination()
    assert {r["k"]: r["v"] for r in latest.current(spark, target).collect()} == {"a": 3, "b": 1, "c": 9}
    counts = latest.windowed(spark.readStream.schema("k string, at timestamp_ntz, v int").parquet(source), "at", "1 day", "1 day", ["k"], n=F.count(F.lit(1)))
    counts.writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == 5


def plain(v):
    return "0.0" if v == 0 and isinstance(v, float) else repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, small, name):
    db = duckdb.connect()
    for f in os.listdir(small):
        db.execute(f"create view {f[:-8]} as select * from '{small}/{f}'")
    df = registry.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = db.execute(registry.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(result.description)}
    assert sorted(at) == columns
    assert got == sorted(tuple(plain(r[at[c]]) for c in columns) for r in result.fetchall())
