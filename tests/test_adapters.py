"""Adapters, link graph, cube and manifest on rows of our own in the shapes of raw extracts."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tenure.functions import scalars
from tenure.functions.text import strip_of
from tenure.operators import evaluation, graph, joins, relational, shares
from tenure.sources import adapters, files, manifest, tables

C = F.col


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_parcels_with_extracts(spark):
    raw = spark.createDataFrame([("1", "10", "2", "A1", "3", "T1"), ("1", "10", "3", "V0", "0", "T2"), ("1", "10", "4", "A1", "x", None)], "BoroCode string, block string, lot string, class string, units string, tract string")
    tracts = spark.createDataFrame([("T1", "N1", "clash"), ("T1", "N0", "clash"), (None, "N9", "x")], "TractKey string, nta string, CLASS string")
    owners = spark.createDataFrame([("2", "ACME LLC"), ("3", None)], "lotno string, owner string")
    flags = [("residential", C("class").startswith("A"))]
    columns = {"metro_id": F.lit("nyc"), "parcel_id": adapters.lot_id(C("borocode"), C("block"), C("lot")), "snapshot_date": F.lit(date(2024, 1, 1)), "geo_neighborhood": C("nta"), "res_units": scalars.to_whole(C("units")), "owner_name_raw": C("owner")}
    got, audit = adapters.parcels(raw, columns, flags, [(tracts, "tract", "tractkey"), (owners, "lot", "lotno")])
    assert got.columns == list(adapters.PARCELS) and dict(got.dtypes)["res_units"] == "bigint"
    assert rows(got, "parcel_id", "geo_neighborhood", "res_units", "owner_name_raw") == [("1000100002", "N1", 3, "ACME LLC"), ("1000100004", None, None, None)]
    assert rows(audit, "cut", "rows_in", "rows_out") == [("residential", 3, 2)]
    empty, _ = adapters.parcels(raw.limit(0), columns, [], [(tracts, "tract", "tractkey"), (owners, "lot", "lotno")])
    assert empty.count() == 0


@pytest.mark.parametrize(("parts", "made"), [(("1", "20", "1001"), "1000201001"), (("1.0", "20", "1"), "1000200001"), (("0", "20", "1"), ""), (("1", "100000", "1"), ""), ((None, "1", "1"), ""), (("x", "1", "1"), "")])
def test_lot_id(spark, parts, made):
    df = spark.createDataFrame([parts], "a string, b string, c string")
    assert df.select(adapters.lot_id(C("a"), C("b"), C("c")).alias("x")).first()["x"] == made


def test_transfers_and_parties(spark):
    master = spark.createDataFrame([("D1", "DEED", "500", "2020-01-02T00:00:00", "1"), ("D1", "DEED", "600", "2020-01-02T00:00:00", "2"), ("D2", " MTGE ", "x", "1500-01-01", "1"), (None, "DEED", "1", None, "1")], "Document_ID string, doc_type string, amt string, recorded string, good string")
    legals = spark.createDataFrame([("D1", "1", "10", "2"), ("D1", "1", "10", "2"), ("D1", "1", "10", "1"), ("D1", "x", "10", "1")], "document_id string, borough string, block string, lot string")
    got = adapters.transfers(master, legals, "document_id", {"recorded_date": scalars.to_date(C("recorded")), "consideration": scalars.to_double(C("amt")), "doc_type_raw": F.trim("doc_type")}, "good", adapters.lot_id(C("borough"), C("block"), C("lot")))
    assert got.columns == list(adapters.TRANSFERS)
    assert rows(got, "doc_id", "consideration", "recorded_date", "parcel_ids") == [("D1", 600.0, date(2020, 1, 2), ["1000100001", "1000100002"]), ("D2", None, None, [])]
    with pytest.raises(ValueError):
        adapters.transfers(master.drop("Document_ID"), None, "document_id", {})
    people = spark.createDataFrame([("D1", "1", "ANN"), ("D1", "1", "ANN"), ("D1", "2", "BOB"), ("D1", "3", "X")], "document_id string, party_type string, name string")
    role = F.when(C("party_type") == "1", "grantor").when(C("party_type") == "2", "grantee")
    assert rows(adapters.parties(people, "document_id", role, C("name"), F.lit(None), "nyc"), "role", "name_raw") == [("grantee", "BOB"), ("grantor", "ANN")]


def test_billing_lots(spark):
    crosswalk = spark.createDataFrame([("1000207501", "1000207501", True, 1001, 1200), ("1000010001", "1000010001", False, 1, 1), ("1000301001", "1000307502", True, None, None), ("1000407501", "1000407501", False, 1, 9000)], "parcel_id string, billing_id string, condo boolean, low bigint, high bigint")
    units = spark.createDataFrame([("1000201101",), ("1000201101",), ("1000201201",), ("1000010001",), ("1000301001",), ("1000400005",), ("odd",), (None,)], "parcel_id string")
    assert rows(adapters.billing_lots(units, crosswalk), "parcel_id", "billing_id", "is_condo_unit") == [
        ("1000010001", "1000010001", False), ("1000201101", "1000207501", True), ("1000201201", "1000201201", False), ("1000301001", "1000307502", True), ("1000400005", "1000400005", False), ("odd", "odd", False)
    ]


def test_range_lookup_equals_brute_force(spark):
    import random

    rng = random.Random(4)
    ranges = [(rng.choice("ab"), a := rng.randrange(300), a + rng.choice([0, 1, 7, 100, 2**40]), rng.randrange(99)) for _ in range(60)] + [("a", 9, 3, 0), ("a", None, 5, 0), ("b", -3, 5, 0)]
    values = [(k, v) for k in "abc" for v in [*range(0, 420, 3), 2**40, -1]] + [("a", None)]
    left, right = spark.createDataFrame(values, "k string, v bigint"), spark.createDataFrame(ranges, "k string, lo bigint, hi bigint, p int")
    got = {(r["k"], r["v"]): r["p"] for r in relational.range_lookup(left, ["k"], "v", right, "lo", "hi", "p").collect()}
    want = {(k, v): min((p for kk, lo, hi, p in ranges if v is not None and v >= 0 and kk == k and lo is not None and 0 <= lo <= v <= hi), default=None) for k, v in values}
    assert got == want
    assert relational.range_lookup(left, ["k"], "v", right.limit(0), "lo", "hi", "p").where("p is not null").count() == 0


def test_registrations_and_registry(spark):
    registrations = spark.createDataFrame([("100", "3", "1", "1", "2019-01-01"), ("101", "3", "1", "1", "2021-01-01"), ("102", "0", "1", "1", "2022-01-01")], "RegistrationID string, boro string, block string, lot string, d string")
    latest = adapters.latest_registrations(registrations, "registrationid", adapters.lot_id(C("boro"), C("block"), C("lot")), scalars.to_date(C("d")))
    assert rows(latest, "registration_id", "parcel_id") == [("101", "3000010001")]
    columns = {k: k for k in ("kind", "corporation", "first", "last", "number", "street", "city", "state", "zip")}
    contacts = spark.createDataFrame([("101", "HeadOfficer", "Acme L.L.C.", "Ann", "Lee", "1", "Elm St", None, "NY", "1"), ("101", "HeadOfficer", None, "Ann", " ", "", "", "", "", ""), ("101", "Agent", None, "Bo", "Ray", None, None, None, None, None), ("100", "HeadOfficer", None, "Old", "One", None, None, None, None, None)], "registrationid string, " + ", ".join(f"{k} string" for k in columns))
    got = adapters.contacts_on_latest(contacts, "registrationid", latest, ["HeadOfficer"], columns)
    assert rows(got.where("is_person"), "person_name_normalized", "corporation_name_normalized", "address_normalized") == [("ANN LEE", "ACME LLC", "1 ELM ST NY 1")] and got.count() == 3
    assert got.where("address_normalized = ''").select("address_key").distinct().first()[0] == ""
    owners = got.select(C("corporation_owner_key").alias("owner_key"))
    registry = spark.createDataFrame([("1", "ACME, LLC"), ("2", "OTHER INC"), ("3", None)], "id string, entity string")
    assert rows(adapters.registry_matches(registry, "entity", owners), "id") == [("1",)]


def test_link_graph_takes_denied_addresses_out(spark):
    contacts = spark.createDataFrame([("a", "x", "me"), ("b", "x", "me"), ("c", "hub", "me"), ("d", "hub", "me"), ("e", "hub", "me"), ("a", "y", "AGENT CO"), ("c", "y", "me"), ("f", "", "me"), ("g", None, "me")], "m string, s string, who string")
    links, denied = graph.address_links(contacts, "m", "s", "address", 3, "who", spark.createDataFrame([("AGENT CO",)], "n string"))
    assert rows(links, "a", "b", "link_type", "evidence") == [("a", "b", "address", "x")] and rows(denied, "shared", "degree", "reason") == [("hub", 3, "high_degree"), ("y", 2, "seed_agent")]
    people = graph.typed_links(spark.createDataFrame([("b", "p"), ("c", "p")], "m string, p string"), "m", "p", "person", "p")
    nodes = graph.entity_nodes(spark.createDataFrame([(k, k.upper(), "llc") for k in "abcdf"] + [("z", "Z", "individual"), ("", "", "llc")], "k string, n string, c string"), "k", "n", "c", ["llc"])
    clusters = graph.link_graph(nodes, graph.concat_links(links, people, links))
    assert rows(clusters, "owner_key", "cluster", "members") == [("a", "a", 3), ("b", "a", 3), ("c", "a", 3), ("d", "d", 1), ("f", "f", 1)]
    evidence = graph.owner_evidence(nodes, contacts.select(C("m").alias("owner_key"), C("s").alias("address"), F.lit("officer").alias("role"), F.lit(None).cast("string").alias("person")), denied)
    assert rows(evidence, "owner_key", "addresses", "denied_addresses", "agent_only") == [("a", 2, 1, False), ("b", 1, 0, False), ("c", 2, 2, True), ("d", 1, 1, True), ("f", 0, 0, True)]


def test_hot_keys_are_salted(spark, monkeypatch):
    monkeypatch.setattr(joins, "BEARABLE", 3)
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [("b", 1), (None, 2), ("none", 3)], "k string, i int")
    right = spark.createDataFrame([("hot", "H"), ("b", "B"), ("c", "C")], "q string, v string")
    assert joins.hot_keys(left, "k") == ["hot"]
    got = rows(joins.hot_key_lookup(left, "k", right, "q", ["v"]).withColumn("k", F.coalesce("k", F.lit("?"))).withColumn("v", F.coalesce("v", F.lit("-"))), "k", "i", "v")
    assert got == sorted([("hot", i, "H") for i in range(50)] + [("b", 1, "B"), ("?", 2, "-"), ("none", 3, "-")])


def test_cube_and_claims(spark):
    parcels = spark.createDataFrame([("llc", "sfr", 1), ("trust", "sfr", 1), ("individual", "sfr", 8), ("individual", "big", 90)], "owner_class string, t string, u int")
    cube = shares.sensitivity_cube(shares.headline_shares(parcels, C("t") == "sfr", "u"), 0.97, 0.98, 10)
    assert cube.count() == 8
    one = shares.claim(cube, "informative", "unit", False)
    assert one["raw"] == 0.1 and abs(one["corrected"] - (0.1 + 0.98 - 1) / (0.97 + 0.98 - 1)) < 1e-12 and one["n_labeled"] == 10
    assert shares.claim(cube, "informative", "unit", True)["raw"] == 0.2 and shares.claim(cube, "all", "parcel", True)["corrected"] is None
    with pytest.raises(ValueError):
        shares.claim(cube, "all", "acre", True)
    with pytest.raises(KeyError):
        shares.claim(cube, "nothing", "unit", True)


def test_manifest_and_report(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 0.5), (None, 1.0)], "n string, x double")
    _, audit = relational.audited_filter(df, [("named", C("n").isNotNull())])
    run = manifest.Manifest("nyc", "2024-01-01T00:00:00", source_paths={"p": "x.csv"})
    run.add_audit("parcels", audit)
    folder = str(tmp_path / "published")
    assert manifest.publish(spark, folder, {"t": df}, run) == ["t"] and manifest.publish(spark, folder, {"t": df}, run, {"t": ["x"]}) == ["t"]
    assert manifest.read(spark, f"{folder}/run_manifest.json") == run and run.filter_counts == [{"stage": "parcels", "rule_id": "named", "rows_in": 2, "rows_out": 1}]
    assert manifest.read(spark, f"{folder}/none.json") is None and spark.read.parquet(f"{folder}/t.parquet").count() == 2
    assert files.markdown_table(df.limit(1)) == "| n | x |\n| --- | --- |\n| a\\|b | 0.5000 |\n" and files.names(spark, str(tmp_path / "no")) == []


def test_labels_pages_and_strips(spark, tmp_path):
    owners = spark.createDataFrame([("a", "unknown", "x"), ("b", "llc", "x"), ("c", None, "x"), ("d", "unknown", "x")], "k string, c string, class_source string")
    labels = spark.createDataFrame([("a", "corp", 0.9), ("a", "trust", 0.8), ("b", "corp", 0.9), ("c", "trust", 0.7), ("d", "corp", 0.1), ("d", "alien", 0.9), (None, "corp", 1.0)], "k string, label string, confidence double")
    got = evaluation.merged_labels(owners, "k", "c", labels, ["corp", "trust", "llc"], 0.5)
    assert rows(got, "k", "c", "class_source") == [("a", "corp", "model"), ("b", "llc", "rules"), ("c", "trust", "model"), ("d", "unknown", "rules")]
    path = str(tmp_path / "pull")
    assert tables.pull_pages(spark, iter([[{"id": "1"}, {"id": "2"}], [{"id": "3"}]]), "id string", path) == 3 and rows(spark.read.parquet(path), "id") == [("1",), ("2",), ("3",)]
    (tmp_path / "x.csv").write_text("n,t\n1,a\n")
    assert dict(tables.read_inferred(spark, str(tmp_path / "x.csv")).dtypes) == {"n": "int", "t": "string"}
    assert spark.range(1).select(strip_of(F.lit("--a-b.-"), "-.").alias("x")).first()["x"] == "a-b"
