"""Drift report against a plain recomputation, and the unified table."""

from __future__ import annotations

import json
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tenure.plans.drift import APPROVED, TARGET
from tenure.sources.drift import field_changes, plain_text, replay, rescue

LINES = "feed string, file_no int, payload string, extra string"


def lines(spark, files):
    return spark.createDataFrame([("f", n, p if isinstance(p, (str, type(None))) else json.dumps(p), "x") for n, ps in files.items() for p in ps], LINES)


def changes(spark, files):
    return sorted((r["file_no"], r["change_kind"], r["field_name"], r["new_field_name"]) for r in field_changes(lines(spark, files)).collect())


def test_plain_text(spark):
    pairs = {"$215,000.00": "215000", "215000": "215000", "5.0": "5", "0259": "259", "07/03/2021": "2021-07-03", "2021-07-03T00:00:00": "2021-07-03", " A  b ": "a b", "1;2": "1;2", "": None, "0": "0", "-1.50": "-1.5"}
    df = spark.createDataFrame([(k,) for k in pairs], "v string").select("v", plain_text(F.col("v")).alias("p"))
    assert {r["v"]: r["p"] for r in df.collect()} == pairs


def test_each_kind_of_change(spark):
    one = [{"document_id": str(i), "amt": 1000 + i, "kind": "A", "gone": f"g{i}", "case": 1, "list": ["a", "b"], "nul": None} for i in range(5)]
    two = [{"document_id": str(i), "price": f"${1000 + i:,}.00", "kind": {"code": "A", "version": 1}, "new": f"n{i}", "CASE": 1, "list": "a;b", "nul": None} for i in range(5)]
    assert changes(spark, {1: one + one, 2: [*two, "-- end --", "", None, '{"cut": 1', "[1]"]}) == [
        (2, "added", "new", ""), (2, "removed", "gone", ""), (2, "renamed", "amt", "price"), (2, "renamed", "case", "CASE"),
        (2, "type_changed", "kind", ""), (2, "type_changed", "list", ""), (2, "type_changed", "price", ""),
    ]


def test_no_shared_documents_no_rename(spark):
    assert changes(spark, {1: [{"document_id": "1", "a": 1}], 2: [{"document_id": "2", "b": 1}]}) == [(2, "added", "b", ""), (2, "removed", "a", "")]


def test_decimal_is_not_integer(spark):
    assert changes(spark, {1: ['{"document_id":"1","a":5}'], 2: ['{"document_id":"1","a":5.0}'], 4: ['{"document_id":"1"}']}) == [(2, "type_changed", "a", "")]


def test_empty(spark):
    assert changes(spark, {}) == []


def test_rescue_and_replay(spark):
    df = lines(spark, {1: [{"document_id": "1", "amt": "$1,000.50", "parcel_ids": "a;b", "odd": 1}, {"doc_id": "2", "consideration": "none", "parcel_ids": ["c"]}, "junk"]})
    first = {r["_unreadable"] or r["_rescued"]: r for r in rescue(df, "payload", TARGET).collect()}
    assert "junk" in first and any('"consideration":"none"' in (k or "") for k in first)
    rows = {r["doc_id"]: r for r in replay(rescue(df, "payload", TARGET), APPROVED).collect()}
    assert rows["1"]["consideration"] == 1000.5 and rows["1"]["parcel_ids"] == ["a", "b"] and rows["1"]["_rescued"] == '{"odd":"1"}'
    assert rows["2"]["consideration"] is None and rows["2"]["parcel_ids"] == ["c"] and rows["1"]["extra"] == "x"


def _plain(v):
    if isinstance(v, dict):
        v = v.get("code")
    if isinstance(v, list):
        v = ";".join(map(str, v))
    s = str(v).lower().strip()
    t = re.sub(r"[$,]", "", s)
    return str(float(t)) if re.fullmatch(r"-?\d+(\.\d*)?", t) else s


def test_report_equals_plain_recomputation(spark, small):
    """The whole report over the smallest tables, recomputed without Spark."""
    df = spark.read.parquet(f"{small}/transfer_extract.parquet")
    files = defaultdict(list)
    for r in df.collect():
        try:
            o = json.loads(r["payload"], parse_float=lambda x: ("d", x))
        except (ValueError, TypeError):
            continue
        if isinstance(o, dict):
            files[r["feed"], r["file_no"]].append(o)
    kind = lambda v: {bool: "boolean", int: "integer", tuple: "decimal", str: "string", list: "list", dict: "object"}[type(v)]
    want = set()
    for (feed, no), now in files.items():
        if not (before := files.get((feed, no - 1))):
            continue
        fields = [defaultdict(set), defaultdict(set)]
        for side, rows in enumerate((before, now)):
            for o in rows:
                for k, v in o.items():
                    fields[side][k] |= {kind(v)} if v is not None else set()
        docs = [{o["document_id"]: o for o in rows if "document_id" in o} for rows in (before, now)]
        gone, came = set(fields[0]) - set(fields[1]), set(fields[1]) - set(fields[0])
        renamed = {}
        for a in gone:
            for b in came:
                both = [(_plain(docs[0][d][a] if not isinstance(docs[0][d][a], tuple) else docs[0][d][a][1]), _plain(docs[1][d][b] if not isinstance(docs[1][d][b], tuple) else docs[1][d][b][1])) for d in docs[0].keys() & docs[1].keys() if docs[0][d].get(a) is not None and docs[1][d].get(b) is not None]
                if both and all(x == y for x, y in both):
                    renamed[a] = b
        want |= {(feed, no, "renamed", a, b) for a, b in renamed.items()} | {(feed, no, "removed", a, "") for a in gone - set(renamed)} | {(feed, no, "added", b, "") for b in came - set(renamed.values())}
        pairs = [(k, k) for k in set(fields[0]) & set(fields[1])] + list(renamed.items())
        want |= {(feed, no, "type_changed", b, "") for a, b in pairs if fields[0][a] and fields[1][b] and fields[0][a] != fields[1][b]}
    got = {tuple(r) for r in field_changes(df).collect()}
    assert got == want


def test_report_comes_from_the_ingested_table(spark, small):
    """p6_found says nothing but what typed columns, _rescued and _kinds hold, and the same with any target."""
    from tenure.plans.drift import p6_found
    from tenure.sources.drift import ingested_changes

    df = spark.read.parquet(f"{small}/transfer_extract.parquet")
    want = {tuple(r) for r in field_changes(df).collect()}
    assert {tuple(r) for r in p6_found(spark, small).collect()} == want
    table = rescue(df, "payload", TARGET).drop("payload").checkpoint()
    assert {tuple(r) for r in ingested_changes(table, TARGET).collect()} == want


def test_typed_columns_lose_no_change(spark):
    """A renamed field is found across typed column and rescue, whatever its notation; what a column cannot hold whole stays."""
    values = [("12345678901234567890.12", "$12,345,678,901,234,567,890.12"), ("1e5", "1e5"), (0.1, "0.1"), (10000000, "10,000,000.00"), (5.0, "5")]
    one = [{"document_id": str(i), "consideration": a, "parcel_ids": "a;;b", "recorded_date": "07/03/2021"} for i, (a, _) in enumerate(values)]
    two = [{"document_id": str(i), "amt": b, "ids": "a;;b", "recorded_on": "2021-07-03T00:00:00"} for i, (_, b) in enumerate(values)]
    got = sorted((r["change_kind"], r["field_name"], r["new_field_name"]) for r in field_changes(lines(spark, {1: one, 2: two}), target=TARGET).collect())
    assert got == [("renamed", "consideration", "amt"), ("renamed", "parcel_ids", "ids"), ("renamed", "recorded_date", "recorded_on"), ("type_changed", "amt", "")]


def test_what_the_table_leaves_out_is_returned(spark, tmp_path):
    from tenure.plans.drift import QUERIES

    payloads = ['{"document_id":"1","sale_price":"none","odd":1}', "-- end --", '{"amt":5}', '{"document_id":"2","amt":5}']
    rows = [("nyc_a", 1, n, p) for n, p in enumerate(payloads)]
    spark.createDataFrame(rows, "feed string, file_no int, line_no int, payload string").write.parquet(f"{tmp_path}/transfer_extract.parquet")
    got = {r["line_no"]: (r["rescued"], r["unreadable"], r["no_document"]) for r in QUERIES["p6_rescued"](spark, str(tmp_path)).collect()}
    assert got == {0: ('{"odd":"1","sale_price":"none"}', None, False), 1: (None, "-- end --", True), 2: (None, None, True)}
