"""Files whose fields drift: a report of every change, and one table of all of them.

A line is a JSON object; what is no object (broken, cut, comment, empty, null, or with a repeated key) is
unreadable and counts for nothing, but is kept by ``rescue`` in its ``_unreadable`` column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenure.functions.text import blank_to_null, bound, squeeze
from tenure.session import checkpoint

#: Share of the documents comparable under both names whose values must agree for a rename.
RENAME_AGREEMENT = 0.9


def json_kind(value: Column) -> Column:
    """string, integer, decimal, boolean, list or object of a variant; null for a JSON null. 5.0 is decimal."""
    t = F.schema_of_variant(value)
    # integers beyond 18 digits come as a decimal without places, and 5.0 as one of few digits
    big = t.rlike(r"^DECIMAL\((19|[23]\d),0\)$")
    return (
        F.when(t == "STRING", "string")
        .when((t == "BIGINT") | big, "integer")
        .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "decimal")
        .when(t == "BOOLEAN", "boolean")
        .when(t.startswith("ARRAY"), "list")
        .when(t.startswith("OBJECT"), "object")
    )


def plain_text(raw: Column) -> Column:
    return bound(F.lower(squeeze(raw)), _plain)


def _plain(s: Column) -> Column:
    number = F.regexp_replace(s, r"^[$€£]\s?|,(?=\d{3}(?:\D|$))", "")
    number = F.regexp_replace(F.regexp_replace(number, r"^(-?\d+)\.0*$", "$1"), r"^(-?\d+\.\d*?[1-9])0+$", "$1")
    number = F.regexp_replace(number, r"^(-?)0+(?=\d)", "$1")
    us = F.regexp_replace(s, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-0$1-0$2")
    us = F.regexp_replace(us, r"-0(\d\d)", "-$1")
    s = (
        F.when(s.rlike(r"^[$€£]?\s?-?\d{1,3}(,\d{3})+(\.\d*)?$|^[$€£]?\s?-?\d+(\.\d*)?$"), number)
        .when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), us)
        .when(s.rlike(r"^\d{4}-\d\d-\d\d[t ]00:00(:00(\.0+)?)?z?$"), F.substring(s, 1, 10))
        .otherwise(F.regexp_replace(s, r"\s*[;|]\s*", ";"))
    )
    return blank_to_null(s)


def raw_plain(raw: Column, kind: Column) -> Column:
    """A field's JSON text, as in ``_rescued``, as text in which notation and type no longer show; null where nothing is left.

    A list is its members joined by ";"; an object its ``code`` or else its members. Currency signs,
    thousands separators, trailing places of zeros, leading zeros, a midnight and case are dropped.
    """
    inner = bound(F.from_json(raw, "map<string,string>"), lambda m: F.coalesce(F.try_element_at(m, F.lit("code")), F.array_join(F.map_values(m), ";")))
    return plain_text(F.when(kind == "list", F.array_join(F.from_json(raw, "array<string>"), ";")).when(kind == "object", inner).otherwise(raw))


def typed_plain(value: Column, kind: str) -> Column:
    """The plain text of a typed column's value."""
    if kind == "array<string>":
        return plain_text(F.array_join(value, ";"))
    if kind in ("double", "float"):
        return plain_text(F.coalesce(value.try_cast("decimal(38,18)").cast("string"), value.cast("string")))
    return plain_text(value.cast("string"))


def ingested_fields(ingested: DataFrame, keep: Sequence[str], target: Mapping[str, str], document: str) -> DataFrame:
    """keep, __doc_raw, __doc_typed, __doc_kind (the document field), key, kind, raw, typed: a row per top-level field of an ingested line.

    Presence and type come from ``_kinds``; a value's raw text from ``_rescued``, else its plain text from the
    typed column that took it.
    """
    typed = F.create_map(*[c for name, kind in target.items() for c in (F.lit(name), typed_plain(F.col(name), kind))]) if target else F.lit(None).cast("map<string,string>")
    doc = F.lit(document)
    read = ingested.where(F.col("_kinds").isNotNull()).select(*keep, "_kinds", F.from_json("_rescued", "map<string,string>").alias("__rest"), typed.alias("__typed"))
    fields = read.select(*keep, "__rest", "__typed", F.try_element_at("_kinds", doc).alias("__doc_kind"), F.explode("_kinds").alias("key", "kind"))
    at = lambda m, key: F.try_element_at(m, key)
    return fields.select(*keep, at("__rest", doc).alias("__doc_raw"), at("__typed", doc).alias("__doc_typed"), "__doc_kind", "key", "kind", at("__rest", F.col("key")).alias("raw"), at("__typed", F.col("key")).alias("typed"))


def held_plain(raw: Column, kind: Column, typed: Column) -> Column:
    """The plain text of a field: what is rescued goes before the typed value, which may be rounded."""
    return F.when(raw.isNotNull(), raw_plain(raw, kind)).otherwise(typed)


def field_changes(lines: DataFrame, feed: str = "feed", file_no: str = "file_no", payload: str = "payload", document: str = "document_id", target: Mapping[str, str] | None = None) -> DataFrame:
    """``ingested_changes`` of lines that are not ingested yet."""
    source = lines.select(F.col(feed).alias("feed"), F.col(file_no).alias("file_no"), F.col(payload).alias("payload"))
    return ingested_changes(checkpoint(rescue(source, "payload", target or {})), target or {}, document=document)


def ingested_changes(ingested: DataFrame, target: Mapping[str, str], feed: str = "feed", file_no: str = "file_no", document: str = "document_id") -> DataFrame:
    """(feed, file_no, change_kind, field_name, new_field_name): what changed from file_no - 1 to file_no.

    added, removed, renamed (field_name left, new_field_name came, and over the documents of both files the
    values agree apart from notation and type) and type_changed (under the later name). Names compare
    exactly. Files are those with a readable line; a file whose predecessor is missing has no changes. A
    field without non-null values has no type. Repeated lines weigh once. Null feeds or numbers are left out.

    Read from the table that ``rescue`` makes for the target: ``_kinds``, ``_rescued`` and the typed columns.
    Field statistics combine before the shuffle; values meet only for fields that came or went, one row per
    document and pair of such fields.
    """
    source = ingested.where(F.col(feed).isNotNull() & F.col(file_no).isNotNull()).select(F.col(feed).alias("feed"), F.col(file_no).cast("bigint").alias("file_no"), "_kinds", "_rescued", *target)
    fields = ingested_fields(source, ["feed", "file_no"], target, document)

    def kind_of(kinds: Column) -> Column:
        """One name for the kinds of a field's values: integers among decimals are decimals."""
        numeric = F.array_contains(kinds, "decimal")
        rest = F.when(numeric, F.array_remove(kinds, "integer")).otherwise(kinds)
        return F.nullif(F.array_join(F.array_sort(rest), "+"), F.lit(""))

    # a row per field of a file, read again by every later step
    present = checkpoint(fields.groupBy("feed", "file_no", "key").agg(kind_of(F.collect_set("kind")).alias("kind")))
    files = present.select("feed", "file_no").distinct()
    steps = files.join(files.select("feed", (F.col("file_no") + 1).alias("file_no")), ["feed", "file_no"], "left_semi")
    sides = F.array(F.struct(F.lit(0).alias("back"), F.col("file_no").alias("step")), F.struct(F.lit(1).alias("back"), (F.col("file_no") + 1).alias("step")))
    seen = present.select("feed", "key", "kind", F.explode(sides).alias("s")).select("feed", F.col("s.step").alias("file_no"), "key", "kind", F.col("s.back").alias("back"))
    status = (
        seen.groupBy("feed", "file_no", "key")
        .agg(F.max(F.col("back") == 0).alias("now"), F.max(F.col("back") == 1).alias("before"), F.max(F.when(F.col("back") == 0, F.col("kind"))).alias("kind_now"), F.max(F.when(F.col("back") == 1, F.col("kind"))).alias("kind_before"))
        .join(steps, ["feed", "file_no"], "left_semi")
    )
    moved = status.where(F.col("now") != F.col("before"))

    # values of the fields that came or went, per document
    went = moved.where("before").select("feed", (F.col("file_no") - 1).alias("file_no"), "key", F.lit(1).alias("back"))
    came = moved.where("now").select("feed", "file_no", "key", F.lit(0).alias("back"))
    values = (
        fields.where(F.col("kind").isNotNull() & F.col("__doc_kind").isNotNull())
        .join(went.unionByName(came), ["feed", "file_no", "key"])
        .withColumns({"__doc": held_plain(F.col("__doc_raw"), F.col("__doc_kind"), F.col("__doc_typed")), "plain": held_plain(F.col("raw"), F.col("kind"), F.col("typed"))})
        .groupBy("feed", (F.col("file_no") + F.col("back")).alias("file_no"), "__doc", "key", "back")
        .agg(F.max("plain").alias("plain"))
        .where("__doc is not null and plain is not null")
    )
    old = values.where("back = 1").select("feed", "file_no", "__doc", F.col("key").alias("old_key"), F.col("plain").alias("old_plain"))
    new = values.where("back = 0").select("feed", "file_no", "__doc", F.col("key").alias("new_key"), F.col("plain").alias("new_plain"))
    agreement = old.join(new, ["feed", "file_no", "__doc"]).groupBy("feed", "file_no", "old_key", "new_key").agg(F.count(F.lit(1)).alias("compared"), F.count_if(F.col("old_plain") == F.col("new_plain")).alias("agreed"))
    close = agreement.where(F.col("agreed") >= RENAME_AGREEMENT * F.col("compared"))
    # one to one: each side must be the other's best
    best = [F.col("agreed").desc(), F.col("old_key"), F.col("new_key")]
    renamed = checkpoint(
        close.withColumn("__a", F.row_number().over(Window.partitionBy("feed", "file_no", "old_key").orderBy(*best)))
        .withColumn("__b", F.row_number().over(Window.partitionBy("feed", "file_no", "new_key").orderBy(*best)))
        .where("__a = 1 and __b = 1")
        .select("feed", "file_no", "old_key", "new_key")
    )
    before = status.where("before").select("feed", "file_no", F.col("key").alias("old_key"), "kind_before")
    now = status.where("now").select("feed", "file_no", F.col("key").alias("new_key"), "kind_now")
    pairs = renamed.join(before, ["feed", "file_no", "old_key"]).join(now, ["feed", "file_no", "new_key"])
    columns = ["feed", "file_no", "change_kind", "field_name", "new_field_name"]
    renames = pairs.select("feed", "file_no", F.lit("renamed").alias("change_kind"), F.col("old_key").alias("field_name"), F.col("new_key").alias("new_field_name"))
    retyped = pairs.where("kind_before <> kind_now").select("feed", "file_no", F.col("new_key").alias("field_name")).unionByName(status.where("now and before and kind_before <> kind_now").select("feed", "file_no", F.col("key").alias("field_name")))
    gone = moved.where("before").join(renamed.select("feed", "file_no", F.col("old_key").alias("key")), ["feed", "file_no", "key"], "left_anti").select("feed", "file_no", F.lit("removed").alias("change_kind"), F.col("key").alias("field_name"))
    fresh = moved.where("now").join(renamed.select("feed", "file_no", F.col("new_key").alias("key")), ["feed", "file_no", "key"], "left_anti").select("feed", "file_no", F.lit("added").alias("change_kind"), F.col("key").alias("field_name"))
    rest = retyped.withColumn("change_kind", F.lit("type_changed")).unionByName(gone).unionByName(fresh).withColumn("new_field_name", F.lit(""))
    return renames.select(*columns).unionByName(rest.select(*columns))


def rescue(lines: DataFrame, payload: str, target: Mapping[str, str]) -> DataFrame:
    """The lines with a typed column per target field, what fits no column as JSON in ``_rescued``.

    A field goes to the target column of its exact name if its value casts (``list<string>`` columns take
    lists, or text whose members are separated by ";"). Unknown fields, and known ones whose value does not
    cast, stay in ``_rescued`` with their raw value; null if there are none. A value that its column cannot give
    back (more digits than a double holds) is in the column and in ``_rescued``. ``_kinds`` maps every top-level
    field of the line to the type it came with, null for a JSON null. Unreadable lines keep all
    columns null and their text in ``_unreadable``. Other columns of the lines pass through; those named
    like a target field or named ``_rescued``, ``_unreadable`` or ``_kinds`` are replaced.
    """
    clashing = [c for c in lines.columns if c in target or c in ("_rescued", "_unreadable", "_kinds")]
    v = F.try_parse_json(F.col(payload))
    readable = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    kept = [F.col(c) for c in lines.columns if c not in clashing and c != payload]
    fields = F.when(readable, F.from_json(F.to_json(v), "map<string,string>"))
    kinds = F.when(readable, F.transform_values(F.try_variant_get(v, "$", "map<string,variant>"), lambda _, value: json_kind(value)))
    read = lines.select(*kept, F.when(~readable, F.col(payload)).alias("_unreadable"), kinds.alias("_kinds"), fields.alias("__fields"))
    read = read.select("*", *[_typed(F.try_element_at("__fields", F.lit(name)), kind).alias(name) for name, kind in target.items()])
    whole = {name: _given_back(F.col(name), kind, F.try_element_at("__fields", F.lit(name)), F.try_element_at("_kinds", F.lit(name))) for name, kind in target.items()}
    return _keep_rest(read, "__fields", {name: [name] for name in target}, whole).drop("__fields")


def _given_back(typed: Column, kind: str, raw: Column, raw_kind: Column) -> Column:
    """Whether a typed column holds all of the raw value; the notations are compared only where the texts differ."""
    same = F.coalesce((F.to_json(typed) if kind.startswith("array") else typed.cast("string")) == raw, F.lit(False))
    return same | typed_plain(typed, kind).eqNullSafe(raw_plain(raw, raw_kind))


def replay(rescued: DataFrame, approved: Mapping[str, tuple[str, Sequence[str]]]) -> DataFrame:
    """Promote approved fields out of ``_rescued``: target column -> (type, source names in order of trust).

    A typed column that is still null takes the first approved name whose rescued value casts; that field then
    leaves ``_rescued``. Columns that do not exist yet are made. Values that do not cast stay rescued.
    """
    df = rescued.withColumn("__fields", F.from_json("_rescued", "map<string,string>"))
    for name, (kind, sources) in approved.items():
        have = F.col(name) if name in rescued.columns else F.lit(None).cast(kind)
        df = df.withColumn(name, F.coalesce(have, *[_typed(F.try_element_at("__fields", F.lit(s)), kind) for s in sources]))
    return _keep_rest(df, "__fields", {name: sources for name, (_, sources) in approved.items()}).drop("__fields")


def _typed(raw: Column, kind: str) -> Column:
    """Raw JSON text of a field in the wanted type, null if it does not cast."""
    return bound(raw, lambda r: _cast(r, kind))


def _cast(raw: Column, kind: str) -> Column:
    if kind == "array<string>":
        text = F.array_remove(F.transform(F.split(raw, ";"), lambda x: F.trim(x)), "")
        return F.when(raw.startswith("["), F.from_json(raw, kind)).otherwise(text)
    code = F.when(raw.startswith("{"), F.try_element_at(F.from_json(raw, "map<string,string>"), F.lit("code"))).otherwise(raw)
    if kind == "string":
        return code
    if kind == "date":
        return bound(plain_text(code), lambda p: F.when(p.rlike(r"^\d{4}-\d\d-\d\d$"), p.try_cast("date")))
    return plain_text(code).try_cast(kind)


def _keep_rest(df: DataFrame, fields: str, taken: Mapping[str, Sequence[str]], whole: Mapping[str, Column] | None = None) -> DataFrame:
    """_rescued: the fields that no typed column has taken, or not taken whole."""
    if not taken:
        return df.withColumn("_rescued", F.when(F.size(fields) > 0, F.to_json(fields)))
    whole = whole or {}
    took = F.array(*[F.when(F.col(name).isNotNull() & whole.get(name, F.lit(True)), F.array(*[F.lit(s) for s in sources])).otherwise(F.array().cast("array<string>")) for name, sources in taken.items()])
    names = F.flatten(took)
    rest = F.map_filter(fields, lambda k, value: ~F.array_contains(names, k))
    return df.withColumn("_rescued", F.when(F.size(rest) > 0, F.to_json(rest)))
