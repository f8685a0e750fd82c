"""Readers and writers: files by suffix, text with and without header, the newest extract, published copies."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenure.operators.relational import latest_per_key
from tenure.sources import files

#: Reads of text keep null (nothing between separators) apart from "" (a quoted nothing).
TEXT = {"nullValue": "\u0000", "emptyValue": "", "quote": '"', "escape": '"'}
SEPARATORS = {".csv": ",", ".tsv": "\t", ".txt": ","}


def _suffix(path: str) -> str:
    return os.path.splitext(path.rstrip("/"))[1].lower()


def first_line(spark: SparkSession, path: str, separator: str) -> list[str]:
    """The fields of the first line: one line is read, not the file."""
    row = spark.read.text(path).limit(1).first()
    return [] if row is None else [x.strip().strip('"') for x in row[0].split(separator)]


def read_table(spark: SparkSession, path: str, header_if: Sequence[str] = (), names: Sequence[str] = (), multi_line: bool = False) -> DataFrame:
    """Parquet as it is; .csv, .tsv and .txt with every column as text; another suffix is a ValueError.

    A text file has a header, unless ``header_if`` names fields of which none stands in its first line: then
    the columns are ``names``, by position. Nothing is inferred: codes keep their leading zeros. Files are split
    among tasks; ``multi_line`` reads quoted line breaks, but then each file is one task.
    """
    suffix = _suffix(path)
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix not in SEPARATORS:
        raise ValueError(f"unsupported file type {suffix or path!r}")
    head = first_line(spark, path, SEPARATORS[suffix])
    with_header = not header_if or any(h.upper() in {x.upper() for x in header_if} for h in head)
    columns = head if with_header else list(names)[: len(head)]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.read.schema(schema).option("sep", SEPARATORS[suffix]).option("header", with_header).option("enforceSchema", True)
    return reader.options(**TEXT).option("multiLine", multi_line).csv(path)


def fold_headers(df: DataFrame, to: Callable[[str], str] = str.lower) -> DataFrame:
    return df.toDF(*[to(c) for c in df.columns])


def required(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df, or a ValueError that names the missing columns. Looks at the schema alone."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def with_optional(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """df with null columns of the given types where they are absent."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def newest_extract(spark: SparkSession, root: str, file: str) -> str:
    """The path of file in the newest dated folder under root that has it; FileNotFoundError if none."""
    for folder in sorted((d for d in files.names(spark, root) if re.fullmatch(r"\d{4}-\d{2}-\d{2}", d)), reverse=True):
        if files.exists(spark, path := f"{root}/{folder}/{file}"):
            return path
    raise FileNotFoundError(f"{file} in no dated folder of {root}")


def write_csv(df: DataFrame, path: str, order: Sequence[str] = (), parts: int | None = None) -> None:
    """Text in which null is nothing and "" is quoted. ``parts`` is for published tables of a few rows."""
    out = df.orderBy(*order) if order else df
    out = out.coalesce(parts) if parts else out
    out.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", '""').csv(path)


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_json_document(df: DataFrame, path: str) -> dict:
    """The single row of an aggregate as a JSON document; ValueError for more than one."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a document needs exactly one row")
    document = rows[0].asDict(recursive=True)
    files.write_text(df.sparkSession, path, json.dumps(document, default=str, sort_keys=True))
    return document


def payload(df: DataFrame) -> DataFrame:
    """Rows as JSON text, NaN as null: what an endpoint returns of a published table."""
    plain = [F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}).alias("value"))


def register_tables(spark: SparkSession, tables: Mapping[str, DataFrame], prefix: str) -> list[str]:
    """The tables as cached views ``prefix_name``; a name that is no identifier is a ValueError."""
    made = []
    for name, df in tables.items():
        if not re.fullmatch(r"[a-z][a-z0-9_]*", view := f"{prefix}_{name}"):
            raise ValueError(f"not a table name: {view}")
        df.createOrReplaceTempView(view)
        spark.catalog.cacheTable(view)
        made.append(view)
    return made


def stored(spark: SparkSession, view: str) -> DataFrame:
    """A registered table; one that does not exist is an empty frame."""
    return spark.table(view) if spark.catalog.tableExists(view) else spark.createDataFrame([], T.StructType())


def append_store(spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str]) -> None:
    """Append to a key-value store; read_store sees the last write of each key."""
    rows.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)


def read_store(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    return latest_per_key(spark.read.parquet(path), keys, ["written_at"])


# paged pulls: pure logic around a fetch function, so that any transport or a test can drive it

def keyset_pages(fetch: Callable[[str | None, int], list[dict]], key: str, page_size: int) -> Iterator[list[dict]]:
    """Pages after the last key seen, until one is short; a row without the key is a KeyError."""
    last: str | None = None
    while True:
        page = fetch(last, page_size)
        if page:
            yield page
            last = page[-1][key]
        if len(page) < page_size:
            return


def pull_pages(spark: SparkSession, pages: Iterator[list[dict]], schema: str, path: str) -> int:
    """Write every page of a pull to parquet as it comes, and return the number of rows: no more than a page is held."""
    total = 0
    for number, page in enumerate(pages):
        spark.createDataFrame(page, schema).coalesce(1).write.mode("append" if number else "overwrite").parquet(path)
        total += len(page)
    return total


def read_inferred(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """Text with a header whose types are inferred from all rows: two reads; for lookups, as codes lose their leading zeros."""
    return spark.read.option("header", True).option("inferSchema", True).option("sep", separator).csv(path)


def next_page_size(got: int, asked: int, exceeded: bool, first: bool) -> int | None:
    """Size to ask for next with offset paging, None at the end.

    A short first page shows a server's cap, so the size shrinks to it; a later short page is the end, unless
    the server says that more was there.
    """
    if got == 0:
        return None
    if got >= asked or exceeded:
        return min(asked, got)
    return got if first else None
