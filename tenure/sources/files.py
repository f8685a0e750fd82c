"""Small files on any file system that Spark can reach: pointers, manifests, reports, folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):  # noqa: ANN202
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _at(spark, path)
    return system.exists(place)


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, sorted; none if it does not exist."""
    system, place = _at(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []


def delete(spark: SparkSession, path: str) -> None:
    system, place = _at(spark, path)
    system.delete(place, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Move a folder or file to a new place; what stood there before is replaced."""
    system, place = _at(spark, target)
    system.delete(place, True)
    system.mkdirs(place.getParent())
    system.rename(spark._jvm.org.apache.hadoop.fs.Path(source), place)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None if there is none."""
    system, place = _at(spark, path)
    if not system.exists(place):
        return None
    stream = system.open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place and move it there: readers see the old or the new one, never a part."""
    system, place = _at(spark, path)
    _, part = _at(spark, f"{path}.part")
    stream = system.create(part, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri() if part.toUri().getScheme() else system.getUri(), spark._jsc.hadoopConfiguration()).rename(system.makeQualified(part), system.makeQualified(place), options)


def markdown_table(df: DataFrame, columns: Sequence[str] | None = None) -> str:
    """A published table of a few rows as a markdown table; nulls are empty, pipes escaped."""
    columns = list(columns or df.columns)
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in df.select(*columns).toLocalIterator())]) + "\n"
