"""Incremental ingest with Structured Streaming: latest rows per key, and windowed counts with late data."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tenure.operators.relational import latest_per_key, union_by_name
from tenure.sources import files

POINTER = "current.json"


def current(spark: SparkSession, target: str) -> DataFrame | None:
    """The table as of the last batch, None before the first."""
    text = files.read_text(spark, f"{target}/{POINTER}")
    versions = {} if text is None else json.loads(text)["buckets"]
    return spark.read.option("basePath", target).parquet(*[f"{target}/bucket={b}/{v}" for b, v in versions.items()]).drop("bucket") if versions else None


def keep_latest(stream: DataFrame, target: str, checkpoint: str, keys: Sequence[str], order: Sequence[str], buckets: int = 16) -> StreamingQuery:
    """Maintain the latest row per key of a stream under target, over all data that is there now.

    Rows are bucketed by a hash of their keys; a batch merges only the buckets that it touches, into new versions, and
    replaces the pointer file that names the version of each bucket. Versions that the pointer before it named
    too stay for readers, older ones are deleted. A batch that is run again after a failure writes the same again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        text = files.read_text(spark, f"{target}/{POINTER}")
        state = {"buckets": {}, "old": []} if text is None else json.loads(text)
        rows = batch.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = sorted(r[0] for r in rows.select("__bucket").distinct().collect())
        before = [f"{target}/bucket={b}/{state['buckets'][str(b)]}" for b in touched if str(b) in state["buckets"]]
        if before:
            held = spark.read.parquet(*before)
            rows = union_by_name(held.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")), rows)
        version = f"v{number}"
        latest = latest_per_key(rows, [*keys, "__bucket"], order)
        # into a folder of the batch, then each bucket to its place
        latest.repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{target}/batch={version}")
        for b in touched:
            files.move(spark, f"{target}/batch={version}/__bucket={b}", f"{target}/bucket={b}/{version}")
        files.delete(spark, f"{target}/batch={version}")
        replaced = [f"bucket={b}/{state['buckets'][str(b)]}" for b in touched if state["buckets"].get(str(b), version) != version]
        pointer = {"buckets": {**state["buckets"], **{str(b): version for b in touched}}, "old": replaced}
        files.write_text(spark, f"{target}/{POINTER}", json.dumps(pointer, sort_keys=True))
        for path in set(state["old"]) - set(replaced):
            files.delete(spark, f"{target}/{path}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, at: str, width: str, lateness: str, by: Sequence[str], **aggregates: Column) -> DataFrame:
    """Aggregates per tumbling window and group; rows later than the lateness are dropped, as a stream's state must end."""
    marked = stream.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", lateness)
    out = marked.groupBy(F.window("__at", width).alias("w"), *by).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *aggregates)
