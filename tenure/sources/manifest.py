"""What a run read, filtered and wrote."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tenure.sources import files


@dataclass
class Manifest:
    """The record of one run. Filter counts are the rows of ``audited_filter``'s second result."""

    metro_id: str
    started_at: str
    finished_at: str | None = None
    source_paths: dict[str, str] = field(default_factory=dict)
    source_versions: dict[str, str] = field(default_factory=dict)
    rules_version: str = ""
    filter_counts: list[dict[str, object]] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)

    def add_audit(self, stage: str, audit: DataFrame) -> None:
        """Take over a stage's counts: one row per cut."""
        self.filter_counts += [{"stage": stage, "rule_id": r["cut"], "rows_in": r["rows_in"], "rows_out": r["rows_out"]} for r in audit.orderBy("stage").collect()]

    def write(self, spark: SparkSession, path: str) -> None:
        files.write_text(spark, path, json.dumps(asdict(self), indent=2, sort_keys=True) + "\n")


def read(spark: SparkSession, path: str) -> Manifest | None:
    text = files.read_text(spark, path)
    return None if text is None else Manifest(**json.loads(text))


def publish(spark: SparkSession, folder: str, tables: Mapping[str, DataFrame], manifest: Manifest, order: Mapping[str, Sequence[str]] | None = None) -> list[str]:
    """Write every table (parquet, ordered where an order is given) under folder, the manifest last: a folder with a manifest is whole."""
    files.delete(spark, f"{folder}/run_manifest.json")
    for name, df in tables.items():
        out = df.orderBy(*order[name]) if order and order.get(name) else df
        out.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    manifest.write(spark, f"{folder}/run_manifest.json")
    return sorted(tables)
