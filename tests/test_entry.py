"""The driver's contract, with and without the llm subpackage."""

from __future__ import annotations

import importlib
import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def fresh():
    sys.modules.pop("__spark_entry__", None)
    return importlib.import_module("__spark_entry__")


def test_without_llm(monkeypatch):
    """A missing subpackage takes its queries along and nothing else."""
    for name in [m for m in sys.modules if m.startswith("tenure.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tenure.llm", None)
    entry = fresh()
    assert entry.llm is None and {"p1_found", "p4_found", "p6_found", "p7_found"} <= set(entry.queries()) and "p2_found" not in entry.queries()
    sys.modules.pop("__spark_entry__", None)


def test_every_sql_has_a_query():
    entry = fresh()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_imports_llm():
    for folder, _, files in os.walk(os.path.join(ROOT, "tenure")):
        if os.path.basename(folder) != "llm":
            for f in (x for x in files if x.endswith(".py")):
                with open(os.path.join(folder, f), encoding="utf-8") as source:
                    assert not re.search(r"^\s*(from|import) tenure\.llm", source.read(), re.M), f


def test_entry_runs(spark, small):
    df = fresh().entry(spark)
    assert df.columns[0] == "geo_neighborhood" and df.count() > 0
