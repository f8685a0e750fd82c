"""All queries of the core and their SQL."""

from __future__ import annotations

from tenure.plans import asof, drift, ownership, skew, snapshots, transfers

MODULES = (skew, asof, drift, snapshots, ownership, transfers)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
