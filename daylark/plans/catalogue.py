"""Registered queries of the panel library and their DuckDB oracles."""

from __future__ import annotations

from daylark.plans import cohort as _cohort  # noqa: F401  registers on import
from daylark.plans import relational


def queries():
    return dict(relational.QUERIES)


def oracle_sql():
    return dict(relational.ORACLES)
