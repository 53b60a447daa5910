"""Registered queries and the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablegov.plans.views import VIEW_SQL, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame``.  ``sql`` may use the ``v_`` views."""
    def wrap(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn
    return wrap


def _used(sql: str) -> list[str]:
    """Views the text needs, dependencies first."""
    out: list[str] = []
    for name in re.findall(r"\bv_\w+", sql):
        if name in VIEW_SQL and name not in out:
            out += [n for n in _used(VIEW_SQL[name]) if n not in out]
            if name not in out:
                out.append(name)
    return out


def with_views(sql: str) -> str:
    sql = sql.strip()
    ctes = ", ".join(f"{n} AS ({VIEW_SQL[n].strip()})" for n in _used(sql))
    if not ctes:
        return sql
    head = re.match(r"(?is)with\s+(recursive\s+)?", sql)
    if head:
        return f"WITH {head.group(1) or ''}{ctes}, {sql[head.end():]}"
    return f"WITH {ctes} {sql}"
