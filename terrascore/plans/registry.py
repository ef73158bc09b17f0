"""Registry of named queries: ``@query(name, sql=...)``.

Each query is ``(spark, sf_dir) -> DataFrame`` and reads the base tables
(or views Spark derives from them).  ``sql`` is the DuckDB oracle over
the same base tables, when one exists.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco
