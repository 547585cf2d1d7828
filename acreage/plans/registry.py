"""Query registry: each registered query has a Spark builder and (when the
operator is SQL-expressible) the equivalent DuckDB SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
OPERATORS: dict[str, str] = {}


def query(name: str, sql: str | None = None, ops: str = ""):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        OPERATORS[name] = ops
        return fn
    return deco
