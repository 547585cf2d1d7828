"""All registered queries (importing the query modules fills the registry)."""

from __future__ import annotations

import importlib

from acreage.plans.registry import OPERATORS, ORACLE, QUERIES

_MODULES = ["q_views", "q_rules", "q_parse", "q_features", "q_similarity", "q_insight", "q_io", "q_ml", "q_extra"]

for _m in _MODULES:
    importlib.import_module(f"acreage.plans.{_m}")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)


def operators():
    return dict(OPERATORS)
