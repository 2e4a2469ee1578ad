"""All queries of the core, by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "q09_and_intersect_w"
MODULES: tuple[str, ...] = ("logic_queries", "graph_queries", "text_queries", "valid_queries", "rollout_queries", "data_queries")


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for m in MODULES:
        found |= import_module(f"lodestone.plans.{m}").queries()
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for m in MODULES:
        found |= import_module(f"lodestone.plans.{m}").oracle_sql()
    return found
