"""The registered queries over the driver's tables, with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("columns", "analytics", "joins", "cells", "evidence", "mapping", "planning", "routes", "rules", "trees", "accuracy", "surfaces", "acquired", "traces", "imagery")
FLAGSHIP = "relations_nearest_n"
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in map(import_module, (f"fieldloom.plans.{m}" for m in MODULES)):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
