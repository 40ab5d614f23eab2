"""Every registered query with its SQL twin."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import sheetmill.plans
from sheetmill.plans.fixtures import plain_sql

MODULES = [importlib.import_module(f"sheetmill.plans.{m.name}") for m in pkgutil.iter_modules(sheetmill.plans.__path__) if m.name.endswith("_queries")]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["rt8_rt12_hybrid_search"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: plain_sql(text) for m in MODULES for name, text in m.SQL.items()}
