"""Query registry: name -> callable(spark, sf_dir) returning a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("market", "news", "ingest", "backtest", "sequences", "profile", "model", "attention", "regimes", "storage")


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        found |= import_module(f"weekpanel.plans.{name}").QUERIES
    return found
