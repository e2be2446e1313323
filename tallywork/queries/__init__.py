"""Registered queries over the given tables, each with the SQL it must agree with where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from ..runtime import prepare_session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_MODULES = (
    "scalars", "matching", "evidence", "duplicates", "spec", "costing", "receipts", "cleanup", "late", "workflow",
    "reports", "controls", "sources",
)


class Tables:
    """The given tables as DataFrames, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register `fn(tables) -> DataFrame` under `name`, with its SQL twin."""

    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(prepare_session(spark), folder))

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load() -> None:
    for module in _MODULES:
        try:
            import_module(f"{__name__}.{module}")
        except ModuleNotFoundError as missing:
            if missing.name != f"{__name__}.{module}":
                raise
