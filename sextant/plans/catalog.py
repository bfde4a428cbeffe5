"""Registration of queries and their check SQL, and access to the input tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Input tables of one folder as attributes; nothing is read until a column is needed."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def messy(self) -> DataFrame:
        from sextant.plans.inputs import messy_orders

        return messy_orders(self.orders)


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name, with optional check SQL."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def rounded(column: Column | str, digits: int) -> Column:
    """Round and drop the sign of zero, so that both engines print the same number."""
    value = F.round(column, digits)
    return F.when(value == 0, F.lit(0.0)).otherwise(value)


def sql_rounded(expression: str, digits: int) -> str:
    return f"(case when round({expression}, {digits}) = 0 then 0.0 else round({expression}, {digits}) end)"
