"""A set of named tables: registration, schema, counts, overview and guarded SQL."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.columns import without_nan
from sextant.operators.audit import is_read_only
from sextant.operators.joinkeys import discover_join_keys
from sextant.operators.difference import table_diff
from sextant.sources.csv import read_csv
from sextant.sources.names import clean_columns, table_name

PRIMARY = "user_data"


def same_content(left: DataFrame, right: DataFrame) -> bool:
    """Whether both have one schema and the same rows as often, by hash sums of their buckets."""
    if [(f.name, f.dataType) for f in left.schema] != [(f.name, f.dataType) for f in right.schema]:
        return False
    return table_diff(left, right).isEmpty()


def table_schema(df: DataFrame) -> DataFrame:
    rows = [(i + 1, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position bigint, column string, type string, nullable boolean")


class TableRegistry:
    """Ordered name → DataFrame, each also a temp view."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}

    def register(self, name: str, df: DataFrame) -> str:
        """Register under a clean name; only identical content reuses a taken name."""
        work = clean_columns(without_nan(df))
        base = table_name(name)
        candidate, number = base, 1
        while candidate in self.tables and not same_content(work, self.tables[candidate]):
            number += 1
            candidate = f"{base}_{number}"
        self.replace(candidate, work)
        return candidate

    def replace(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df
        df.createOrReplaceTempView(name)

    def load(self, paths: Sequence[str]) -> list[str]:
        """First file becomes the primary table, each further file a table named after it."""
        names = []
        for i, path in enumerate(paths):
            stem = PurePosixPath(path).stem
            df = self.spark.read.parquet(path) if path.endswith(".parquet") else read_csv(self.spark, path)
            names.append(self.register(PRIMARY if i == 0 else stem, df))
        return names

    def save(self, name: str, path: str) -> None:
        self.tables[name].write.mode("overwrite").parquet(path)

    def primary(self) -> DataFrame | None:
        if PRIMARY in self.tables:
            return self.tables[PRIMARY]
        return next(iter(self.tables.values()), None)

    def schema(self, name: str) -> DataFrame:
        if name not in self.tables:
            return self.spark.createDataFrame([], "position bigint, column string, type string, nullable boolean")
        return table_schema(self.tables[name])

    def row_count(self, name: str) -> int:
        return self.tables[name].count() if name in self.tables else 0

    def row_counts(self) -> DataFrame:
        return row_counts(self.tables)

    def select(self, sql: str, params: dict | None = None) -> DataFrame:
        """Run one read-only statement with named parameters."""
        ok, reason = is_read_only(sql)
        if not ok:
            raise ValueError(reason)
        return self.spark.sql(sql, args=params or {})

    def join_keys(self, max_pairs: int | None = None) -> DataFrame:
        return discover_join_keys(self.spark, self.tables, max_pairs)

    def describe(self, top_joins: int | None = None) -> DataFrame:
        return catalog_overview(self.spark, self.tables, top_joins)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table"), "n_rows") for t, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def catalog_overview(spark: SparkSession, tables: dict[str, DataFrame], top_joins: int | None = None) -> DataFrame:
    """(kind, table, item, detail): row counts, columns with types, and the likeliest join keys."""
    columns = spark.createDataFrame(
        [("column", t, f.name, f.dataType.simpleString()) for t, df in tables.items() for f in df.schema],
        "kind string, table string, item string, detail string",
    )
    counts = row_counts(tables).select(
        F.lit("rows").alias("kind"), "table", F.lit("n_rows").alias("item"), F.col("n_rows").cast("string").alias("detail")
    )
    joins = discover_join_keys(spark, tables, top_joins).select(
        F.lit("join").alias("kind"),
        F.col("left_table").alias("table"),
        F.col("left_column").alias("item"),
        F.concat_ws(".", "right_table", "right_column").alias("detail"),
    )
    return counts.unionByName(columns).unionByName(joins)
