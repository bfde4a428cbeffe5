"""Column kinds and small plan helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> Column:
    """Column by exact name, also when it holds dots, spaces or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def categorical_columns(df: DataFrame) -> list[str]:
    """Text and boolean columns; booleans always count as categories."""
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def time_columns(df: DataFrame) -> list[str]:
    kinds = (T.TimestampType, T.TimestampNTZType, T.DateType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def as_double(df: DataFrame, name: str) -> Column:
    """Numeric cell as double with NaN read as null; text cells that are no number give null."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        value = quoted(name).cast("double")
        return F.when(~F.isnan(value), value)
    if isinstance(kind, T.NumericType):
        return quoted(name).cast("double")
    from sextant.functions.numbers import to_number

    return to_number(quoted(name).cast("string"))


def without_nan(df: DataFrame) -> DataFrame:
    """NaN and null are one concept everywhere in this library."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[
            F.when(~F.isnan(quoted(c)), quoted(c)).alias(c) if c in floats else quoted(c)
            for c in df.columns
        ]
    )


def rows_from_wide(row: DataFrame, records: Sequence[Sequence[Column]]) -> DataFrame:
    """Turn a one-row aggregate into one row per record without another shuffle."""
    return row.select(F.inline(F.array(*[F.struct(*record) for record in records])))


def empty_like(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)
