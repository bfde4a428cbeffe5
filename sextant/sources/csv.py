"""CSV files with types found by content."""

from __future__ import annotations

import csv as python_csv
import io

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.columns import quoted
from sextant.operators.profile import apply_types
from sextant.scratch import materialize
from sextant.sources.names import clean_columns, unique_names
from sextant.sources.records import csv_records

# Cell texts read as null.
NULL_CELLS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


class EmptySourceError(ValueError):
    """The file holds no data rows."""


#: A line on which a quoted cell may stay open: a quote begins a cell, and only text or doubled quotes follow.
_STAYS_OPEN = r'(^|,)"(?:[^"]++|"")*+$'
_QUOTES = {"quote": '"', "escape": '"', "multiLine": "true"}


def _of_records(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """Names and cells of files whose records may go over several lines."""
    records = materialize(csv_records(spark, path), "csv")
    first = records.where("head").orderBy("file").first()
    if first is None:
        raise EmptySourceError(f"{path} is empty")
    names = next(python_csv.reader(io.StringIO(first["text"], newline="")))
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    cells = records.where("not head").select(F.from_csv("text", schema, _QUOTES).alias("r"))
    return names, cells.select(*[F.col(f"r.c{i}") for i in range(len(names))])


def read_csv(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """Header CSV with clean unique names; text columns take the type 80 % of their rows have.

    Files stay split over many tasks, also where a quoted cell goes over several lines.
    """
    reader = spark.read.option("escape", '"')
    try:
        if not spark.read.text(path).where(F.col("value").rlike(_STAYS_OPEN)).isEmpty():
            names, raw = _of_records(spark, path)
        else:
            # The first record alone: Spark's own header handling renames repeated names.
            first = reader.option("header", False).csv(path).first()
            names, raw = [name or "" for name in first or []], reader.option("header", True).csv(path)
    except AnalysisException as error:
        if "UNABLE_TO_INFER_SCHEMA" in str(error):
            raise EmptySourceError(f"{path} is empty") from error
        raise
    if not names or raw.isEmpty():
        raise EmptySourceError(f"{path} has no rows")
    named = clean_columns(raw.toDF(*unique_names(names)))
    blanked = named.select(*[F.when(~quoted(c).isin(NULL_CELLS), quoted(c)).alias(c) for c in named.columns])
    return apply_types(blanked) if infer else blanked
