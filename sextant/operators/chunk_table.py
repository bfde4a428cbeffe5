"""A stored chunk table in buckets of ids, of which an upsert rewrites only those it touches.

The bucket of a row follows from its id alone and is a partition of the table.
An upsert reads the partitions its rows fall in, merges them and overwrites
just these; all other files stay as they are. The number of buckets belongs to
the table and must be the same in every call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators.texts import upsert_chunks
from sextant.scratch import materialize

BUCKETS = 256
_BUCKET = "_bucket"


def _bucketed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    return rows.withColumn(_BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def _write(rows: DataFrame, path: str) -> None:
    """Overwrites the partitions that ``rows`` has, one task and file a bucket unless a bucket is large."""
    laid = rows.repartition(_BUCKET)
    laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(path)


def create_chunks(rows: DataFrame, path: str, key: str = "id", buckets: int = BUCKETS) -> None:
    """Store a table; of rows with one id the highest ``version`` stays. Ids must not be null."""
    _write(upsert_chunks(_bucketed(rows.limit(0), key, buckets), _bucketed(rows, key, buckets), key), path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(_BUCKET)


def merge_chunks(spark: SparkSession, path: str, incoming: DataFrame, key: str = "id", buckets: int = BUCKETS) -> list[int]:
    """Upsert into a stored table; returns the buckets that were rewritten, whose number is bounded by the table's."""
    fresh = materialize(_bucketed(incoming, key, buckets), "incoming")
    touched = sorted(r[0] for r in fresh.select(_BUCKET).distinct().collect())
    if touched:
        current = spark.read.parquet(path).where(F.col(_BUCKET).isin(touched)).select(*fresh.columns)
        # Written apart first, since a table cannot be overwritten while it is read.
        _write(materialize(upsert_chunks(current, fresh, key), "merged"), path)
    return touched
