"""Intermediate tables in the cluster's shared checkpoint folder.

An operator that needs an intermediate result twice, or needs it fixed before
it is numbered, writes it once and reads it back.  The files live in the folder
named by ``spark.checkpoint.dir``, so a lost executor costs nothing but a
re-read.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="sextant-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as Parquet into the scratch folder and return it as a scan."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/sextant-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
