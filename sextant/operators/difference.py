"""Differences between tables, found by a tree of hash sums.

Every row has a 128-bit hash; tables whose hash sums agree are taken as equal. Sums of the hashes of all rows in a bucket, the
left table's less the right one's, are zero if both hold the same rows there.
Buckets that differ are descended into, once, by further bits of the hash; only
rows of leaves that still differ are compared whole. What is shuffled are sums
of a fixed number of buckets, then narrow sums of the buckets that differ, then
the rows that differ: it follows the difference and not the tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant.columns import empty_like, quoted
from sextant.operators.joins import small_side
from sextant.scratch import materialize

#: Bits of the hash that name a bucket and a leaf.
BUCKET_BITS = 16
LEAF_BITS = 48
_LOW = 0xFFFFFFFF


def _hashable(field: T.StructField) -> list[Column]:
    """Cells in a form that differs whenever they do, nulls within lists and structs included."""
    cell = quoted(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        cell = cell + F.lit(0.0)  # one zero
    elif not isinstance(field.dataType, T.AtomicType):
        cell = F.to_json(F.struct(cell), {"ignoreNullFields": "false"})
    return [cell, quoted(field.name).isNull()]


def _marked(left: DataFrame, right: DataFrame) -> DataFrame:
    both = left.withColumn("_side", F.lit(1)).unionByName(right.withColumn("_side", F.lit(-1)))
    cells = [c for f in both.schema.fields if f.name != "_side" for c in _hashable(f)]
    return both.withColumns({f"_h{seed}": F.xxhash64(F.lit(seed), *cells) for seed in (1, 2)})


def _unequal(rows: DataFrame, name: str) -> DataFrame:
    """Buckets in which the sums of the two sides differ. Halves of the hashes are added, so no sum overflows."""
    halves = [h for c in ("_h1", "_h2") for h in (F.col(c).bitwiseAND(_LOW), F.shiftrightunsigned(c, 32))]
    sums = [F.sum("_side").alias("s0")] + [F.sum(h * F.col("_side")).alias(f"s{i}") for i, h in enumerate(halves, 1)]
    differ = reduce(lambda a, b: a | b, [F.col(f"s{i}") != 0 for i in range(len(sums))])
    return materialize(rows.groupBy(name).agg(*sums).where(differ).select(name), "unequal")


def table_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows whose number of copies differs between two tables of one schema, with n_left and n_right."""
    marked = _marked(left, right).withColumns(
        {"_bucket": F.shiftrightunsigned("_h1", 64 - BUCKET_BITS), "_leaf": F.shiftrightunsigned("_h1", 64 - LEAF_BITS)}
    )
    buckets = _unequal(marked, "_bucket")
    if buckets.isEmpty():
        fields = [f for f in marked.schema.fields if f.name in left.columns]
        return empty_like(left, T.StructType([*fields, T.StructField("n_left", T.LongType()), T.StructField("n_right", T.LongType())]))
    # At most 2^16 numbers.
    leaves = _unequal(marked.join(F.broadcast(buckets), "_bucket", "left_semi"), "_leaf")
    rows = marked.join(small_side(leaves), "_leaf", "left_semi")
    return (
        rows.groupBy(*[quoted(c) for c in left.columns])
        .agg(F.count_if(F.col("_side") == 1).alias("n_left"), F.count_if(F.col("_side") == -1).alias("n_right"))
        .where("n_left != n_right")
    )
