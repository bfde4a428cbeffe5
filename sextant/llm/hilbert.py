"""Shards along a Hilbert curve over metadata, cut into runs of equal row counts.

Each metadata column is one dimension.  Its values become cells of equal weight
by quantiles over all rows, so a value held by a third of the rows takes a
third of its axis.  The curve's index orders the rows: rows near in all
dimensions lie near on the curve, and a shard covers a small box that a reader
can skip by the columns' bounds.

Law ``rows``: with n rows, rank r goes to shard floor(r * shards / n), so counts
are at most one apart and slots run without gaps from 0.  Ranks come from range
partitioned slices numbered on their own plus what lies before them; no task
orders the table, and only narrow rows are shuffled.  Ties on the curve are
ordered by key, checksum and size, so rows that are equal in all of these are
interchangeable.

Defined cases: null metadata takes the lowest cell; null text has no bytes and
checksum 0; repeated rows all get slots; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant.operators.ordering import running_count
from sextant.scratch import materialize

SHARDS = 16
BITS = 8
ACCURACY = 20_000
DIMENSIONS = ("lang", "source", "n_chars")
#: Bytes of a text value after the common start that decide its place; larger differences decide first.
TEXT_BYTES = 7
ROWS_A_SLICE = 2_000_000


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of points (rows) with ``bits``-bit cells (columns).

    By the Gray code of the cells' transposed bits: each bit plane undoes the
    rotation and reflection of the planes above it.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(flip, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    carry = np.zeros_like(x[0])
    q = top
    while q > 1:
        carry = np.where((x[-1] & q) != 0, carry ^ (q - 1), carry)
        q >>= 1
    x ^= carry
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            index = (index << 1) | ((x[i] >> bit) & 1)
    return index


def _common_start(low: str | None, high: str | None) -> int:
    a, b = (low or "").encode(), (high or "").encode()
    return next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))


def _code(df: DataFrame, column: str, bounds: dict) -> Column:
    """Number in the order of the column's values."""
    if not isinstance(df.schema[column].dataType, T.StringType):
        return F.col(f"`{column}`").cast("double")
    start = _common_start(*bounds[column])
    head = F.hex(F.substring(F.col(f"`{column}`").cast("binary"), start + 1, TEXT_BYTES))
    return F.conv(F.rpad(head, 2 * TEXT_BYTES, "0"), 16, 10).cast("double")


def with_index(docs: DataFrame, dimensions: tuple[str, ...], name: str, bits: int = BITS) -> DataFrame:
    """``docs`` and the curve's index of each row; quantiles are taken over all rows in two narrow scans."""
    texts = [d for d in dimensions if isinstance(docs.schema[d].dataType, T.StringType)]
    bounds = {}
    if texts:
        ends = docs.agg(*[f(f"`{d}`").alias(f"{i}{e}") for i, d in enumerate(texts) for e, f in (("l", F.min), ("h", F.max))]).first()
        bounds = {d: (ends[f"{i}l"], ends[f"{i}h"]) for i, d in enumerate(texts)}
    codes = [_code(docs, d, bounds) for d in dimensions]
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    cuts = docs.agg(*[F.percentile_approx(c, shares, ACCURACY).alias(f"c{i}") for i, c in enumerate(codes)]).first()
    steps = [np.array(cuts[f"c{i}"] or [], np.float64) for i in range(len(codes))]

    @F.pandas_udf(T.LongType())
    def place(*values: pd.Series) -> pd.Series:
        cells = [np.searchsorted(s, v.fillna(-np.inf).to_numpy(np.float64), side="left") for s, v in zip(steps, values)]
        return pd.Series(hilbert_index(np.stack(cells, axis=1), bits))

    return docs.withColumn(name, place(*codes))


def assign(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    dimensions: tuple[str, ...] = DIMENSIONS,
    shards: int = SHARDS,
) -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot, grown_shard (null under this law), curve."""
    narrow = with_index(docs, dimensions, "_curve_")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    narrow = narrow.select(
        F.col(f"`{key}`").alias("key"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("crc"),
        F.col("_curve_").alias("curve"),
        F.lit(1).cast("long").alias("one"),
    )
    stored = materialize(narrow, "curve")
    total = stored.count()
    ranked = running_count(stored, [], ["curve", "key", "crc", "size"], "one", "rank", ROWS_A_SLICE)
    rank = F.col("rank") - 1
    shard = F.expr(f"(rank - 1) * {shards} div {max(total, 1)}")
    first = F.expr(f"((rank - 1) * {shards} div {max(total, 1)} * {total} + {shards - 1}) div {shards}")
    return ranked.select(
        F.col("key").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        shard.cast("int").alias("shard"),
        (rank - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )


def write_shards(docs: DataFrame, path: str, dimensions: tuple[str, ...] = DIMENSIONS, shards: int = SHARDS) -> None:
    """Writes the rows as Parquet in files along the curve, whose column bounds let readers skip them."""
    index = "_curve_"
    while index in docs.columns:
        index += "_"
    placed = with_index(docs, dimensions, index)
    placed.repartitionByRange(shards, index).sortWithinPartitions(index).drop(index).write.parquet(path)
