"""Joins with a side that is usually tiny."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant.columns import quoted

BROADCAST_ROWS = 100_000
#: Bytes of cells; a side within both bounds is broadcast.
BROADCAST_BYTES = 32 << 20


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where null equals null; the keys come once, from the left."""
    renamed = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [quoted(k).eqNullSafe(quoted(f"_k_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_k_{k}" for k in keys])


def small_side(side: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``side`` if its rows and bytes prove it small; else leave a skew-aware shuffle join to Spark.

    Keeps a large partner with a hot key from being shuffled at all in the
    usual case. ``side`` is evaluated for the count, so pass a stored or small
    frame of narrow rows.
    """
    fixed, sized = 0, F.lit(0)
    for field in side.schema.fields:
        if isinstance(field.dataType, T.AtomicType) and not isinstance(field.dataType, (T.StringType, T.BinaryType)):
            fixed += 16
        else:
            cell = quoted(field.name)
            held = cell if isinstance(field.dataType, T.BinaryType) else cell.cast("string")
            sized = sized + 16 + F.coalesce(F.octet_length(held), F.lit(0))
    n, total = side.agg(F.count(F.lit(1)), F.coalesce(F.sum((sized + fixed).cast("bigint")), F.lit(0))).first()
    return F.broadcast(side) if n <= limit and total <= BROADCAST_BYTES else side
