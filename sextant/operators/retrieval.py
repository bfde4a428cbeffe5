"""Exact nearest vectors from stored pivot partitions.

A sample gives pivots; every vector lies in the partition of its nearest pivot
and there in a ring of distances to it. Such a cell bounds how near any of its
vectors can be to a query: the triangle inequality gives the distance to the
ring, and half the difference of the distances to two pivots gives the distance
to the border between their partitions. A query first searches the cells of
lowest bound that hold k vectors; their k-th distance is a threshold, and only
cells whose bound is within it are searched after that. No cell that is left
out can hold a nearer vector, so the result is exact.

Cells are dealt into shards of bounded size and the queries that meet a cell
into blocks, so a task holds one shard and one block. The pivots and the table
of cells have a fixed greatest size and are all that the driver sees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sextant.operators.joins import small_side
from sextant.scratch import materialize

QUERY_BLOCK = 2048
SHARD_ROWS = 100_000
CHUNK_ROWS = 4096
#: Vectors a cell should hold, the most pivots and rings there are, and vectors the pivots are fitted on.
CELL_ROWS = 4096
MOST_PIVOTS = 256
MOST_RINGS = 64
SAMPLE = 4096
FIT_ROUNDS = 5


def _distances(asked: np.ndarray, matrix: np.ndarray, metric: str) -> np.ndarray:
    squares, lengths = (asked * asked).sum(axis=1)[:, None], (matrix * matrix).sum(axis=1)[None, :]
    dots = asked @ matrix.T
    if metric == "cosine":
        norm = np.sqrt(squares * lengths)
        return np.round(1.0 - np.divide(dots, norm, out=np.zeros_like(dots), where=norm > 0), 9)
    return np.round(np.maximum(squares + lengths - 2.0 * dots, 0.0), 9)


def _best(asked: np.ndarray, matrix: np.ndarray, ids: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, ...]:
    """(query place, distance, id) of the k nearest per query, ties to the smaller id, chunk after chunk."""
    row, near, who = np.empty(0, np.int64), np.empty(0), np.empty(0, ids.dtype)
    for start in range(0, len(matrix), CHUNK_ROWS):
        d = _distances(asked, matrix[start : start + CHUNK_ROWS], metric)
        if d.shape[1] > k:
            r, c = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k])
        else:
            r, c = np.nonzero(np.ones_like(d, bool))
        row, near, who = np.append(row, r), np.append(near, d[r, c]), np.append(who, ids[start + c])
        order = np.lexsort((who, near, row))
        row, near, who = row[order], near[order], who[order]
        first = np.searchsorted(row, np.arange(len(asked)))
        keep = np.arange(len(row)) - first[row] < k
        row, near, who = row[keep], near[keep], who[keep]
    return row, near, who


def _placed(matrix: np.ndarray, metric: str) -> np.ndarray:
    """Vectors in the space whose Euclidean distance the bounds are about; for cosine those of length one (or zero)."""
    if metric != "cosine":
        return matrix
    length = np.sqrt((matrix * matrix).sum(axis=1))[:, None]
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def _pivots(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Spread-out vectors of a sample, moved to the middle of what is nearest to them."""
    chosen = [0]
    away = _apart(sample, sample[:1])[:, 0]
    while len(chosen) < wanted and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, _apart(sample, sample[chosen[-1:]])[:, 0])
    pivots = sample[chosen]
    for _ in range(FIT_ROUNDS):
        nearest = _apart(sample, pivots).argmin(axis=1)
        counts = np.bincount(nearest, minlength=len(pivots))[:, None]
        sums = np.zeros_like(pivots)
        np.add.at(sums, nearest, sample)
        pivots = np.where(counts > 0, sums / np.maximum(counts, 1), pivots)
    return pivots


@dataclass
class Cells:
    """What a query needs to know about all cells."""

    metric: str
    pivots: np.ndarray
    pivot: np.ndarray
    ring: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray

    def bounds(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least distance, as reported, that any vector of a cell can have from each query; and that of its pivot."""
        place = _placed(asked, self.metric)
        to_pivot = _apart(place, self.pivots)
        nearest = to_pivot.min(axis=1, keepdims=True)
        at = to_pivot[:, self.pivot]
        least = np.maximum(np.maximum(self.low - at, at - self.high), (at - nearest) / 2)
        # Distances from sums of squares are off by the root of the last digits of the vectors' own lengths.
        lengths = np.sqrt((place * place).sum(axis=1))[:, None] + np.sqrt((self.pivots**2).sum(axis=1))[self.pivot]
        slack = 1e-6 * (1 + at + self.high) + 1e-7 * lengths
        squared = np.maximum(least - slack, 0.0) ** 2
        if self.metric == "cosine":
            squared /= 2
            squared[:, self.low < 0] = 1.0  # vectors of no length: always at distance 1
            squared[(asked * asked).sum(axis=1) == 0] = 1.0
        return squared, at

    def first(self, asked: np.ndarray, k: int) -> np.ndarray:
        """Cells of lowest bound that hold k vectors together, per query."""
        least, at = self.bounds(asked)
        order = np.lexsort((at, least), axis=1)
        held = np.cumsum(self.rows[order], axis=1)
        needed = held - self.rows[order] < k
        chosen = np.zeros(least.shape, bool)
        np.put_along_axis(chosen, order, needed, axis=1)
        return chosen


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64")


def _usable(rows: DataFrame, key: str) -> DataFrame:
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")))
    return rows.where(whole).select(key, "embedding")


@dataclass
class Found:
    hits: DataFrame
    #: (query_id, visited, cells): how many of all cells each query searched.
    visits: DataFrame


class PivotIndex:
    """Stored cells of the vectors of (vec_id, embedding); made once, searched any number of times."""

    def __init__(self, vectors: DataFrame, metric: str = "l2", cell_rows: int = CELL_ROWS, shard_rows: int = SHARD_ROWS):
        self.spark = vectors.sparkSession
        self.metric, self.shard_rows = metric, shard_rows
        usable = _usable(vectors, "vec_id")
        self.id_type = vectors.schema["vec_id"].dataType.simpleString()
        n = usable.count()
        parts = math.ceil(n / cell_rows)
        self.cells = None
        if parts <= 1:  # nothing to choose between
            if n:
                one = np.zeros(1, int)
                self.cells = Cells(metric, np.zeros((1, 1)), one, one, np.zeros(1), np.full(1, math.inf), np.full(1, n))
                shards = math.ceil(n / shard_rows)
                dealt = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int")
                self.stored = usable.select("vec_id", "embedding", F.lit(0).alias("cell"), dealt.alias("shard"))
                self.shards = self.spark.createDataFrame([(0, shards)], "cell int, shards int")
            return
        ticket = F.xxhash64("embedding")
        picked = usable.select("embedding", ticket.alias("t")).orderBy("t").limit(SAMPLE).collect()
        sample = _placed(np.array(sorted({tuple(r["embedding"]) for r in picked}), "float64"), metric)
        pivots = _pivots(sample, min(MOST_PIVOTS, math.ceil(math.sqrt(parts))))
        rings = min(MOST_RINGS, math.ceil(parts / len(pivots)))

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if batch.empty:
                    continue
                matrix = _matrix(batch["embedding"])
                apart = _apart(_placed(matrix, metric), pivots)
                nearest = apart.argmin(axis=1)
                away = apart[np.arange(len(batch)), nearest]
                if metric == "cosine":
                    away = np.where((matrix * matrix).sum(axis=1) > 0, away, -1.0)
                yield batch.assign(pivot=nearest.astype("int32"), away=away)

        schema = f"vec_id {self.id_type}, embedding array<double>, pivot int, away double"
        doubles = usable.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        placed = materialize(doubles.mapInPandas(place, schema), "placed")
        cuts = [k / rings for k in range(1, rings)]
        celled = placed.withColumn("ring", F.lit(0))
        if cuts:
            edges = placed.where("away >= 0").groupBy("pivot").agg(F.percentile_approx("away", cuts, 1000).alias("cuts"))
            inner = F.size(F.filter("cuts", lambda x: x < F.col("away")))
            ring = F.when(F.col("away") < 0, -1).otherwise(F.coalesce(inner, F.lit(0)))
            celled = placed.join(F.broadcast(edges), "pivot", "left").withColumn("ring", ring).drop("cuts")
        elif metric == "cosine":
            celled = placed.withColumn("ring", F.when(F.col("away") < 0, -1).otherwise(0))
        facts = celled.groupBy("pivot", "ring").agg(F.min("away"), F.max("away"), F.count("*")).collect()
        facts = np.array(sorted(tuple(r) for r in facts), "float64")
        self.cells = Cells(
            metric, pivots, facts[:, 0].astype(int), facts[:, 1].astype(int), facts[:, 2], facts[:, 3], facts[:, 4]
        )
        shards = [(int(p), int(r), i, math.ceil(c / shard_rows)) for i, (p, r, c) in enumerate(facts[:, [0, 1, 4]].tolist())]
        named = self.spark.createDataFrame(shards, "pivot int, ring int, cell int, shards int")
        dealt = celled.join(F.broadcast(named), ["pivot", "ring"]).select(
            "vec_id", "embedding", "cell", F.pmod(F.xxhash64("vec_id", "embedding"), F.col("shards")).cast("int").alias("shard")
        )
        # Vectors of one cell lie together, so that a search for few cells skips most of the files' row groups.
        self.stored = materialize(dealt.repartition("cell", "shard").sortWithinPartitions("cell"), "pivot-cells")
        self.shards = self.spark.createDataFrame([(i, s) for _, _, i, s in shards], "cell int, shards int")

    def _meet(self, asked: DataFrame, k: int, after: bool) -> DataFrame:
        """Each query with the cells it searches first, or with those within its threshold that come after."""
        cells = self.cells

        def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for begin in range(0, len(batch), QUERY_BLOCK):
                    part = batch.iloc[begin : begin + QUERY_BLOCK]
                    matrix = _matrix(part["embedding"])
                    chosen = cells.first(matrix, k)
                    if after:
                        within = cells.bounds(matrix)[0] <= part["threshold"].to_numpy()[:, None]
                        chosen = within & ~chosen
                    row, cell = np.nonzero(chosen)
                    yield part.iloc[row].assign(cell=cell.astype("int32"))

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema.fields)
        return asked.mapInPandas(meet, f"{fields}, cell int")

    def _searched(self, met: DataFrame, k: int, blocks: int, kind: str) -> DataFrame:
        left = met.join(F.broadcast(self.shards), "cell").select(
            "_q", "query_id", "embedding", "cell", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"),
            F.pmod(F.xxhash64("_q"), F.lit(blocks)).cast("int").alias("block"),
        )
        if len(self.cells.rows) > 1:
            needed = materialize(left.select("cell", "shard", "block").distinct(), "cells-met")
            wanted = [r["cell"] for r in needed.select("cell").distinct().collect()]  # of a fixed number of cells
            right = self.stored.where(F.col("cell").isin(wanted)).join(small_side(needed), ["cell", "shard"])
        else:
            right = self.stored.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        metric = self.metric

        def search(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
            if q.empty or v.empty:
                none = pd.concat([q[["_q", "query_id"]].iloc[:0], v[["vec_id"]].iloc[:0]], axis=1)
                return none.assign(distance=np.zeros(0))
            codes, ids = pd.factorize(v["vec_id"], sort=True, use_na_sentinel=False)
            row, near, who = _best(_matrix(q["embedding"]), _matrix(v["embedding"]), codes, k, metric)
            hits = q[["_q", "query_id"]].iloc[row].reset_index(drop=True)
            return hits.assign(vec_id=np.asarray(ids)[who], distance=near)

        keys = ["cell", "shard", "block"]
        return (
            left.groupBy(*keys)
            .cogroup(right.groupBy(*keys))
            .applyInPandas(search, f"_q long, query_id {kind}, vec_id {self.id_type}, distance double")
        )

    def search(self, queries: DataFrame, k: int = 5, block: int = QUERY_BLOCK) -> Found:
        """The k nearest vectors of each row of (query_id, embedding), ties to the smaller id."""
        kind = queries.schema["query_id"].dataType.simpleString()
        hits = f"query_id {kind}, vec_id {self.id_type}, distance double, rank bigint"
        if self.cells is None:
            none = self.spark.createDataFrame
            return Found(none([], hits), none([], f"query_id {kind}, visited bigint, cells bigint"))
        asked = _usable(queries, "query_id").select(
            "query_id", F.col("embedding").cast("array<double>").alias("embedding"), F.monotonically_increasing_id().alias("_q")
        )
        asked = materialize(asked, "queries")  # fixes the row numbers
        blocks = max(1, math.ceil(asked.count() / block))
        several = len(self.cells.rows) > 1
        met = materialize(self._meet(asked, k, False), "cells-first") if several else asked.withColumn("cell", F.lit(0))
        found = self._searched(met, k, blocks, kind)
        visits = met.select("_q", "query_id", "cell")
        if several:
            found = materialize(found, "hits-first")
            order = W.partitionBy("_q").orderBy("distance", "vec_id")
            last = found.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("_q", F.col("distance").alias("threshold"))
            open_ended = asked.join(last, "_q", "left").fillna(math.inf, ["threshold"])
            later = materialize(self._meet(open_ended, k, True).drop("threshold"), "cells-after")
            if not later.isEmpty():
                found = found.unionByName(self._searched(later, k, blocks, kind))
            visits = visits.unionByName(later.select("_q", "query_id", "cell"))
        order = W.partitionBy("_q").orderBy("distance", "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k).drop("_q")
        counted = visits.groupBy("_q", "query_id").agg(F.count("*").alias("visited")).drop("_q")
        return Found(ranked, counted.withColumn("cells", F.lit(len(self.cells.rows)).cast("bigint")))


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, metric: str = "l2", block: int = QUERY_BLOCK,
    shard_rows: int = SHARD_ROWS, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Exact k nearest vectors per query row from (vec_id, embedding) and (query_id, embedding).

    ``metric`` is ``l2`` (squared Euclidean) or ``cosine`` (1 - similarity; a
    vector of no length is at 1 from all). Rows without a vector, or with a
    missing number in it, are left out; ids may have any type; a repeated query
    id is searched once per row.
    """
    return PivotIndex(vectors, metric, cell_rows, shard_rows).search(queries, k, block).hits
