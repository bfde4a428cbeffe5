"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds documents in blocks of similar size.  A block is a matrix of
bits, one row per Bloom position and one column per document.  A document sets
``ROWS`` bits for every pair of one of its terms and a level; level j says that
the term comes 2^j times or more.  The conjunction of the rows of a pair is a
bitmap of the documents that may have it: never too few, sometimes too many.

A query sums, over its terms, the weight times the best value that the found
level and the length of the document allow.  These sums bound the score from
above.  The documents of highest bounds are scored exactly, their tenth score
is a threshold, and every document whose bound reaches it is scored exactly
too.  What is left out is proven to be no better, so the ranking is exact.

Queries are dealt in blocks of about ``QUERY_TERMS`` terms; only fingerprints,
weights and counts of one block are on the driver or broadcast.  Blocks of
documents are made within tasks, in bounded memory, without a shuffle.  Equal
texts have equal scores, so of those only the first ten by doc_id are scored
for a query.  Terms are 64-bit fingerprints: a false equality of some query
term and some term of the corpus has a chance of about their product / 2^64.

Defined cases: null or empty texts have no term and are never found; an item
without terms has no rows; repeated documents are documents of their own;
repeated equal items are one item, unequal ones under one item_id are ranked
each by itself; null doc_ids rank last among equal scores; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sextant.llm import flatwords
from sextant.scratch import materialize

#: Bits set for a pair of term and level, and the greatest level.
ROWS = 4
TOP = 7
#: Documents and pairs at which a block is full, and characters of texts taken up at a time.
BLOCK_DOCS = 512
BLOCK_PAIRS = 200_000
PORTION = 2_000_000
#: Terms of one query block, documents scored first for the threshold, items summed at a time.
QUERY_TERMS = 200_000
SEEDS = 20
ITEMS_AT_A_TIME = 32

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LEVEL_STEP = np.uint64(0xD1342543DE82EF95)
_STRIDE = np.uint64(0xA0761D6478BD642F)
BLOCK = "doc_ids array<long>, prints array<long>, sizes array<long>, height int, bits binary, terms array<int>, held array<long>"


def terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the terms of all texts in order, and the bounds of each text."""
    return flatwords.runs([(t or "").encode("utf-8", "replace").translate(_LOWER) for t in texts])


def _term_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, fingerprint and count of each distinct term of each text, and the number of terms per text."""
    found, bounds = terms(texts)
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(texts)), sizes)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], found[at], np.diff(np.append(at, len(found))), sizes


def _places(pairs: np.ndarray, height: int) -> np.ndarray:
    """Rows of each pair, as a matrix of ROWS columns."""
    first, step = flatwords.mix(pairs), flatwords.mix(pairs ^ _STRIDE) | np.uint64(1)
    turns = np.arange(ROWS, dtype=np.uint64)
    return ((first[:, None] + step[:, None] * turns) % np.uint64(height)).astype(np.int64)


def _block(docs: list[tuple]) -> tuple:
    """A row of the index for (doc_id, print, size, pairs) of some documents."""
    counts = np.array([len(d[3]) for d in docs])
    height = max(64, math.ceil(int(counts.max()) * ROWS / math.log(2)))
    columns = np.repeat(np.arange(len(docs)), counts)
    places = _places(np.concatenate([d[3] for d in docs]), height)
    bits = np.zeros((height, -(-len(docs) // 8) * 8), bool)
    for k in range(ROWS):
        bits[places[:, k], columns] = True
    return [d[0] for d in docs], [d[1] for d in docs], [d[2] for d in docs], height, np.packbits(bits, axis=1).tobytes(), None, None


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_ids", "prints", "sizes", "height", "bits", "terms", "held"], dtype=object).astype(
        {"height": "Int32"}
    )


def _indexer(wanted, signatures: bool) -> Callable:
    """Makes blocks of documents, and a last row with the documents that hold each wanted term."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted_terms = wanted.value
        held = np.zeros(len(wanted_terms), np.int64)
        pools: dict[int, list[tuple]] = {}
        filled: dict[int, int] = {}
        for batch in batches:
            texts, ids, prints = batch["text"].tolist(), batch["doc_id"].tolist(), batch["print"].tolist()
            ids = [None if pd.isna(i) else int(i) for i in ids]
            for begin, end in flatwords.portions(texts, PORTION):
                owner, found, count, sizes = _term_counts(texts[begin:end])
                if len(wanted_terms):
                    at = np.minimum(np.searchsorted(wanted_terms, found), len(wanted_terms) - 1)
                    held += np.bincount(at[wanted_terms[at] == found], minlength=len(held))
                if not signatures:
                    continue
                level = np.minimum(np.frexp(count)[1] - 1, TOP).astype(np.int64)
                each = level + 1
                first = np.cumsum(each) - each
                j = (np.arange(int(each.sum())) - np.repeat(first, each)).astype(np.uint64)
                pairs = np.repeat(found, each) + j * _LEVEL_STEP
                bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, weights=each, minlength=end - begin))]).astype(np.int64)
                done = []
                for d in np.flatnonzero(sizes).tolist():
                    own = pairs[bounds[d] : bounds[d + 1]].copy()
                    kind = len(own).bit_length()
                    pools.setdefault(kind, []).append((ids[begin + d], prints[begin + d], int(sizes[d]), own))
                    filled[kind] = filled.get(kind, 0) + len(own)
                    if len(pools[kind]) == BLOCK_DOCS or filled[kind] >= BLOCK_PAIRS:
                        done.append(_block(pools.pop(kind)))
                        filled[kind] = 0
                if done:
                    yield _frame(done)
        for kind in sorted(pools):
            yield _frame([_block(pools[kind])])
        some = np.flatnonzero(held)
        yield _frame([(None, None, None, None, None, some.tolist(), held[some].tolist())])

    return make


class _Queries:
    """Items of one block: their keys, terms and weights, and what the corpus makes of lengths."""

    def __init__(self, keys: list[tuple], vocabulary: np.ndarray, weights: np.ndarray, bounds: np.ndarray, members: np.ndarray):
        self.keys, self.vocabulary, self.weights, self.bounds, self.members = keys, vocabulary, weights, bounds, members
        self.docs = self.all_terms = 0
        self.least = np.ones(len(keys), np.int64)

    def damping(self, sizes: np.ndarray) -> np.ndarray:
        return 8 * (100 - 90 + (90 * sizes * self.docs) // self.all_terms)


def _levels(query: _Queries, height: int, bits: np.ndarray, docs: int) -> np.ndarray:
    """How many levels of each query term each document of a block may have."""
    found = np.zeros((len(query.vocabulary), docs), np.uint8)
    running = None
    for level in range(TOP + 1):
        places = _places(query.vocabulary + np.array([level], np.uint64) * _LEVEL_STEP, height)
        here = bits[places[:, 0]]
        for k in range(1, ROWS):
            here &= bits[places[:, k]]
        running = here if running is None else running & here
        if not running.any():
            break
        found += np.unpackbits(running, axis=1, count=docs)
    return found


def _block_bounds(query: _Queries, sizes: np.ndarray, height: int, packed: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Upper bounds of the scores of a block's documents, for some items at a time: (first item, items x documents)."""
    docs = len(sizes)
    bits = np.frombuffer(packed, np.uint8).reshape(height, -1)
    level = _levels(query, height, bits, docs)
    most = np.minimum((1 << np.arange(TOP + 2, dtype=np.int64))[:, None] - 1, sizes)
    most[TOP + 1] = sizes
    value = (1_000_000_000 * most) // (1000 * most + query.damping(sizes))
    value[0] = 0
    for begin in range(0, len(query.keys), ITEMS_AT_A_TIME):
        end = min(begin + ITEMS_AT_A_TIME, len(query.keys))
        members = query.members[query.bounds[begin] : query.bounds[end]]
        best = np.take_along_axis(value, level[members].astype(np.int64), axis=0)
        best *= query.weights[members][:, None]
        yield begin, np.add.reduceat(best, query.bounds[begin:end] - query.bounds[begin], axis=0)


def _rows_of(batch: pd.DataFrame) -> Iterator[tuple]:
    for ids, prints, sizes, height, packed in zip(*(batch[c] for c in ("doc_ids", "prints", "sizes", "height", "bits"))):
        yield ids, prints, np.asarray(sizes, np.int64), int(height), packed


def _highest(shared) -> Callable:
    """For each item the documents of highest bounds among those of a task."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query = shared.value
        best: list[list[tuple]] = [[] for _ in query.keys]
        for batch in batches:
            for ids, prints, sizes, height, packed in _rows_of(batch):
                for begin, bounds in _block_bounds(query, sizes, height, packed):
                    for k, row in enumerate(bounds, begin):
                        least = best[k][-1][0] if len(best[k]) == SEEDS else 0
                        above = np.flatnonzero(row > least)
                        if len(above) > SEEDS:
                            above = above[np.argpartition(row[above], -SEEDS)[-SEEDS:]]
                        if len(above):
                            more = best[k] + [(int(row[d]), ids[d], int(prints[d])) for d in above]
                            best[k] = sorted(more, key=lambda x: -x[0])[:SEEDS]
        out = [(k, bound, i, p) for k, found in enumerate(best) for bound, i, p in found]
        yield _named(out)

    return find


def _reaching(shared) -> Callable:
    """Every document whose bound reaches the least score that an item still takes."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query = shared.value
        for batch in batches:
            for ids, prints, sizes, height, packed in _rows_of(batch):
                out = []
                for begin, bounds in _block_bounds(query, sizes, height, packed):
                    items, docs = np.nonzero(bounds >= query.least[begin : begin + len(bounds), None])
                    out += [
                        (begin + int(k), int(bounds[k, d]), ids[d], int(prints[d])) for k, d in zip(items.tolist(), docs.tolist())
                    ]
                if out:
                    yield _named(out)

    return find


def _named(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["item", "bound", "doc_id", "print"], dtype=object)
    frame["doc_id"] = [None if pd.isna(i) else int(i) for i in frame["doc_id"]]
    return frame.astype({"item": "int32", "bound": "int64", "doc_id": "Int64", "print": "int64"})


def _scored(shared) -> Callable:
    """Exact scores of the wanted items in each text."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query = shared.value
        for batch in batches:
            texts = batch["text"].tolist()
            for begin, end in flatwords.portions(texts, PORTION):
                owner, found, count, sizes = _term_counts(texts[begin:end])
                bounds = np.searchsorted(owner, np.arange(end - begin + 1))
                damping = query.damping(sizes.astype(np.int64))
                out = []
                for d in range(end - begin):
                    own, times = found[bounds[d] : bounds[d + 1]], count[bounds[d] : bounds[d + 1]].astype(np.int64)
                    i = batch["doc_id"].iloc[begin + d]
                    for k in batch["items"].iloc[begin + d]:
                        members = query.members[query.bounds[k] : query.bounds[k + 1]]
                        at = np.minimum(np.searchsorted(own, query.vocabulary[members]), len(own) - 1)
                        tf = np.where(own[at] == query.vocabulary[members], times[at], 0)
                        total = int((query.weights[members] * ((1_000_000_000 * tf) // (1000 * tf + damping[d]))).sum())
                        out.append((int(k), None if pd.isna(i) else int(i), total))
                frame = pd.DataFrame(out, columns=["item", "doc_id", "score"], dtype=object)
                yield frame.astype({"item": "int32", "doc_id": "Int64", "score": "int64"})

    return score


def _item_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = batch["text"].tolist()
        for begin, end in flatwords.portions(texts, PORTION):
            owner, found, _, _ = _term_counts(texts[begin:end])
            part = batch.iloc[begin:end][["item_id", "a", "b"]].iloc[owner].reset_index(drop=True)
            part["term"] = found.view(np.int64)
            yield part


def _top(scored: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scored.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(documents: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k documents of highest score, by the rule of ``_scored``."""
    spark = documents.sparkSession
    text = F.coalesce("text", F.lit(""))
    docs = documents.select("doc_id", "text", F.xxhash64(text).alias("print"))
    asked = items.select("item_id", "text", F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    asked = asked.dropDuplicates(["item_id", "a", "b"]).mapInPandas(_item_terms, "item_id long, a long, b long, term long")
    asked = materialize(asked, "item-terms")
    parts = -(-asked.count() // QUERY_TERMS)
    results, index, totals = [], None, None
    for part in range(parts):
        here = asked.where(F.pmod(F.xxhash64("item_id", "a", "b"), F.lit(parts)) == part)
        rows = here.groupBy("item_id", "a", "b").agg(F.collect_list("term").alias("terms")).collect()
        if not rows:
            continue
        keys = [(r.item_id, r.a, r.b) for r in rows]
        lengths = [len(r.terms) for r in rows]
        together = np.concatenate([np.array(r.terms, np.int64).view(np.uint64) for r in rows])
        vocabulary, members = np.unique(together, return_inverse=True)
        wanted = spark.sparkContext.broadcast(vocabulary)
        counted = docs.mapInPandas(_indexer(wanted, index is None), BLOCK)
        counted = materialize(counted, "signatures")
        if index is None:
            index = counted.where("bits is not null")
            size = F.aggregate("sizes", F.lit(0).cast("long"), lambda t, x: t + x)
            totals = index.agg(F.sum(F.size("sizes")), F.sum(size)).first()
        if not totals[0]:
            continue
        pairs = counted.where("terms is not null").select(F.explode(F.arrays_zip("terms", "held")).alias("p"))
        held = np.zeros(len(vocabulary), np.int64)
        for r in pairs.groupBy("p.terms").agg(F.sum("p.held").alias("held")).collect():
            held[r.terms] = r.held
        weights = np.array([math.floor(1000 * math.log((2 * totals[0] + 2) / (2 * int(d) + 1))) for d in held], np.int64)
        query = _Queries(keys, vocabulary, weights, np.concatenate([[0], np.cumsum(lengths)]), members.reshape(-1))
        query.docs, query.all_terms = totals

        def exact(chosen: DataFrame, shared) -> DataFrame:
            """Scores of (item, doc_id, print) rows, each text read once."""
            by_doc = chosen.groupBy("doc_id", "print").agg(F.collect_set("item").alias("items"))
            by_doc = materialize(by_doc.withColumnsRenamed({"doc_id": "i", "print": "p"}), "to-score")
            found = docs.join(by_doc, F.col("print").eqNullSafe(F.col("p")) & F.col("doc_id").eqNullSafe(F.col("i")))
            return found.select("doc_id", "text", "items").mapInPandas(_scored(shared), "item int, doc_id long, score long")

        columns = "item int, bound long, doc_id long, print long"
        shared = spark.sparkContext.broadcast(query)
        highest = W.partitionBy("item").orderBy(F.desc("bound"), F.asc_nulls_last("doc_id"), "print")
        seeds = index.mapInPandas(_highest(shared), columns)
        seeds = seeds.withColumn("r", F.row_number().over(highest)).where(F.col("r") <= SEEDS)
        tenth = _top(exact(seeds, shared), k).groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        for r in tenth.where(F.col("n") == k).collect():
            query.least[r.item] = r.least
        narrowed = spark.sparkContext.broadcast(query)
        reaching = materialize(index.mapInPandas(_reaching(narrowed), columns), "reaching").dropDuplicates(["item", "doc_id", "print"])
        alike = W.partitionBy("item", "print").orderBy(F.asc_nulls_last("doc_id"))
        chosen = reaching.withColumn("r", F.row_number().over(alike)).where(F.col("r") <= k)
        named = spark.createDataFrame([(n, *key) for n, key in enumerate(keys)], "item int, item_id long, a long, b long")
        best = materialize(_top(exact(chosen, narrowed), k), "ranked")
        results.append(best.join(F.broadcast(named.select("item", "item_id")), "item").select("item_id", "rank", "doc_id", "score"))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for r in results:
        out = out.unionByName(r)
    return out
