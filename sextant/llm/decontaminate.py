"""Benchmark passages in documents: SimHash windows, multi-index Hamming blocks, exact likeness.

For every benchmark item the windows are as long as the item, at every word of
every document.  A window and an item are alike if the weighted Jaccard
coefficient of their five-word shingle multisets is LIKE or more.

*Fingerprints.*  A window's SimHash adds up its shingles' bits; windows of one
length come from running sums, so each costs one subtraction.  Windows that
cannot reach LIKE because too few of their shingles occur in any item of that
length are not fingerprinted: the bound is exact.

*Index.*  Fingerprints are cut into BLOCKS blocks.  Two fingerprints within
RADIUS agree in some block up to RADIUS // BLOCKS bits, so looking up near
block values finds every item within the radius.  At a likeness of 0.8 the
distance is 9.7 on average with a deviation of 2.9; RADIUS is 4.3 deviations
above it.

*Check.*  The exact likeness decides, so no chance match is reported.

The item side is cut into parts of at most PART_SHINGLES shingles; each part
travels with the tasks and is held against all documents in one pass.
Documents never move.  Defined cases: null and empty texts and items match
nothing; items of fewer than five words count as one shingle of all their
words; repeated rows give their own rows; empty tables give an empty result;
only key and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm import flatwords
from sextant.operators.joins import small_side
from sextant.scratch import materialize

LIKE = 0.8
BITS, RADIUS, BLOCKS = 64, 22, 4
PART_SHINGLES = 2_000_000
#: Windows fingerprinted at a time.
WINDOWS = 20_000
#: Cells of the table (query, block value) looked at at a time.
CELLS = 4_000_000

_BIT = np.arange(BITS, dtype=np.uint64)
_ONES = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    out = np.zeros(x.shape, np.uint8)
    for shift in (0, 16, 32, 48):
        out += _ONES[((x >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64)]
    return out


def bit_sums(shingle: np.ndarray) -> np.ndarray:
    """Running sums of the shingles' bits as +1 and -1, from zero shingles to all."""
    signs = ((flatwords.mix(shingle)[:, None] >> _BIT) & np.uint64(1)).astype(np.int8) * 2 - 1
    return np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(signs, axis=0, dtype=np.int32)])


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """SimHash of each row of summed signs."""
    return ((sums > 0).astype(np.uint64) << _BIT).sum(axis=1, dtype=np.uint64)


class HammingIndex:
    """Items by blocks of their fingerprints; ``near`` gives every item within the radius."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.width = BITS // BLOCKS
        self.blocks = []
        for k in range(BLOCKS):
            value = self._block(prints, k)
            order = np.argsort(value, kind="stable")
            distinct, start = np.unique(value[order], return_index=True)
            self.blocks.append((distinct, np.append(start, len(value)), order))

    def _block(self, prints: np.ndarray, k: int) -> np.ndarray:
        return ((prints >> np.uint64(k * self.width)) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, item) within RADIUS, each once."""
        step = max(1, CELLS // max(1, max(len(b[0]) for b in self.blocks)))
        parts = [self._near(queries[a : a + step], a) for a in range(0, len(queries), step)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _near(self, queries: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for k, (distinct, start, order) in enumerate(self.blocks):
            q, d = np.nonzero(_ONES[self._block(queries, k)[:, None] ^ distinct] <= RADIUS // BLOCKS)
            counts = start[d + 1] - start[d]
            place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            q, item = np.repeat(q, counts), order[np.repeat(start[d], counts) + place]
            close = _distance(queries[q], self.prints[item]) <= RADIUS
            found.append(q[close] * len(self.prints) + item[close])
        pairs = np.unique(np.concatenate(found))
        return first + pairs // len(self.prints), pairs % len(self.prints)


class Items:
    """One part of the benchmark, grouped by length in words."""

    def __init__(self, ids: list, texts: list[str]):
        word, bounds = flatwords.words(texts)
        shingle, cut = flatwords.shingles(word, bounds)
        self.ids = ids
        self.length = np.diff(bounds)
        self.sets = [flatwords.counted(shingle[a:b]) for a, b in zip(cut, cut[1:])]
        prints = np.array(
            [fingerprint(bit_sums(shingle[a:b])[-1:])[0] for a, b in zip(cut, cut[1:])], np.uint64
        ).reshape(-1)
        self.groups = {}
        for size in np.unique(self.length[self.length > 0]):
            mine = np.flatnonzero(self.length == size)
            known = np.unique(np.concatenate([self.sets[i][0] for i in mine]))
            self.groups[int(size)] = (mine, HammingIndex(prints[mine]), known)
        every = [g[2] for g in self.groups.values()]
        self.known = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.known >> np.uint64(44)).astype(np.int64)] = True

    def is_known(self, shingle: np.ndarray, known: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(known, shingle), len(known) - 1)
        return known[place] == shingle

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, float]]:
        """(text, item, first word, likeness): per text and item the most alike window, the earliest of equals."""
        best: dict[tuple[int, int], tuple[float, int]] = {}
        if not self.groups:
            return []
        word, bounds = flatwords.words(texts)
        # Shingles at every word; near a text's end they are of fewer words and no full shingle.
        full, cut = flatwords.shingles(word, bounds)
        hit = self.maybe[(full >> np.uint64(44)).astype(np.int64)]
        hit[hit] = self.is_known(full[hit], self.known)
        owner = np.repeat(np.arange(len(texts)), np.diff(cut))
        for t in np.unique(owner[hit]):
            words_here = word[bounds[t] : bounds[t + 1]]
            self._search_one(int(t), words_here, full[cut[t] : cut[t + 1]], best)
        short = [s for s in self.groups if s < flatwords.SHINGLE]
        for size in short:
            for t in range(len(texts)):
                words_here = word[bounds[t] : bounds[t + 1]]
                if len(words_here) > size:
                    n = len(words_here) - size + 1
                    windows = np.concatenate([words_here[i : i + size] for i in range(n)])
                    prints, _ = flatwords.shingles(windows, np.arange(n + 1) * size)
                    self._take(int(t), size, prints, np.arange(n), np.ones(n, np.int64), best)
        return [(t, i, s, like) for (t, i), (like, s) in sorted(best.items())]

    def _search_one(self, t: int, words_here: np.ndarray, shingle: np.ndarray, best: dict) -> None:
        for size, (_, _, known) in self.groups.items():
            span = min(size, len(words_here))
            wide = max(1, span - flatwords.SHINGLE + 1)
            whole = max(1, size - flatwords.SHINGLE + 1)
            if len(words_here) >= flatwords.SHINGLE > size:
                continue  # items of fewer words than a shingle are looked for apart
            count = np.concatenate([[0], np.cumsum(self.is_known(shingle, known))])
            inside = count[wide:] - count[:-wide]
            # A likeness of LIKE needs as many shared shingles as LIKE times the item's.
            start = np.flatnonzero(inside >= np.ceil(LIKE * whole - 1e-9))
            for a in range(0, len(start), WINDOWS):
                part = start[a : a + WINDOWS]
                self._take(t, size, shingle, part, np.full(len(part), wide), best)

    def _take(self, t: int, size: int, shingle: np.ndarray, start: np.ndarray, wide: np.ndarray, best: dict) -> None:
        mine, index, _ = self.groups[size]
        if not len(start):
            return
        low, high = int(start[0]), int((start + wide).max())
        sums = bit_sums(shingle[low:high])
        prints = fingerprint(sums[start - low + wide] - sums[start - low])
        for q, k in zip(*index.near(prints)):
            item, s = int(mine[k]), int(start[q])
            if best.get((t, item), (0.0, 0))[0] == 1.0:
                continue
            like = flatwords.weighted_jaccard(flatwords.counted(shingle[s : s + int(wide[q])]), self.sets[item])
            if like >= LIKE and like > best.get((t, item), (0.0, 0))[0]:
                best[(t, item)] = (like, s)


def _parts(items: DataFrame, item_key: str, item_text: str) -> Iterator[tuple[list, list[str]]]:
    """The benchmark in parts of bounded size, one after the other on the driver."""
    ids: list = []
    texts: list[str] = []
    total = 0
    for row in items.select(item_key, item_text).where(F.col(item_text).isNotNull()).toLocalIterator():
        n = row[1].count(" ") + row[1].count("\n") + 1
        if ids and total + n > PART_SHINGLES:
            yield ids, texts
            ids, texts, total = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        total += n
    yield ids, texts


def matches(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Rows (key, item, first_word, likeness): each item found in each document, at its most alike window."""
    pairs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind, item_kind = pairs.schema["id"].dataType.simpleString(), items.schema[item_key].dataType.simpleString()

    def searcher(ids: list, texts: list[str]):
        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            part = Items(ids, texts)
            for batch in batches:
                keys, bodies = batch["id"].to_numpy(), batch["text"].tolist()
                for a, b in flatwords.portions(bodies):
                    found = part.search(bodies[a:b])
                    if found:
                        t, i, s, like = zip(*found)
                        yield pd.DataFrame(
                            {"id": keys[a:b][list(t)], "item": [part.ids[x] for x in i], "first_word": s, "likeness": like}
                        )

        return search

    schema = f"id {kind}, item {item_kind}, first_word long, likeness double"
    found = [pairs.mapInPandas(searcher(*p), schema) for p in _parts(items, item_key, item_text)]
    return reduce(DataFrame.union, found).select(
        F.col("id").alias(key), F.col("item").alias(item_key), "first_word", F.round("likeness", 6).alias("likeness")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The input rows whose text holds no benchmark passage; input columns only.

    Rows are told apart by the digest of their text, so keys may be null or repeated.
    """
    digest = F.sha2(F.col(f"`{text}`"), 256)
    hit = matches(docs.select(digest.alias("digest"), F.col(f"`{text}`").alias("text")), items, key="digest")
    hit = materialize(hit.select("digest").distinct(), "contaminated")
    return docs.join(small_side(hit), digest == hit["digest"], "left_anti")
