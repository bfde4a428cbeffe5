"""Near-duplicate category labels, of columns with any number of labels.

Labels are compared by their normal form (lower case letters and digits) and
grouped greedily: the most frequent label that is in no group yet is a seed and
takes all like labels that are left.  The same groups come from two steps:

* leaders: the next few labels of every column are settled among themselves and
  then compared with all others in parallel.  A column of few labels, or of
  labels that are nearly all alike, ends here;
* an inverted index for what is left, once leaders take little: pairs that can
  be alike meet at rare characters, the pairs that are alike are the edges of a
  graph, and seeds are found in rounds, each label waiting for the more
  frequent ones beside it.

The filters of the index are exact.  A ratio of t or more between texts of T
characters together needs t/2 * T characters in common, so the shorter has at
least t / (2 - t) of the longer's length, and, with the characters of each in
one fixed order, two of those in common are among the first of both.  Labels
that hold one another meet at the rarest five characters of the shorter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import BooleanType

from sextant.columns import empty_like, quoted, text_columns
from sextant.functions.similarity import MATCH_RATIO, alike, normalized
from sextant.operators.frequencies import columns_within, value_frequencies
from sextant.operators.joins import small_side
from sextant.operators.ordering import number_rows
from sextant.operators.profile import infer_types, numbers_as_text
from sextant.scratch import materialize

# Fixed value: a column with more labels than this is never compared pair by pair in one row.
MAX_LABELS = 80
GROUP_SCHEMA = "column string, group_no bigint, label string, n bigint"

#: Labels of a column settled at a time, and how many each must take on average for another round of leaders.
LEADERS = 128
TAKEN = 16
GRAM = 5
_SIGNS = "0123456789abcdefghijklmnopqrstuvwxyz"


def all_labels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, label, n) of trimmed non-empty labels; copies collapse before the shuffle."""
    return (
        value_frequencies(df, columns)
        .select("column", F.trim("value").alias("label"), "n")
        .where("label != ''")
        .groupBy("column", "label")
        .agg(F.sum("n").alias("n"))
    )


def category_columns(df: DataFrame) -> DataFrame:
    """(column, status) of every text column: ``categories``, or what else its cells are (numbers or dates)."""
    columns = text_columns(df)
    if not columns:
        return empty_like(df, "column string, status string")
    texts = df.select(*[quoted(c) for c in columns])
    numbers = numbers_as_text(texts).select("column", F.lit("numbers").alias("as_text"))
    status = F.when(F.col("inferred") == "string", F.coalesce("as_text", F.lit("categories"))).otherwise(F.col("inferred"))
    return infer_types(texts).join(numbers, "column", "left").select("column", status.alias("status"))


def label_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, label, n) of the columns with 2 to 80 trimmed labels.

    A sketch keeps free-text columns out of the shuffle; the exact gate follows.
    """
    columns = columns_within(df, list(columns or text_columns(df)), MAX_LABELS)
    if not columns:
        return empty_like(df, "column string, label string, n bigint")
    trimmed = all_labels(df, columns)
    gate = trimmed.groupBy("column").agg(F.count("*").alias("k")).where(F.col("k").between(2, MAX_LABELS))
    return trimmed.join(gate.select("column"), "column", "left_semi")


# -- leaders ------------------------------------------------------------------


def _sign_counts(plain: Sequence[str]) -> np.ndarray:
    """How often each of the 36 characters comes in each text."""
    out = np.zeros((len(plain), len(_SIGNS)), np.int32)
    for row, text in enumerate(plain):
        found = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=128)
        out[row, :10], out[row, 10:] = found[48:58], found[97:123]
    return out


def _needed(threshold: float, together: np.ndarray | int) -> np.ndarray:
    """Characters in common that a ratio of the threshold needs."""
    return np.ceil(np.asarray(together) * threshold / 2 - 1e-9).astype(np.int64)


def _greedy(ordered: list[tuple], threshold: float) -> tuple[list[tuple], list[tuple]]:
    """Seeds among (key, plain) in order, and (plain, key of its seed) of the others."""
    seeds, taken = [], []
    for key, plain in ordered:
        seed = next((k for k, p in seeds if alike(p, plain, threshold)), None)
        if seed is None:
            seeds.append((key, plain))
        else:
            taken.append((plain, seed))
    return seeds, taken


def _taker(seeds: dict[str, list[tuple]], threshold: float):
    """Adds to rows of (column, plain, ...) the place of the first like seed of their column."""
    counts = {c: _sign_counts([p for _, p in s]) for c, s in seeds.items()}

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seed = np.full(len(batch), -1, np.int64)
            for column, part in batch.groupby("column", sort=False):
                mine, theirs = part["plain"].tolist(), seeds.get(column, [])
                at = batch.index.get_indexer(part.index)
                own = _sign_counts(mine)
                for begin in range(0, len(mine) if theirs else 0, 4096):
                    stop = min(begin + 4096, len(mine))
                    common = np.zeros((stop - begin, len(theirs)), np.int64)
                    for sign in range(len(_SIGNS)):
                        common += np.minimum(own[begin:stop, sign, None], counts[column][None, :, sign])
                    sizes = own[begin:stop].sum(axis=1)[:, None] + counts[column].sum(axis=1)[None, :]
                    shorter = np.minimum(own[begin:stop].sum(axis=1)[:, None], counts[column].sum(axis=1)[None, :])
                    maybe = (common >= _needed(threshold, sizes)) | (common == shorter)
                    for row in np.flatnonzero(maybe.any(axis=1)).tolist():
                        for k in np.flatnonzero(maybe[row]).tolist():
                            if alike(theirs[k][1], mine[begin + row], threshold):
                                seed[at[begin + row]] = k
                                break
            yield batch.assign(seed=seed)

    return take


def _led(left: DataFrame, threshold: float) -> tuple[list[DataFrame], DataFrame | None]:
    """Rounds of leaders: settled (column, plain, seed) in parts, and what no leader is like."""
    spark = left.sparkSession
    parts: list[DataFrame] = []
    order = W.partitionBy("column").orderBy("first_n", "first_label")
    while True:
        ranked = left.withColumn("r", F.row_number().over(order)).where(F.col("r") <= LEADERS)
        seeds, named = {}, []
        for r in sorted(ranked.collect(), key=lambda r: (r["column"], r["r"])):
            seeds.setdefault(r["column"], []).append((r["r"], r["plain"]))
        settled, more = 0, any(len(batch) == LEADERS for batch in seeds.values())
        for column, batch in seeds.items():
            chosen, taken = _greedy(batch, threshold)
            place = {key: p for key, p in chosen}
            seeds[column] = chosen
            settled += len(batch)
            named += [(column, p, p) for _, p in chosen] + [(column, p, place[k]) for p, k in taken]
        if not named:
            return parts, None
        done = spark.createDataFrame(named, "column string, plain string, seed string")
        parts.append(done)
        if not more:
            return parts, None
        rest = left.join(F.broadcast(done.select("column", "plain")), ["column", "plain"], "left_anti")
        schema = "column string, plain string, first_n bigint, first_label string, seed bigint"
        judged = materialize(rest.select("column", "plain", "first_n", "first_label").mapInPandas(_taker(seeds, threshold), schema), "led")
        plain_of = [(c, i, p) for c, s in seeds.items() for i, (_, p) in enumerate(s)]
        names = spark.createDataFrame(plain_of, "column string, seed bigint, seed_plain string")
        absorbed = judged.where("seed >= 0").join(F.broadcast(names), ["column", "seed"])
        parts.append(absorbed.select("column", "plain", F.col("seed_plain").alias("seed")))
        left = judged.where("seed < 0").drop("seed")
        taken, remaining = judged.agg(F.count_if(F.col("seed") >= 0), F.count_if(F.col("seed") < 0)).first()
        if not remaining:
            return parts, None
        if taken < TAKEN * settled:
            return parts, left


# -- inverted index -----------------------------------------------------------


def _tokens(order: dict[str, int], threshold: float, pairs: bool):
    """Adds to rows their characters as numbered tokens, rarest first, and the (pairs of) tokens they are found by."""
    shorter = threshold / (2 - threshold)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tokens, keys = [], []
            for plain in batch["plain"]:
                seen: dict[str, int] = {}
                own = []
                for sign in plain:
                    seen[sign] = seen.get(sign, 0) + 1
                    # A later occurrence of a character is rarer; any one order is right.
                    rank = min(order[sign] // seen[sign] ** 2, (1 << 22) - 1)
                    own.append((rank << 40) + seen[sign] * len(_SIGNS) + _SIGNS.index(sign))
                own.sort()
                least = int(_needed(threshold, len(own) + math.ceil(shorter * len(own) - 1e-9)))
                first = own[: max(0, len(own) - least + (2 if pairs else 1))]
                tokens.append(own)
                keys.append(
                    [(a, b) for i, a in enumerate(first) for b in first[i + 1 :]] if pairs else [(a, a) for a in first]
                )
            batch = batch.assign(tokens=tokens)
            batch["a"] = [[a for a, _ in k] for k in keys]
            batch["b"] = [[b for _, b in k] for k in keys]
            yield batch

    return make


@F.pandas_udf(BooleanType())
def _alike(a: pd.Series, b: pd.Series, threshold: pd.Series) -> pd.Series:
    return pd.Series([alike(x, y, t) for x, y, t in zip(a, b, threshold)], dtype=bool)


def _ratio_pairs(left: DataFrame, threshold: float) -> DataFrame:
    """Pairs of normal forms whose ratio reaches the threshold, the more frequent one first."""
    totals = left.agg(*[F.sum(F.length("plain") - F.length(F.replace("plain", F.lit(s)))).alias(s) for s in _SIGNS]).first()
    order = {s: int(totals[s] or 0) for s in _SIGNS}
    pairs = threshold > 2 / 3
    schema = (
        "column string, plain string, first_n bigint, first_label string, tokens array<bigint>, a array<bigint>, b array<bigint>"
    )
    rows = left.select("column", "plain", "first_n", "first_label")
    made = materialize(rows.mapInPandas(_tokens(order, threshold, pairs), schema), "tokens")
    key = F.struct("first_n", "first_label").alias("key")
    found_by = made.select("column", "plain", key, "tokens", F.inline(F.arrays_zip("a", "b"))).withColumnsRenamed(
        {"a": "t1", "b": "t2"}
    )
    x, y = found_by.alias("x"), found_by.alias("y")
    length_x, length_y = F.size("x.tokens"), F.size("y.tokens")
    common = F.array_intersect("x.tokens", "y.tokens")
    both = F.array("x.t1", "x.t2") if pairs else F.array("x.t1")
    near = (
        (F.col("x.column") == F.col("y.column")) & (F.col("x.t1") == F.col("y.t1")) & (F.col("x.t2") == F.col("y.t2"))
        & (F.col("x.key") < F.col("y.key"))
        & (F.least(length_x, length_y) >= F.greatest(length_x, length_y) * (threshold / (2 - threshold)) - 1e-9)
        & (F.size(common) >= F.ceil((length_x + length_y) * threshold / 2 - 1e-9))
        & (F.slice(common, 1, 2 if pairs else 1) == both)
    )
    met = x.join(y, near).select(
        F.col("x.column").alias("column"), F.col("x.plain").alias("a"), F.col("y.plain").alias("b"),
        F.col("x.key").alias("a_key"), F.col("y.key").alias("b_key"),
    )
    return met.where(_alike("a", "b", F.lit(threshold)))


def _grams(size: int | Column) -> Column:
    last = F.length("plain") - size + 1
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring("plain", i, size)))


def _holding_pairs(left: DataFrame) -> DataFrame:
    """Pairs of which one holds the other, met at the shorter one or at its rarest five characters."""
    left = left.select("column", "plain", F.struct("first_n", "first_label").alias("key"))
    long = left.where(F.length("plain") >= GRAM).select("column", "plain", "key", F.explode(_grams(GRAM)).alias("gram"))
    long = materialize(long, "grams")
    often = long.groupBy("column", "gram").agg(F.count("*").alias("n"))
    rarest = long.join(often, ["column", "gram"]).groupBy("column", "plain", "key").agg(
        F.min(F.struct("n", "gram"))["gram"].alias("gram")
    )
    short = left.where(F.length("plain").between(2, GRAM - 1)).withColumn("gram", F.col("plain"))
    sizes = [r[0] for r in short.select(F.length("plain")).distinct().collect()]
    holders = long
    for size in sizes:
        wider = left.where(F.length("plain") > size)
        holders = holders.unionByName(wider.select("column", "plain", "key", F.explode(_grams(size)).alias("gram")))
    inner = rarest.unionByName(short.select(*rarest.columns))
    s, h = inner.alias("s"), holders.alias("h")
    met = s.join(
        h,
        (F.col("s.column") == F.col("h.column")) & (F.col("s.gram") == F.col("h.gram"))
        & (F.length("h.plain") > F.length("s.plain")) & F.contains("h.plain", "s.plain"),
    )
    first = F.col("s.key") < F.col("h.key")

    def either(field: str, want: bool) -> Column:
        return F.when(first == F.lit(want), F.col(f"s.{field}")).otherwise(F.col(f"h.{field}"))

    return met.select(
        F.col("s.column").alias("column"), either("plain", True).alias("a"), either("plain", False).alias("b"),
        either("key", True).alias("a_key"), either("key", False).alias("b_key"),
    )


def _indexed(left: DataFrame, threshold: float) -> DataFrame:
    """(column, plain, seed) of labels that are like no leader; seeds are found in rounds over the like pairs."""
    pairs = _ratio_pairs(left, threshold).unionByName(_holding_pairs(left)).distinct()
    edges = waiting = materialize(pairs.select("column", "a", "b", "a_key"), "label-pairs")

    def ends(of: DataFrame) -> DataFrame:
        both = F.explode(F.array("a", "b")).alias("plain")
        return of.select("column", both).distinct()

    def without(of: DataFrame, settled: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            of = of.join(settled.withColumnRenamed("plain", side), ["column", side], "left_anti")
        return of

    seeds = left.select("column", "plain").join(ends(edges), ["column", "plain"], "left_anti")
    while not waiting.isEmpty():
        later = waiting.select("column", F.col("b").alias("a")).distinct()
        fresh = materialize(waiting.select("column", "a").distinct().join(later, ["column", "a"], "left_anti"), "label-seeds")
        taken = waiting.join(fresh, ["column", "a"], "left_semi").select("column", F.col("b").alias("plain"))
        fresh = fresh.withColumnRenamed("a", "plain")
        settled = materialize(taken.unionByName(fresh).distinct(), "label-settled")
        still = materialize(without(waiting, settled), "label-pairs")
        # Labels that had waited only for labels now taken are seeds too.
        alone = ends(waiting).join(settled, ["column", "plain"], "left_anti").join(ends(still), ["column", "plain"], "left_anti")
        seeds = seeds.unionByName(fresh).unionByName(materialize(alone, "label-seeds"))
        waiting = still
    seeds = materialize(seeds, "label-seeds")
    chosen = edges.join(seeds.withColumnRenamed("plain", "a"), ["column", "a"], "left_semi")
    absorbed = chosen.groupBy("column", F.col("b").alias("plain")).agg(F.min_by("a", "a_key").alias("seed"))
    return absorbed.unionByName(seeds.withColumn("seed", F.col("plain")))


def similar_label_groups(
    df: DataFrame, columns: Sequence[str] | None = None, threshold: float = MATCH_RATIO
) -> DataFrame:
    """Labels grouped greedily around a seed, most frequent label first, in columns of any number of labels.

    Without ``columns`` all text columns are taken but those whose cells are
    numbers or dates; ``category_columns`` names these. Labels without letters
    or digits are like no other.
    """
    if columns is None:
        columns = [r["column"] for r in category_columns(df).where("status = 'categories'").collect()]
    if not columns:
        return empty_like(df, GROUP_SCHEMA)
    labels = materialize(all_labels(df, list(columns)).withColumn("plain", normalized(F.col("label"))).where("plain != ''"), "labels")
    key = F.struct((-F.col("n")).alias("n"), "label")
    first = [F.col("key.n").alias("first_n"), F.col("key.label").alias("first_label")]
    plain = materialize(labels.groupBy("column", "plain").agg(F.min(key).alias("key")).select("column", "plain", *first), "plain-labels")
    parts, left = _led(plain, threshold)
    if left is not None:
        parts.append(_indexed(left, threshold))
    if not parts:
        return empty_like(df, GROUP_SCHEMA)
    placed = parts[0]
    for part in parts[1:]:
        placed = placed.unionByName(part)
    grouped = materialize(labels.join(placed, ["column", "plain"]), "label-groups")
    seed_key = F.min(F.when(F.col("plain") == F.col("seed"), key)).alias("key")
    groups = grouped.groupBy("column", "seed").agg(F.count("*").alias("members"), seed_key).where("members > 1")
    numbered = number_rows(groups.select("column", "seed", *first), ["first_n", "first_label"], ["column"], "group_no")
    numbered = small_side(materialize(numbered.select("column", "seed", "group_no"), "group-numbers"))
    return grouped.join(numbered, ["column", "seed"]).select("column", "group_no", "label", "n")


def similar_label_pairs(
    df: DataFrame, columns: Sequence[str] | None = None, max_distance: int = 2
) -> DataFrame:
    """Pairs that contain one another or lie within an edit distance, all in built-in functions.

    Only matching pairs leave the array expression; a column has at most 80 labels.
    """
    per_column = (
        label_table(df, columns)
        .groupBy("column")
        .agg(F.sort_array(F.collect_list(F.struct("label", normalized(F.col("label")).alias("plain")))).alias("all"))
    )
    each = per_column.select("column", "all", F.explode("all").alias("a"))

    def match(b):
        a = F.col("a")
        short = F.least(F.length(a["plain"]), F.length(b["plain"]))
        contains = (F.contains(a["plain"], b["plain"]) | F.contains(b["plain"], a["plain"])) & (short >= 2)
        close = F.levenshtein(a["plain"], b["plain"]) <= max_distance
        return (b["label"] > a["label"]) & (short > 0) & (contains | close)

    return each.select("column", "a", F.explode(F.filter("all", match)).alias("b")).select(
        "column", F.col("a.label").alias("label_a"), F.col("b.label").alias("label_b")
    )
