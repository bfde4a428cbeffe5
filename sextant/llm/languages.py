"""Language identification: FTRL-trained multinomial regression on TF-IDF of character n-grams.

N-grams of one to three characters of the lower-case text, with everything but
letters as a blank, are hashed to SIZE features; values are counts times
inverse document frequency, scaled to length one.  Document frequencies count
all learning documents, each in the task that reads it.  The regression is
fitted on the SAMPLE documents of each language with the least hash of their
key, a documented bound, four fifths for the weights and the rest for the
temperature; features, not texts, go to that one task.  The weights kept by the
elastic net travel with the tasks that predict.

Defined cases: null text, and text without a letter, is ``und`` with score 0,
as is everything if there is nothing to learn from; null keys are not held out
and not learned from; repeated rows are predicted alike and all returned; an
empty table gives an empty result; only key, text and language are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from sextant.llm import linear
from sextant.scratch import materialize

SIZE = 1 << 16
SAMPLE = 1500
ORDERS = 3
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class Features:
    """Counts of hashed n-grams of a text."""

    def __init__(self):
        self.letter = np.array([chr(c).isalpha() for c in range(1 << 16)], bool)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct features and counts; None without a letter."""
        code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
        low = code < (1 << 16)
        is_letter = np.where(low, self.letter[np.where(low, code, 0)], False)
        if not low.all():
            high = np.unique(code[~low])
            is_letter |= np.isin(code, high[[chr(c).isalpha() for c in high]])
        if not is_letter.any():
            return None
        code = np.concatenate([[0], np.where(is_letter, code, 0), [0]]).astype(np.uint64) + np.uint64(1)
        parts, value = [], np.zeros(len(code), np.uint64)
        for n in range(ORDERS):
            value = value[: len(code) - n] + code[n:] * _MULTIPLIERS[n]
            parts.append(((value * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(48)).astype(np.int64))
        count = np.bincount(np.concatenate(parts), minlength=SIZE)
        at = np.flatnonzero(count)
        return at, count[at]


def _values(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = count * idf[at]
    return x / max(float(np.sqrt((x * x).sum())), 1e-12)


def predict(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per input row: key, held_out, lang_pred and score."""
    rows = docs.select(
        F.col(key).alias("key"),
        F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False)).alias("held_out"),
        F.col(text).alias("text"),
        F.col(lang).alias("lang"),
    )
    learn = rows.where("key is not null and lang is not null and not held_out")
    names, weights, temperature, idf = _fit(learn)
    active = weights is not None
    kind = T.StructType(
        [T.StructField(key, rows.schema["key"].dataType), T.StructField("held_out", T.BooleanType()),
         T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for batch in batches:
            named, score = [], []
            for t in batch["text"]:
                found = features(t) if active else None
                if found is None:
                    named.append(UNKNOWN)
                    score.append(0.0)
                    continue
                at, count = found
                p = linear.softmax((_values(at, count, idf) @ weights[at] + weights[SIZE]) / temperature)
                best = int(p.argmax())
                named.append(names[best])
                score.append(round(float(p[best]), 6))
            yield pd.DataFrame({key: batch["key"], "held_out": batch["held_out"], "lang_pred": named, "score": score})

    return rows.select("key", "held_out", "text").mapInPandas(judge, kind)


def _fit(learn: DataFrame):
    """Language names, weights, temperature and inverse document frequencies; weights None without rows."""

    def document_frequency(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features, seen, n = Features(), np.zeros(SIZE, np.int64), 0
        for batch in batches:
            for t in batch["text"]:
                found = features(t)
                if found is not None:
                    seen[found[0]] += 1
                    n += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"at": np.append(at, -1), "n": np.append(seen[at], n)})

    counted = learn.select("text").mapInPandas(document_frequency, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    df = {r["at"]: r["n"] for r in counted.collect()}  # at most SIZE + 1 rows
    idf = np.full(SIZE, np.log(1.0 + df.get(-1, 0)) + 1)
    for at, n in df.items():
        if at >= 0:
            idf[at] = np.log((1 + df[-1]) / (1 + n)) + 1
    order = W.partitionBy("lang").orderBy(F.xxhash64("key", F.lit(1)), "key")
    picked = learn.select("key", "lang").withColumn("place", F.row_number().over(order)).where(F.col("place") <= SAMPLE)
    picked = materialize(picked.select("key", "lang").distinct(), "language-sample")
    sample = learn.join(F.broadcast(picked), ["key", "lang"], "left_semi")  # at most SAMPLE keys a language

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for batch in batches:
            found = [(l, k, features(t)) for l, k, t in zip(batch["lang"], batch["key"], batch["text"])]
            found = [(l, str(k), f[0].astype(np.int32), f[1].astype(np.int32)) for l, k, f in found if f is not None]
            yield pd.DataFrame(found, columns=["lang", "key", "at", "count"])

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "lang"], kind="stable").reset_index(drop=True)
        names = sorted(group["lang"].unique())
        label = group["lang"].map({l: i for i, l in enumerate(names)}).to_numpy()
        data = [(a, _values(a, c, idf)) for a, c in zip(group["at"], group["count"])]
        apart = np.arange(len(data)) % 5 == 4
        w = linear.fit_ftrl([d for d, x in zip(data, apart) if not x], label[~apart], len(names), SIZE)
        scores = np.array([x @ w[a] + w[SIZE] for (a, x), out in zip(data, apart) if out]).reshape(-1, len(names))
        t = linear.fit_temperature(scores, label[apart])
        at, c = np.nonzero(w)
        rows = [(int(i), names[j], float(w[i, j])) for i, j in zip(at, c)]
        rows += [(-1, l, 0.0) for l in names] + [(-2, "", t)]
        return pd.DataFrame(rows, columns=["at", "lang", "weight"])

    found = sample.select("lang", "key", "text").mapInPandas(extract, "lang string, key string, at array<int>, count array<int>")
    model = found.withColumn("one", F.lit(True)).groupBy("one").applyInPandas(train, "at int, lang string, weight double").collect()
    if not model:
        return [], None, 1.0, idf
    names = sorted(r["lang"] for r in model if r["at"] == -1)
    place = {l: i for i, l in enumerate(names)}
    weights = np.zeros((SIZE + 1, len(names)), np.float64)
    for r in model:
        if r["at"] >= 0:
            weights[r["at"], place[r["lang"]]] = r["weight"]
    return names, weights, next(r["weight"] for r in model if r["at"] == -2), idf
