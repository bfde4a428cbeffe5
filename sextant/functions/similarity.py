"""Label similarity."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

MATCH_RATIO = 0.75


def normalized(label: Column) -> Column:
    return F.regexp_replace(F.lower(label), "[^a-z0-9]", "")


def normalize(label: str) -> str:
    return re.sub("[^a-z0-9]", "", label.lower())


def ratio(a: str, b: str) -> float:
    """Share of characters in matching blocks of two strings (Ratcliff/Obershelp)."""
    return SequenceMatcher(None, a, b).ratio()


def alike(a: str, b: str, threshold: float = MATCH_RATIO) -> bool:
    """Whether two normalised labels look like one category."""
    if not a or not b:
        return False
    if min(len(a), len(b)) >= 2 and (a in b or b in a):
        return True
    return ratio(a, b) >= threshold


@F.pandas_udf(DoubleType())
def label_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")
