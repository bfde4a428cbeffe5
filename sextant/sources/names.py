"""Column and table names."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame


def clean_name(name: str) -> str:
    """Lower-case word characters joined by single underscores; never empty, never digit first."""
    kept = re.sub(r"[^\w\s]", "", str(name).strip().lower())
    joined = "_".join(part for part in re.split(r"[\s_]+", kept) if part)
    if not joined:
        return "column"
    return f"col_{joined}" if joined[0].isdigit() else joined


def unique_names(names: Sequence[str]) -> list[str]:
    """Number repeated names from 1, stepping past numbers that are already taken."""
    taken: set[str] = set()
    originals = set(names)
    result = []
    for name in names:
        candidate, number = name, 0
        while candidate in taken or (number and candidate in originals):
            number += 1
            candidate = f"{name}_{number}"
        taken.add(candidate)
        result.append(candidate)
    return result


def clean_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names([clean_name(c) for c in df.columns]))


def table_name(name: str) -> str:
    base = "_".join(part for part in re.split(r"[\W_]+", str(name).strip().lower()) if part) or "table"
    if base[0].isdigit():
        base = f"t_{base}"
    return base
