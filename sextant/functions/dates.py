"""Dates held as text in several formats, and date parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell texts that mean "no value".
NULL_TOKENS = ["", "nan", "none", "nat", "null", "<na>"]

ISO_PREFIX = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
LONG_SLASHED = r"^([0-9]{1,2})[/.]([0-9]{1,2})[/.]([0-9]{4})(?![0-9])"
SHORT_SLASHED = r"^([0-9]{1,2})[/.]([0-9]{1,2})[/.]([0-9]{2})(?![0-9])"
DATE_SHAPE = r"[0-9]{4}|[0-9]{1,2}[/-][0-9]{1,2}"

# Written forms beyond these two: the shape of a cell, and how to rewrite it year first.
_REWRITTEN = [
    (r"^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})", "$1-$2-$3"),
    (r"^([0-9]{1,2})-([0-9]{1,2})-([0-9]{4})", "$3-$2-$1"),
]
_SPELLED = [
    (r"^[0-9]{1,2} [A-Za-z]{3} [0-9]{4}", "d MMM yyyy"),
    (r"^[0-9]{1,2} [A-Za-z]{4,9} [0-9]{4}", "d MMMM yyyy"),
    (r"^[A-Za-z]{3} [0-9]{1,2}, [0-9]{4}", "MMM d, yyyy"),
    (r"^[A-Za-z]{4,9} [0-9]{1,2}, [0-9]{4}", "MMMM d, yyyy"),
]
_CLOCK = "[ H:mm[:ss]]"


def strip_null_tokens(text: Column) -> Column:
    """Trimmed text, null when it is blank or a spelled-out null."""
    plain = F.trim(text)
    return F.when(~F.lower(plain).isin(NULL_TOKENS), plain)


def _slashed(cell: Column, shape: str, century: str) -> Column:
    """Three numbers with slashes or dots: day first, month first only if that is impossible.

    Rewriting to the ISO order and casting avoids a parser exception per failing cell.
    """
    ways = [F.regexp_replace(cell, shape, f"{century}$3-{order}").try_cast("timestamp") for order in ("$2-$1", "$1-$2")]
    return F.coalesce(*ways)


def parse_mixed_date(text: Column) -> Column:
    """Timestamp of one text cell; the shape of the cell decides the field order.

    ISO-looking cells are read year first. ``d/m/y`` and ``d.m.y`` are read day
    first, and month first only if that is impossible. Anything else must have
    one of a fixed list of written forms. A cell is parsed by one rule only.
    """
    cell = strip_null_tokens(text)
    parsed = (
        F.when(cell.rlike(ISO_PREFIX), cell.try_cast("timestamp"))
        .when(cell.rlike(LONG_SLASHED), _slashed(cell, LONG_SLASHED, ""))
        .when(cell.rlike(SHORT_SLASHED), _slashed(cell, SHORT_SLASHED, "20"))
    )
    for shape, order in _REWRITTEN:
        parsed = parsed.when(cell.rlike(shape), F.regexp_replace(cell, shape, order).try_cast("timestamp"))
    for shape, pattern in _SPELLED:
        parsed = parsed.when(cell.rlike(shape), F.try_to_timestamp(cell, F.lit(pattern + _CLOCK)))
    return parsed


def looks_like_date(text: Column) -> Column:
    return text.rlike(DATE_SHAPE)


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Difference in fractional days at microsecond resolution."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return micros / F.lit(86_400_000_000.0)


def add_days(start: Column, days: Column) -> Column:
    micros = F.unix_micros(start.cast("timestamp")) + F.round(days * F.lit(86_400_000_000.0)).cast("bigint")
    return F.timestamp_micros(micros)


def date_parts(value: Column, name: str) -> list[Column]:
    """Month, weekday (Monday = 0) and year of a timestamp, named after the column."""
    return [
        F.month(value).cast("bigint").alias(f"{name}_month"),
        F.weekday(value).cast("bigint").alias(f"{name}_dow"),
        F.year(value).cast("bigint").alias(f"{name}_year"),
    ]
