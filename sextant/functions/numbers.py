"""Numbers held as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain decimal or scientific literal. Guards the cast: '12d', 'NaN' and 'inf'
# would otherwise be accepted as doubles.
NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
INTEGER_PATTERN = r"^[+-]?[0-9]{1,18}$"


def to_number(text: Column, thousands: bool = False) -> Column:
    """Double value of a text cell, null when it is not a number."""
    plain = F.trim(text)
    if thousands:
        plain = F.regexp_replace(plain, ",", "")
    return F.when(plain.rlike(NUMBER_PATTERN), plain.try_cast("double"))


def to_integer(text: Column) -> Column:
    plain = F.trim(text)
    return F.when(plain.rlike(INTEGER_PATTERN), plain.try_cast("bigint"))
