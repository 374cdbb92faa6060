"""Calendar values from dates and timestamps, as partition columns use them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERNS = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd"}


def derive(column: Column, unit: str) -> Column:
    """`YYYY`, `YYYY-MM` or `YYYY-MM-DD`; null where the year isn't in 1..9999 (callers require a value)."""
    return F.when(F.year(column).between(1, 9999), F.date_format(column, PATTERNS[unit]))


def derive_from_ns(column: Column, unit: str) -> Column:
    """The same from nanoseconds since the epoch; floors, so instants before the epoch fall on the right day."""
    micros = F.floor(column / F.lit(1000).cast("decimal(10,0)")).cast("long")
    return derive(F.timestamp_micros(micros), unit)
