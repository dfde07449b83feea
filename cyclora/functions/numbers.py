"""Numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column | str, digits: int = 6) -> Column:
    """A double rounded as SQL does in DuckDB: what is scaled by a power of ten goes to the nearest whole number, halves away from zero.

    ``F.round`` rounds the shortest decimal that names the double, so 0.145 is
    0.15 there; here 0.145 * 100 is less than 14.5, and it is 0.14.
    """
    scale = float(10**digits)
    return F.round((F.col(value) if isinstance(value, str) else value) * scale) / scale
