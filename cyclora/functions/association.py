"""Association of two attributes from counts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def g_squared(total: Column, left: Column, right: Column, both: Column) -> Column:
    """Log-likelihood association in bits: the sum of O * log2(O / E) over the four cells of the 2x2 table.

    Cells whose observed or expected count is not positive add nothing (counts
    of occurrences may exceed the total, which makes cells negative). The
    result has no sign: pairs rarer than expected score as well.
    """
    total, left, right, both = (c.cast("double") for c in (total, left, right, both))
    cells = [
        (both, left * right),
        (left - both, left * (total - right)),
        (right - both, (total - left) * right),
        (total - left - right + both, (total - left) * (total - right)),
    ]

    def term(seen: Column, product: Column) -> Column:
        expected = product / total
        return F.when((seen > 0) & (expected > 0), seen * F.log2(seen / expected)).otherwise(F.lit(0.0))

    first, *rest = (term(*cell) for cell in cells)
    for more in rest:
        first = first + more
    return first


def pointwise_information(total: Column, left: Column, right: Column, both: Column) -> Column:
    """log10 of the joint frequency over the product of the marginal ones."""
    t = total.cast("double")
    return F.log10(F.try_divide(both / t, (left * right) / (t * t)))


def overlap_ratio(left: Column, right: Column, both: Column) -> Column:
    """Joint count over the sum of the marginal counts (half of Dice's coefficient)."""
    return F.try_divide(both.cast("double"), left + right)
