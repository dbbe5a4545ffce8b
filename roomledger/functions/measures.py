"""Rounding and ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round2(value: Column) -> Column:
    """Two decimals, exact ties to the even digit."""
    return F.bround(value.cast("double"), 2)


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` to two decimals; infinite for a zero whole (part is a positive count)."""
    ratio = F.try_divide(part.cast("double"), whole.cast("double"))
    return F.when(whole == 0, F.lit(float("inf"))).otherwise(round2(ratio))
