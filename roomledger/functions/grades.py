"""Grade numbers (-2, -1, 0 for the kindergarten years, then 1, 2, ...) and their labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roomledger.functions.nulls import has_text, if_known


def pad2(text: Column) -> Column:
    """Left-pad with zeros to two characters; longer text is kept whole."""
    return F.when(F.length(text) >= 2, text).otherwise(F.lpad(text, 2, "0"))


def grade_label(number: Column) -> Column:
    """-2 -> K0, -1 -> K1, 0 -> K2, 7 -> 07, 12 -> 12."""
    number = number.cast("int")
    kindergarten = F.concat(F.lit("K"), (number + 2).cast("string"))
    return if_known(number < 1, kindergarten, pad2(number.cast("string")))


def grade_number(label: Column) -> Column:
    """Inverse of :func:`grade_label`; NULL for text that is not a grade."""
    kindergarten = F.substring(label, 2, 1).try_cast("int") - 2
    return F.when(has_text(label, "K"), kindergarten).otherwise(label.try_cast("int"))


def grade_range(low: Column, high: Column) -> Column:
    """One label for a single-grade room, otherwise ``low to high``."""
    spread = F.concat(grade_label(low), F.lit(" to "), grade_label(high))
    return if_known(low == high, grade_label(low), spread)
