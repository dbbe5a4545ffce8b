"""Missing-value rules that differ from SQL's defaults.

Three habits of the source data's home language matter for results:
an if/else on an unknown condition is itself unknown, membership and pattern
tests are never unknown, and a minimum or maximum over a group holding an
unknown is unknown.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def if_known(condition: Column, yes, no) -> Column:
    """``yes``/``no`` by condition; NULL when the condition is NULL."""
    return F.when(condition, yes).when(~condition, no)


def definitely(condition: Column) -> Column:
    """The condition with NULL read as false."""
    return F.coalesce(condition, F.lit(False))


def one_of(column: Column, values: Iterable) -> Column:
    """Membership that answers false, not NULL, for a NULL value."""
    return definitely(column.isin(*values))


def has_text(column: Column, text: str) -> Column:
    """Substring test that answers false for a NULL value."""
    return definitely(column.contains(text))


def has_pattern(column: Column, pattern: str) -> Column:
    """Regular-expression test that answers false for a NULL value."""
    return definitely(column.rlike(pattern))


def not_blank(column: Column) -> Column:
    """True for a value that is neither NULL nor the empty string."""
    return definitely(column != "")


def same(left: Column, right: Column) -> Column:
    """Equality under which NULL equals NULL (a join key may be missing on both sides)."""
    return left.eqNullSafe(right)
