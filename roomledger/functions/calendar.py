"""School years and birth dates."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

USUAL_DATE = r"(?s)^ *(\d{1,2})/ *(\d{1,2})/ *(\d{4}).*$"
ANY_DATE = r"^ *(\d{1,2}/ *\d{1,2}/ *\d{1,4})"


def school_year(day: Column) -> Column:
    """``SY2526`` for any day from July 2025 to June 2026."""
    closing = F.year(day) + F.when(F.month(day) < 7, 0).otherwise(1)

    def two_digits(year: Column) -> Column:
        return F.substring(year.cast("string"), 3, 2)

    return F.concat(F.lit("SY"), two_digits(closing - 1), two_digits(closing))


def school_years_of(days: Iterable[date]) -> tuple[str, ...]:
    """The labels of the school years that the given days lie in."""
    closing = {day.year + (day.month >= 7) for day in days}
    return tuple(f"SY{(year - 1) % 100:02d}{year % 100:02d}" for year in sorted(closing))


def birth_date(text: Column) -> Column:
    """Month/day/year text, padded or not, with anything after it ignored; NULL if not a date.

    The usual form is turned into year-month-day and cast, which costs half of a
    formatted parse; only other text takes the formatter.
    """
    turned = F.regexp_replace(text, USUAL_DATE, "$3-$1-$2")
    day = F.replace(F.regexp_extract(text, ANY_DATE, 1), F.lit(" "), F.lit(""))
    parsed = F.when(day != "", F.try_to_date(day, "M/d/y"))
    return F.coalesce(F.nullif(turned, text).try_cast("date"), parsed)
