"""Calendar order of month names and weekdays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lonja.labels import WEEKDAYS, WEEKDAYS_SPANISH

# How month names begin, January first.
MONTH_PREFIXES = (
    "ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep", "oct", "nov", "dic",
)


def month_rank(month: Column) -> Column:
    """1 to 12 by the first three letters, case-sensitive; 0 for any other label or NULL."""
    position = F.array_position(F.lit(list(MONTH_PREFIXES)), F.substring(month, 1, 3))
    return F.coalesce(position, F.lit(0)).cast("int")


def valid_date(value: Column) -> Column:
    """A date or year-month-day text as a date; other text is NULL."""
    return value.try_cast("date")


def weekday_number(day: Column) -> Column:
    """1 for Monday to 7 for Sunday."""
    return F.extract(F.lit("DAYOFWEEK_ISO"), day).cast("int")


def weekday_name(number: Column) -> Column:
    """English name of a weekday number; NULL stays NULL."""
    return F.get(F.lit(list(WEEKDAYS)), number - 1)


def weekday_label(name: Column) -> Column:
    """Spanish name of an English weekday; other text is kept."""
    pairs = [F.lit(text) for pair in zip(WEEKDAYS, WEEKDAYS_SPANISH) for text in pair]
    return F.coalesce(F.create_map(*pairs)[name], name)
