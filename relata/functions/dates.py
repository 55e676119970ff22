"""Dates and instants from text and from parts; what cannot be read becomes null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def instant(text: Column) -> Column:
    """An ISO-8601 instant; a bare date is its midnight, and without a zone it is taken as UTC.

    The text has to begin with a date: a bare time would be read as one of today.
    """

    def sign(place: int) -> Column:
        return F.substring(text, place, 1).isin("+", "-")

    zoned = F.substring(text, -1, 1).isin("Z", "z") | sign(-6) | sign(-5) | sign(-3)
    full = (
        F.when(F.length(text) <= 10, F.concat(text, F.lit("T00:00:00Z")))
        .when(zoned, text)
        .otherwise(F.concat(text, F.lit("Z")))
    )
    return F.when(F.substring(text, 5, 1) == "-", F.try_to_timestamp(full))


def date_of(year: Column, month: Column | None = None, day: Column | None = None) -> Column:
    """A date from its parts, a missing month or day being the first."""
    first = F.lit(1)
    text = F.format_string(
        "%s-%s-%s",
        year,
        first if month is None else F.coalesce(month, first),
        first if day is None else F.coalesce(day, first),
    )
    return F.when(year.isNotNull(), F.try_to_date(text, "y-M-d"))


def date_of_text(text: Column, form: str = "yyyy-MM-dd") -> Column:
    return F.try_to_date(text, form)


def whole_days(earlier: Column, later: Column) -> Column:
    """Elapsed days between two instants, rounded down, negative if they are reversed."""
    return F.floor((F.unix_seconds(later) - F.unix_seconds(earlier)) / F.lit(86400)).cast("bigint")
