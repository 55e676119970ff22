"""How many whole days lie between two instants given in lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.functions.dates import instant, whole_days


def _parsed(lines: DataFrame, line: str) -> DataFrame:
    """Days per line; null where a line has fewer than three fields or an unreadable instant."""
    fields = F.split(F.col(line), "\t", 3)
    first, second = (instant(F.get(fields, F.lit(i))) for i in (0, 1))
    return lines.select(line, F.when(F.size(fields) == 3, whole_days(first, second)).alias("days"))


def delay_histogram(lines: DataFrame, line: str = "value") -> DataFrame:
    # counting the parsed value leaves bad lines at zero; a null test would parse lines twice
    days = _parsed(lines, line).groupBy("days").agg(F.count("days").alias("ct"))
    return days.filter("ct > 0")


def bad_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """The lines the histogram leaves out.

    The test goes over a generated column: a filter on the parsed value itself would be pushed into
    the parsing and would parse each line once per mention of it.
    """
    parsed = _parsed(lines, line)
    tested = parsed.select(line, F.explode(F.array("days")).alias("known"))
    return tested.filter("known IS NULL").select(line)
