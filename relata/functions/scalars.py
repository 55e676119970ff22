"""Column functions with the null and rounding rules the operators rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def substring_range(text: Column, start: int, stop: int) -> Column:
    """Characters from ``start`` up to ``stop`` (0-based, end exclusive); null if there are none."""
    return F.nullif(F.substring(text, start + 1, stop - start), F.lit(""))


def ratio(top: Column, bottom: Column) -> Column:
    """A quotient as double; null if the divisor is zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def whole_ratio(top: Column, bottom: Column) -> Column:
    """A quotient of whole numbers, truncated towards zero; null if the divisor is zero."""
    safe = F.nullif(bottom, F.lit(0))
    return F.call_function("div", top, safe)


def round_half_up(value: Column) -> Column:
    """Nearest whole number, halves towards plus infinity."""
    return F.floor(value + F.lit(0.5))


def flag(condition: Column) -> Column:
    """1 if the condition holds, 0 if it does not or is unknown."""
    return F.when(condition, 1).otherwise(0)


def shorten(text: Column, limit: int = 15) -> Column:
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))
    ).otherwise(text)


def matches_fully(text: Column, pattern: str) -> Column:
    """Whether the whole text matches, a case flag in front being allowed.

    A dot stands for any character but a line break, and a line break at the end is text like any.
    """
    flags = ""
    while pattern.startswith("(?i)"):
        flags, pattern = "(?i)", pattern[4:]
    return text.rlike(rf"{flags}\A(?:{pattern})\z")


def key_digest(*keys: Column, seed: str = "") -> Column:
    """A digest of the keys in hex, the same in every run for the same seed."""
    parts = [F.lit(seed)] if seed else []
    return F.md5(F.concat(*parts, *[k.cast("string") for k in keys]).cast("binary"))


def record(**fields: Column) -> Column:
    return F.struct(*[value.alias(name) for name, value in fields.items()])


def first_or(bag: Column, default: Column) -> Column:
    """The smallest member of a bag, or a default if it is empty or null."""
    return F.coalesce(F.get(F.sort_array(bag), F.lit(0)), default)


def set_operations(a: Column, b: Column) -> dict[str, Column]:
    """Set operations on two arrays in a row, results sorted."""
    first, second = F.array_except(a, b), F.array_except(b, a)
    changed = F.array_union(first, second)
    return {
        "either": F.sort_array(F.array_union(a, b)),
        "stayed": F.sort_array(F.array_intersect(a, b)),
        "departed": F.sort_array(first),
        "arrived": F.sort_array(second),
        "changed": F.sort_array(changed),
        "is_equal": F.when(F.size(changed) == 0, 1).otherwise(0),
    }
