"""Row selection: filters, reproducible samples, overlapping splits, column ranges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relata.functions.scalars import key_digest, matches_fully, substring_range


def column_range(
    df: DataFrame, first: str | int | None = None, last: str | int | None = None
) -> list[str]:
    """Column names from ``first`` through ``last``, each a name, a position or open."""

    def place(end: str | int | None, default: int) -> int:
        if end is None:
            return default
        return end if isinstance(end, int) else df.columns.index(end)

    return df.columns[place(first, 0) : place(last, len(df.columns) - 1) + 1]


def where_matches(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.filter(matches_fully(F.col(column), pattern))


def random_sample(df: DataFrame, fraction: float, seed: int | None = None) -> DataFrame:
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def prefix_sample(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """Rows whose key begins with ``prefix``: the same keys in every table and every run."""
    return df.filter(substring_range(F.col(key).cast("string"), 0, len(prefix)) == prefix)


def hash_sample(
    df: DataFrame,
    key: str,
    digit: str = "0",
    seed: str = "",
    name: str = "keep_hash",
    digest: Column | None = None,
) -> DataFrame:
    """Rows whose key digest begins with a hex digit (1/16 of the keys), digest column first.

    ``digest`` is a hash of the key in hex to take instead, e.g. by ``functions.hashing``.
    """
    if digest is None:
        digest = key_digest(F.col(key), seed=seed)
    hashed = df.select(digest.alias(name), "*")
    return hashed.filter(F.col(name).startswith(digit))


def split(
    df: DataFrame, conditions: Mapping[str, Column], otherwise: str | None = None
) -> dict[str, DataFrame]:
    """One output per condition. A row goes to every output whose condition holds.

    ``otherwise`` names the output for rows where all conditions are false. A row for which a
    condition is unknown (null) and none is true goes nowhere, as negation keeps it unknown.
    """
    parts = {name: df.filter(condition) for name, condition in conditions.items()}
    if otherwise is not None:
        parts[otherwise] = df.filter(_none_of(list(conditions.values())))
    return parts


def split_tagged(
    df: DataFrame, conditions: Mapping[str, Column], otherwise: str | None = None,
    name: str = "bucket",
) -> DataFrame:
    """All outputs of :func:`split` in one pass, told apart by a column.

    Written with ``partitionBy(name)`` this fills one folder per output from a single scan.
    """
    tags = [F.when(condition, F.lit(tag)) for tag, condition in conditions.items()]
    if otherwise is not None:
        tags.append(F.when(_none_of(list(conditions.values())), F.lit(otherwise)))
    return df.select("*", F.explode(F.array_compact(F.array(*tags))).alias(name))


def _none_of(conditions: Sequence[Column]) -> Column:
    result = F.lit(True)
    for condition in conditions:
        result = result & ~condition
    return result
