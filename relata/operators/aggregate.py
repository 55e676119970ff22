"""Grouped aggregation: counts, roll-ups, shares, conditional sums."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relata.functions.scalars import flag
from relata.operators.numbering import attach
from relata.session import settle


def count_by(df: DataFrame, *keys: str, name: str = "ct") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def cardinality(df: DataFrame, by: Sequence[str], column: str, name: str) -> DataFrame:
    """Distinct values of a column per group, null being one of them.

    Two plain aggregations: the values of a hot group are told apart over all tasks before they
    are counted.
    """
    return df.groupBy(*by, column).agg(F.lit(1).alias("__v")).groupBy(*by).agg(
        F.count("*").alias(name)
    )


def with_share(counts: DataFrame, count: str = "ct", name: str = "freq") -> DataFrame:
    """Each count as a share of all. The total is a scalar subquery over the counts."""
    counts = settle(counts, "counts")
    total = counts.agg(F.sum(count).alias("total")).scalar()
    return counts.withColumn(name, F.try_divide(F.col(count).cast("double"), total))


def share_in_group(
    df: DataFrame, by: Sequence[str], value: str, count: str = "ct", name: str = "freq"
) -> DataFrame:
    """How often each value occurs in each group, and its share of the group.

    Counts are built and stored first, so what is grouped again is one row per value.
    """
    counts = settle(df.groupBy(*by, value).agg(F.count("*").alias(count)), "counts")
    totals = counts.groupBy(*by).agg(F.sum(count).alias("__total"))
    share = F.col(count).cast("double") / F.col("__total")
    return attach(counts, totals, by).withColumn(name, share).drop("__total")


def sums_by_subset(
    subsets: Mapping[str, Column], amounts: Mapping[str, Column]
) -> list[Column]:
    """Sums of each amount over each subset, named ``<amount>_<subset>``, for one pass."""
    return [
        F.sum(F.when(condition, amount).otherwise(0)).alias(f"{what}_{subset}")
        for subset, condition in subsets.items()
        for what, amount in amounts.items()
    ]


def count_flags(flags: Mapping[str, Column]) -> list[Column]:
    return [F.count_if(condition).alias(name) for name, condition in flags.items()]


def never(df: DataFrame, key: str, condition: Column) -> DataFrame:
    """Keys none of whose rows meet the condition; an unknown condition is not met."""
    return df.groupBy(key).agg(F.max(flag(condition)).alias("hit")).filter("hit = 0").select(key)


def first_of_unique(df: DataFrame, key: Column, name: str, fields: Sequence[str]) -> DataFrame:
    """Keys that occur exactly once, with the fields of their only row."""
    groups = df.groupBy(key.alias(name)).agg(
        F.count("*").alias("__n"), *[F.min(f).alias(f) for f in fields]
    )
    return groups.filter(F.col("__n") == 1).drop("__n")
