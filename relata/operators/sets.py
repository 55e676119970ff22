"""Whole-table set operations and co-groups, each with a single shuffle.

Both tables are put under one another with a mark for their side, and one aggregation on the key
tells which sides hold it. Copies of a key are merged before they travel.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(*tables: DataFrame) -> DataFrame:
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table)
    return result


def membership(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every distinct row of either table with ``in_a`` and ``in_b``; columns match by name."""
    marked = a.select("*", F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionByName(
        b.select("*", F.lit(0).alias("__a"), F.lit(1).alias("__b"))
    )
    return marked.groupBy(*a.columns).agg(
        (F.max("__a") == 1).alias("in_a"), (F.max("__b") == 1).alias("in_b")
    )


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return membership(a, b).filter("in_a AND in_b").drop("in_a", "in_b")


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return membership(a, b).filter("in_a AND NOT in_b").drop("in_a", "in_b")


def xor(a: DataFrame, b: DataFrame) -> DataFrame:
    return membership(a, b).filter("in_a != in_b").drop("in_a", "in_b")


def equal(a: DataFrame, b: DataFrame, name: str = "is_equal") -> DataFrame:
    """One row: 1 if both tables hold the same distinct rows, two empty ones included."""
    return membership(a, b).agg((F.count_if(F.col("in_a") != F.col("in_b")) == 0).cast("int").alias(name))


def _hashes(columns: Sequence[str]) -> list[Column]:
    """Two hashes of a row that differ in their beginning; a null is told from its place."""
    told = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    return [F.xxhash64(F.lit(seed), *told) for seed in ("first", "second")]


def digest(df: DataFrame) -> DataFrame:
    """One row that is the same for the same bag of rows in any order: n, first, second.

    The sums of two 64-bit hashes and the number of rows. Each task adds up its own rows, so no row
    is shuffled.
    """
    first, second = (h.cast("decimal(20,0)") for h in _hashes(sorted(df.columns)))
    zero = F.lit(0).cast("decimal(38,0)")
    return df.select(first.alias("a"), second.alias("b")).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum("a").cast("decimal(38,0)"), zero).alias("first"),
        F.coalesce(F.sum("b").cast("decimal(38,0)"), zero).alias("second"),
    )


def digest_of_set(df: DataFrame) -> DataFrame:
    """The digest of the distinct rows. Only their hashes travel, equal ones merged before."""
    first, second = _hashes(sorted(df.columns))
    hashes = df.select(first.alias("a"), second.alias("b")).distinct()
    zero = F.lit(0).cast("decimal(38,0)")
    return hashes.agg(
        F.count("*").alias("n"),
        *[
            F.coalesce(F.sum(F.col(c).cast("decimal(20,0)")).cast("decimal(38,0)"), zero).alias(name)
            for c, name in (("a", "first"), ("b", "second"))
        ],
    )


def equal_by_digest(
    a: DataFrame, b: DataFrame, as_sets: bool = False, name: str = "is_equal"
) -> DataFrame:
    """One row: 1 if both tables hold the same rows, as bags or as sets, by their digests.

    Columns match by name and need the same types. Tables that differ pass for equal with a chance of
    2^-128 only.
    """
    make = digest_of_set if as_sets else digest
    both = make(a).unionByName(make(b))
    same = F.lit(True)
    for c in ("n", "first", "second"):
        same = same & (F.min(c) == F.max(c))
    return both.agg(same.cast("int").alias(name))


def cogroup(
    a: DataFrame,
    b: DataFrame,
    keys: Mapping[str, tuple[Column, Column]],
    of_a: Mapping[str, Column],
    of_b: Mapping[str, Column],
    summaries: Sequence[Column],
) -> DataFrame:
    """Group two tables by a common key and summarise both sides of each group.

    ``keys`` gives each key name with its expression on either side. ``of_a`` and ``of_b`` are
    the fields taken from either side; in the combined rows the other side's fields are null and
    ``from_a`` / ``from_b`` tell the side. ``summaries`` aggregate those rows; a side without
    rows gives a zero count or a null. Null keys of the two sides stay apart.
    """
    types = {
        **{n: a.select(c.alias(n)).schema[n].dataType for n, c in of_a.items()},
        **{n: b.select(c.alias(n)).schema[n].dataType for n, c in of_b.items()},
    }

    def side(df: DataFrame, which: int, own: Mapping[str, Column]) -> DataFrame:
        fields = [
            (own[n] if n in own else F.lit(None).cast(types[n])).alias(n) for n in types
        ]
        return df.select(
            *[pair[which].alias(k) for k, pair in keys.items()],
            *fields,
            F.lit(which == 0).alias("from_a"),
            F.lit(which == 1).alias("from_b"),
        )

    both = side(a, 0, of_a).unionByName(side(b, 1, of_b))
    unknown = F.lit(False)
    for key in keys:
        unknown = unknown | F.col(key).isNull()
    apart = F.when(unknown, F.col("from_a")).alias("__apart")
    return both.groupBy(*keys, apart).agg(*summaries).drop("__apart")
