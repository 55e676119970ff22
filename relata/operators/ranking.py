"""Top rows of a table or of each group, and the row that holds a group's largest value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relata.functions.scalars import key_digest
from relata.operators.numbering import number_copies


def top(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """First ``n`` rows; every partition sends only its own first ``n``."""
    return df.orderBy(*order).limit(n)


def top_per_group(
    df: DataFrame, by: Sequence[str], n: int, order: Sequence[Column], name: str = "place"
) -> DataFrame:
    """First ``n`` rows of each group with their place, from 1.

    The optimizer applies the limit on each input partition ahead of the shuffle, so a hot group
    does not travel whole.
    """
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(name, place).filter(F.col(name) <= n)


def nest_top(
    df: DataFrame,
    by: Sequence[str],
    n: int,
    order: Sequence[Column],
    fields: Sequence[str],
    name: str,
    ascending: bool = False,
) -> DataFrame:
    """First ``n`` rows of each group as an array, best first or, if ascending, last."""
    rows = top_per_group(df, by, n, order, "__place")
    place = -F.col("__place") if ascending else F.col("__place")
    listed = rows.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct(place.alias("__p"), *fields))).alias("__list")
    )
    return listed.select(
        *by, F.transform("__list", lambda r: F.struct(*[r[f].alias(f) for f in fields])).alias(name)
    )


def holder_of_max(
    df: DataFrame, by: Sequence[str], metric: str, holder: str, count: str = "stints"
) -> DataFrame:
    """Per group: its rows, its largest metric, and the smallest holder that reaches it.

    Two plain aggregations: rows are first merged by group and holder.
    """
    best = F.struct(
        F.col(metric).isNull().alias("u"), (-F.col(metric)).alias("m"), F.col(holder).alias("h")
    )
    per_holder = df.groupBy(*by, holder).agg(
        F.max(metric).alias(metric), F.count("*").alias("__n")
    )
    return per_holder.groupBy(*by).agg(
        F.sum("__n").alias(count),
        F.max(metric).alias(metric),
        F.min_by(holder, best).alias(holder),
    )


def shuffle_rows(
    df: DataFrame,
    key: Sequence[str],
    seed: str = "",
    name: str = "row_no",
    digest: Column | None = None,
) -> DataFrame:
    """Rows in an order that depends on the seed and the key alone, numbered from 1.

    ``digest`` is a seeded hash of the key to order by instead, e.g. by ``functions.hashing``.
    """
    # rows that share a key are told apart by their columns, and equal rows go as one
    if digest is None:
        parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]
        digest = key_digest(*parts, seed=seed)
    hashed = df.withColumn("__hash", digest)
    rest = [c for c in df.columns if c not in key]
    order = [F.col("__hash"), *[F.col(c).asc_nulls_first() for c in [*key, *rest]]]
    return number_copies(hashed, order, name).drop("__hash")
