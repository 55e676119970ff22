"""Figures that are stored per part and merged to any roll-up, without reading old rows again.

Quantiles and set sizes are kept as sketches of a bounded size, distinct counts as bitmaps and so
exact. A store holds one folder per part; adding a part again replaces it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RANK_ERROR = 0.01  # bound of a quantile's error in rank at QUANTILE_SIZE, with room
QUANTILE_SIZE = 800
SET_BITS = 12  # a set's sketch has 2^12 entries; smaller sets are exact
SET_ERROR = 3 / 2 ** (SET_BITS / 2)  # of the union's size, three deviations


def add_part(df: DataFrame, path: str, part: str) -> None:
    """Write the figures ``df`` of one or more parts, told by the column ``part``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def read_parts(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)


def quantile_sketches(df: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    """One sketch per group of the values that are not null: ``by..., sketch``."""
    known = df.filter(value.isNotNull())
    return known.groupBy(*by).agg(
        F.kll_sketch_agg_double(value.cast("double"), QUANTILE_SIZE).alias("sketch")
    )


def merge_quantiles(
    stored: DataFrame, by: Sequence[str], edges: Mapping[str, float]
) -> DataFrame:
    """Quantiles of each group of ``by`` from the sketches of its parts.

    Off by at most ``RANK_ERROR`` in rank, whatever the number of parts merged. A group without a
    known value has no row.
    """
    merged = stored.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.select(
        *by,
        F.kll_sketch_get_n_double("sketch").alias("n"),
        *[
            F.kll_sketch_get_quantile_double("sketch", F.lit(float(share))).alias(name)
            for name, share in edges.items()
        ],
    )


def distinct_bitmaps(df: DataFrame, by: Sequence[str], member: str) -> DataFrame:
    """The members of each group as bitmaps: ``by..., bucket, bits``.

    ``member`` is a whole number. A bitmap holds 32,768 numbers, so a group of any size spreads over
    its buckets, and only bitmaps travel. Nulls make a bucket of their own.
    """
    number = F.col(member).cast("bigint")
    return df.groupBy(*by, F.bitmap_bucket_number(number).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits")
    )


def merge_bitmaps(stored: DataFrame, by: Sequence[str]) -> DataFrame:
    """The bitmaps of a coarser grouping."""
    return stored.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def count_bitmaps(stored: DataFrame, by: Sequence[str], name: str = "n") -> DataFrame:
    """Exact distinct counts of each group of ``by``; a null counts as one value."""
    merged = merge_bitmaps(stored, by)
    held = F.when(F.col("bucket").isNull(), 1).otherwise(F.bitmap_count("bits"))
    return merged.groupBy(*by).agg(F.sum(held).alias(name))


def set_sketches(df: DataFrame, by: Sequence[str], member: str) -> DataFrame:
    """One sketch of the distinct members, nulls left out, of each group: ``by..., sketch``."""
    known = df.filter(F.col(member).isNotNull())
    return known.groupBy(*by).agg(F.theta_sketch_agg(member, SET_BITS).alias("sketch"))


def set_sizes(a: Column, b: Column) -> dict[str, Column]:
    """Sizes of the sets that two sketches give, each within ``SET_ERROR`` of the union's size."""
    made = {
        "either": F.theta_union(a, b),
        "both": F.theta_intersection(a, b),
        "only_a": F.theta_difference(a, b),
        "only_b": F.theta_difference(b, a),
    }
    return {name: F.theta_sketch_estimate(sketch) for name, sketch in made.items()}
