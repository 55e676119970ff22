"""Histograms: plain, binned, gap-filled, logarithmic, with examples and within groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relata.functions.scalars import round_half_up
from relata.operators.nesting import bag_text
from relata.operators.numbering import attach
from relata.session import settle


def histogram(df: DataFrame, key: Column | str, val: str = "val", ct: str = "ct") -> DataFrame:
    column = F.col(key) if isinstance(key, str) else key
    return df.groupBy(column.alias(val)).agg(F.count("*").alias(ct))


def floor_bin(value: Column, width: int) -> Column:
    return (F.floor(value / width) * width).cast("bigint")


def round_bin(value: Column, width: int) -> Column:
    return (round_half_up(value / F.lit(float(width))) * width).cast("bigint")


def ceil_bin(value: Column, width: int) -> Column:
    return (F.ceil(value / F.lit(float(width))) * width).cast("bigint")


def log_bin(value: Column, per_decade: int = 10, eps: float = 0.001) -> Column:
    """Bins of equal width in the natural logarithm, as whole numbers; zero counts as ``eps``."""
    known = F.when(value == 0, F.lit(eps)).otherwise(value.cast("double"))
    return F.exp(F.floor(F.ln(known) * per_decade) / F.lit(float(per_decade))).cast("bigint")


def _steps(df: DataFrame, low: int, high: int, width: int, name: str) -> DataFrame:
    return df.sparkSession.range(low, high + 1, width).withColumnRenamed("id", name)


def fill_to(df: DataFrame, key: Column, width: int, maximum: int) -> DataFrame:
    """Binned histogram with a row for every bin from 0 to ``maximum``.

    Bins of the data beyond those, and the bin of null, are kept.
    """
    counts = histogram(df, floor_bin(key, width), "bin", "n")
    bins = _steps(df, 0, maximum, width, "bin")
    return bins.join(counts, "bin", "full_outer").select(
        "bin", F.coalesce("n", F.lit(0)).cast("bigint").alias("ct")
    )


def fill_gaps(df: DataFrame, binned: Column, width: int, name: str = "total") -> DataFrame:
    """Histogram of already binned values with a row for every bin from 0 to the largest.

    Bins below 0 are kept as well. The one-row range of bins is read by the driver, and the bins
    between are made by a distributed range.
    """
    counts = settle(histogram(df, binned, "bin", "n").filter("bin IS NOT NULL"), "bins")
    reach = counts.agg(F.min("bin").alias("low"), F.max("bin").alias("high")).first()
    if reach.high is None:
        return counts.select("bin", F.col("n").alias(name))
    bins = _steps(df, min(0, reach.low), max(0, reach.high), width, "bin")
    return bins.join(counts, "bin", "left").select(
        "bin", F.coalesce("n", F.lit(0)).cast("bigint").alias(name)
    )


def with_examples(
    df: DataFrame, bin_: str, example: Column, order: Sequence[Column], n: int = 3
) -> DataFrame:
    """Histogram with the first ``n`` examples of each bin as text.

    The limit on the row number works on each input partition before the shuffle, so a bin sends
    at most ``n`` rows from each.
    """
    places = [f"__o{i}" for i in range(len(order))]
    rows = settle(
        df.select(bin_, *[o.alias(p) for o, p in zip(order, places)], example.alias("__e")), "binned"
    )
    first = F.row_number().over(Window.partitionBy(bin_).orderBy(*places))
    picked = (
        rows.withColumn("__rn", first)
        .filter(F.col("__rn") <= n)
        .groupBy(bin_)
        .agg(F.sort_array(F.collect_list(F.struct("__rn", "__e"))).alias("__es"))
        .select(bin_, F.array_join(F.transform("__es", lambda e: e["__e"]), "|").alias("examples"))
    )
    counts = rows.groupBy(bin_).agg(F.count("*").alias("ct"))
    return attach(counts, picked, [bin_])


def as_lines(
    shares: DataFrame, by: str, bin_: str, text: Column, part_size: int
) -> DataFrame:
    """One readable line per group from its bins, in order."""
    return bag_text(shares, [by], text, [F.col(bin_)], "  ", part_size=part_size, name="line")
