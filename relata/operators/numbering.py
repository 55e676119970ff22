"""Row numbers, ranks and running totals that never bring a whole group into one task.

A window over one big group sorts it in a single task. Here the rows are range-partitioned on
group and order instead, so a group of any size spreads over many tasks, and only one figure
per partition is carried from each partition to the next.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relata.session import buckets, settle, settle_bucketed

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the partition above these bits
_BLOCK = 1_000_000  # copies of one row that a single task writes out


def renamed_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column, list[str]]:
    """``df`` with its keys renamed, the condition that joins it to a table with the plain names,
    null keys matching each other, and the new names."""
    names = ["__k_" + k for k in keys]
    condition = F.lit(True)
    for key, name in zip(keys, names):
        condition = condition & F.col(key).eqNullSafe(F.col(name))
    return df.withColumnsRenamed(dict(zip(keys, names))), condition, names


def attach(
    rows: DataFrame, extra: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join ``extra``, which has one row per key, to ``rows``. Null keys match each other."""
    right, condition, names = renamed_keys(extra, keys)
    return rows.join(right, condition, how).drop(*names)


def number_rows(
    df: DataFrame, order: Sequence[Column] = (), name: str = "row_no", start: int = 1
) -> DataFrame:
    """Consecutive numbers from ``start`` in the given order, or in any order if none is given.

    One range shuffle, then a stored copy. The number is the place within the partition plus the
    rows of earlier partitions, of which there is one figure per partition. Rows that tie in the
    whole order stay in one partition: end the order with a key, or see :func:`number_copies`.
    """
    laid = df.orderBy(*order) if order else df
    laid = settle(laid.withColumn("__place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__place", _LOCAL_BITS)
    local = F.col("__place").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    sizes = laid.groupBy(part.alias("__part")).agg(F.max(local).alias("__last"))
    # one row per partition of the sorted table
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "__part",
        F.coalesce(F.sum(F.col("__last") + 1).over(before), F.lit(0)).alias("__offset"),
    )
    return (
        laid.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .withColumn(name, (F.col("__offset") + local + start).cast("bigint"))
        .drop("__part", "__place", "__offset")
    )


def number_copies(
    df: DataFrame, order: Sequence[Column], name: str = "row_no", start: int = 1
) -> DataFrame:
    """Number the rows of a table with many equal rows; ``order`` has to tell unequal ones apart.

    Equal rows are counted first and only one of each is sorted. They are written out again in
    blocks, which spread over tasks.
    """
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("__ct"))
    placed = running_totals(counted, [], order, {"__n": F.col("__ct")})
    blocks = placed.select(
        *df.columns,
        "__ct",
        "__n_before",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(__ct - 1) div {_BLOCK}"))).alias("__block"),
    )
    first = F.col("__block") * _BLOCK
    last = F.least(first + _BLOCK, F.col("__ct")) - 1
    base = F.col("__n_before") + start
    return blocks.repartition("__n_before", "__block").select(
        *df.columns, F.explode(F.sequence(base + first, base + last)).alias(name)
    )


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    amounts: Mapping[str, Column],
    ranges: int | None = None,
) -> DataFrame:
    """For each amount: ``<name>_before``, its total over earlier rows of the group, and
    ``<name>_total``, its total over the group.

    Rows of a group need distinct order values. A window adds up within each range, without another
    shuffle. What is carried over concerns only groups that lie in several ranges; as each range
    continues at most one group from the range before it, these are at most two rows per range.
    ``ranges`` is their number, as in :func:`lay_out`.
    """
    named = df.select("*", *[expr.alias("__a_" + n) for n, expr in amounts.items()])
    laid = lay_out(named, [*map(F.col, by), *order], ranges)
    keys = [*by, "__home"]
    # one row per group and range
    per_part = laid.groupBy(*keys, "__range").agg(
        *[F.sum("__a_" + n).alias("__s_" + n) for n in amounts]
    )
    whole = Window.partitionBy(*by)
    earlier = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    spread = (
        per_part.select(
            *keys,
            F.count("*").over(whole).alias("__parts"),
            *[F.sum("__s_" + n).over(earlier).alias("__c_" + n) for n in amounts],
            *[F.sum("__s_" + n).over(whole).alias("__w_" + n) for n in amounts],
        )
        .filter("__parts > 1")
        .drop("__parts")
    )
    here = Window.partitionBy(*keys)
    above = here.orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    local = laid.select(
        "*",
        *[F.sum("__a_" + n).over(above).alias("__l_" + n) for n in amounts],
        *[F.sum("__a_" + n).over(here).alias("__h_" + n) for n in amounts],
    )
    zero = F.lit(0)
    return attach(local, F.broadcast(spread), keys, "left").select(
        *df.columns,
        *[
            (F.coalesce("__l_" + n, zero) + F.coalesce("__c_" + n, zero)).alias(n + "_before")
            for n in amounts
        ],
        *[F.coalesce("__w_" + n, "__h_" + n).alias(n + "_total") for n in amounts],
    )


@cache
def _homes(spark: SparkSession, number: int) -> list[int]:
    """A whole number for each of ``number`` buckets that Spark's hash puts there."""
    tried = 16 * number + 64
    while True:
        ids = spark.range(tried).select(F.col("id").cast("int").alias("id"))
        found = ids.groupBy(F.pmod(F.hash("id"), F.lit(number)).alias("b")).agg(F.min("id").alias("id"))
        rows = found.collect()  # one per bucket
        if len(rows) == number:
            return [r.id for r in sorted(rows, key=lambda r: r.b)]
        tried *= 2


def lay_out(df: DataFrame, order: Sequence[Column], ranges: int | None = None) -> DataFrame:
    """``df`` sorted over all tasks and stored so that each range can be worked on in place.

    Adds ``__range``, the number of a row's range of the order, ``__place``, its place there, and
    ``__home``, which windows and roll-ups use: a range is one bucket of the stored table, so those
    whose keys hold ``__home`` need no further shuffle. Rows that tie in the whole order share a
    range; end the order with something that tells them apart. ``ranges`` is the number of ranges
    where the caller knows how many rows there are; without it, adaptive execution makes ranges of a
    size of its own.
    """
    spark = df.sparkSession
    number = ranges or buckets(spark)
    homes = F.lit(_homes(spark, number))
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    if ranges:
        laid = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    else:
        laid = df.orderBy(*order)
    laid = laid.select(
        "*", F.spark_partition_id().alias("__range"), local.alias("__place")
    )
    laid = laid.withColumn("__home", F.element_at(homes, F.col("__range") + 1))
    return settle_bucketed(laid, ["__home"], ["__place"], "laid_out", number)


def rank_rows(
    df: DataFrame,
    order: Sequence[tuple[str, bool]],
    sparse: str | None = "rank",
    dense: str | None = None,
) -> DataFrame:
    """Rank the whole table by ``order``, pairs of column and descending flag.

    Rows that tie share a rank. The sparse rank leaves gaps after ties, the dense one does not.
    Nulls sort lowest.

    One range shuffle by the order and the row's place in ``df``, so a key held by very many rows
    spreads over ranges. Each range is ranked by itself. What goes from one range to the next is the
    number of rows and keys so far and, where a range begins with the key that the one before ended
    in, that key's rank: one row per range. ``df`` should be stored, so that a row's place holds.
    """
    names = [c for c, _ in order]
    directions = [
        F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for c, down in order
    ]
    placed = df.withColumn("__row", F.monotonically_increasing_id())
    # a number of ranges that holds: put together, two could have half of a hot key's rows each
    ranges = buckets(df.sparkSession)
    laid = lay_out(placed, [*directions, F.col("__row")], ranges).drop("__row")
    here = Window.partitionBy("__home").orderBy(*directions)
    local = laid.select("*", F.rank().over(here).alias("__r"), F.dense_rank().over(here).alias("__d"))
    key = F.struct(*names)
    ranges = local.groupBy("__home", "__range").agg(
        F.count("*").alias("n"),
        F.max("__r").alias("r"),
        F.max("__d").alias("d"),
        F.min_by(key, "__place").alias("first"),
        F.max_by(key, "__place").alias("last"),
    )
    along = Window.orderBy("__range")  # one row per range
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    ranges = ranges.withColumn(
        "goes_on",
        (F.row_number().over(along) > 1) & F.col("first").eqNullSafe(F.lag("last").over(along)),
    )
    ranges = ranges.withColumns(
        {
            "rows_before": F.coalesce(F.sum("n").over(before), zero),
            "keys_before": F.coalesce(
                F.sum(F.col("d") - F.col("goes_on").cast("int")).over(before), zero
            ) - F.col("goes_on").cast("int"),
        }
    )
    # the rank of a range's last key, unless an earlier range began it
    begun = F.when(~F.col("goes_on") | (F.col("d") > 1), F.col("rows_before") + F.col("r"))
    carried = ranges.select(
        F.col("__home").alias("__to"),
        "rows_before",
        "keys_before",
        F.when(F.col("goes_on"), F.last(begun, ignorenulls=True).over(before)).alias("carried"),
    )
    rank = F.when(F.col("__d") == 1, F.col("carried"))
    joined = local.join(F.broadcast(carried), F.col("__home") == F.col("__to"))
    return joined.select(
        *df.columns,
        *([F.coalesce(rank, F.col("rows_before") + F.col("__r")).cast("bigint").alias(sparse)] if sparse else []),
        *([(F.col("keys_before") + F.col("__d")).cast("bigint").alias(dense)] if dense else []),
    )
