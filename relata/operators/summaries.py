"""Complete summaries of one field, for a whole table or per group.

Values are counted first; all figures come from one row per distinct value. A group of any size
thus shrinks before it travels, and quantiles are read off running totals over many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from relata.functions.scalars import shorten
from relata.operators.numbering import running_totals
from relata.session import settle

# The quantiles of a numeric and of a text summary.
EDGES = {"p01": 0.01, "p05": 0.05, "p50": 0.50, "p95": 0.95, "p99": 0.99}
FULL_EDGES = {
    "p01": 0.01, "p05": 0.05, "p10": 0.10, "p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99,
}


def _value_counts(df: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    return df.groupBy(*by, value.alias("value")).agg(F.count("*").alias("ct"))


def _amount(counts: DataFrame) -> Column:
    """Value times count; whole numbers as decimals, which do not overflow."""
    whole = isinstance(counts.schema["value"].dataType, IntegralType)
    return (F.col("value").cast("decimal(38,0)") if whole else F.col("value")) * F.col("ct")


def _ranked(
    counts: DataFrame, by: Sequence[str], amounts: Mapping[str, Column] | None = None
) -> DataFrame:
    """Distinct values with count and running totals; nulls count nothing in the totals."""
    known = F.when(F.col("value").isNotNull(), F.col("ct")).otherwise(0)
    order = [F.col("value").asc_nulls_first()]
    return running_totals(counts, by, order, {"n": known, **(amounts or {})})


def _quantile(share: float) -> Column:
    """The smallest value that at least this share of the values does not exceed."""
    total = F.col("n_total")
    rank = F.greatest(total - F.floor(total - F.lit(share) * total), F.lit(1))
    inside = (F.col("n_before") < rank) & (rank <= F.col("n_before") + F.col("ct"))
    return F.min(F.when(F.col("value").isNotNull() & inside, F.col("value")))


def quantiles(
    df: DataFrame, value: Column, by: Sequence[str] = (), edges: Mapping[str, float] = EDGES
) -> DataFrame:
    """Exact quantiles as columns, of any type that has an order."""
    ranked = _ranked(_value_counts(df, by, value), by)
    return ranked.groupBy(*by).agg(*[_quantile(p).alias(name) for name, p in edges.items()])


def quantiles_approx(
    df: DataFrame,
    value: Column,
    by: Sequence[str] = (),
    edges: Mapping[str, float] = EDGES,
    accuracy: int = 10_000,
) -> DataFrame:
    """Quantiles from a bounded sketch in one pass, off by at most ``1/accuracy`` in rank."""
    sketch = F.percentile_approx(value, list(edges.values()), accuracy)
    found = df.groupBy(*by).agg(sketch.alias("__q"))
    return found.select(*by, *[F.get("__q", F.lit(i)).alias(n) for i, n in enumerate(edges)])


def _total(count: Column) -> Column:
    return F.coalesce(F.sum(count), F.lit(0))


def _spread(population: bool) -> Column:
    mean = F.col("s_total").cast("double") / F.nullif(F.col("n_total"), F.lit(0))
    away = F.sum(F.col("ct") * (F.col("value") - mean) * (F.col("value") - mean))
    count = F.max("n_total") if population else F.max("n_total") - 1
    return F.sqrt(F.try_divide(away, count.cast("double")))


def describe_numeric(
    df: DataFrame,
    value: Column,
    by: Sequence[str] = (),
    edges: Mapping[str, float] = EDGES,
    n_examples: int = 5,
    population: bool = True,
) -> DataFrame:
    """Mean, deviation, extremes, quantiles, record, null and distinct counts, sum, examples.

    The examples are the smallest distinct values. Null is one of the distinct values.
    """
    return _describe(_value_counts(df, by, value), by, edges, n_examples, population)


def _describe(
    counts: DataFrame,
    by: Sequence[str],
    edges: Mapping[str, float],
    n_examples: int,
    population: bool,
) -> DataFrame:
    known = F.col("value").isNotNull()
    ranked = _ranked(
        counts,
        by,
        {"d": F.when(known, 1).otherwise(0), "s": F.coalesce(_amount(counts), F.lit(0))},
    )
    example = F.when(
        F.col("value").isNotNull() & (F.col("d_before") < n_examples), F.col("value")
    )
    return ranked.groupBy(*by).agg(
        F.try_divide(F.max("s_total").cast("double"), F.max("n_total").cast("double")).alias("avg_val"),
        _spread(population).alias("stddev_val"),
        F.min("value").alias("min_val"),
        *[_quantile(p).alias(name) for name, p in edges.items()],
        F.max("value").alias("max_val"),
        _total(F.col("ct")).alias("n_recs"),
        _total(F.when(F.col("value").isNull(), F.col("ct"))).alias("n_nulls"),
        F.count("*").alias("cardinality"),
        F.sum(_amount(counts)).alias("sum_val"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(example)), lambda v: v.cast("string")), "^"
        ).alias("some_vals"),
    )


def describe_numeric_sketched(
    df: DataFrame,
    value: Column,
    by: Sequence[str] = (),
    edges: Mapping[str, float] = EDGES,
    accuracy: int = 10_000,
    population: bool = True,
) -> DataFrame:
    """The figures of :func:`describe_numeric` but for the examples, in one pass without a sort.

    Quantiles are off by at most ``1/accuracy`` in rank; the number of distinct values is an
    estimate. For fields with very many distinct values.
    """
    spread = F.stddev_pop if population else F.stddev_samp
    unknown = F.count_if(value.isNull())
    whole = isinstance(df.select(value).schema[0].dataType, IntegralType)
    amount = value.cast("decimal(38,0)") if whole else value  # a bigint's sum may overflow
    found = df.groupBy(*by).agg(
        F.avg(value).alias("avg_val"),
        spread(value).alias("stddev_val"),
        F.min(value).alias("min_val"),
        F.percentile_approx(value, list(edges.values()), accuracy).alias("__q"),
        F.max(value).alias("max_val"),
        F.count("*").alias("n_recs"),
        unknown.alias("n_nulls"),
        (F.approx_count_distinct(value) + (unknown > 0).cast("int")).alias("cardinality"),
        F.sum(amount).alias("sum_val"),
    )
    places = {name: F.get("__q", F.lit(i)).alias(name) for i, name in enumerate(edges)}
    return found.select(
        *by,
        "avg_val", "stddev_val", "min_val", *places.values(), "max_val",
        "n_recs", "n_nulls", "cardinality", "sum_val",
    )


def describe_text(
    df: DataFrame,
    column: str,
    by: Sequence[str] = (),
    edges: Mapping[str, float] = FULL_EDGES,
    n_examples: int = 5,
) -> DataFrame:
    """Length figures and quantiles, null and distinct counts, extremes and examples of a text.

    The examples are the smallest distinct texts, shortened.
    """
    text = F.col(column)
    values = settle(df.groupBy(*by, text).agg(F.count("*").alias("ct")), "texts")
    overall = values.groupBy(*by).agg(
        _total(F.col("ct")).alias("n_recs"),
        _total(F.when(text.isNull(), F.col("ct"))).alias("n_nulls"),
        F.count("*").alias("cardinality"),
        F.min(text).alias("minval"),
        F.max(text).alias("maxval"),
    )
    sizes = values.groupBy(*by, F.length(text).alias("value")).agg(F.sum("ct").alias("ct"))
    lengths = _describe(sizes, by, edges, 0, True).select(
        *by,
        F.col("min_val").alias("minlen"),
        *edges,
        F.col("max_val").alias("maxlen"),
        F.col("avg_val").alias("avglen"),
        F.col("stddev_val").alias("stdvlen"),
        F.col("sum_val").alias("sumlen"),
    )
    shown = smallest_texts(values.filter(text.isNotNull()), by, column, n_examples)
    return (
        _one_row(by, lengths, overall, shown)
        .withColumn("examples", F.coalesce("examples", F.lit("")))
        .withColumn("var", F.lit(column))
    )


def _one_row(by: Sequence[str], *parts: DataFrame) -> DataFrame:
    """Merge tables that hold different columns of the same groups."""
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    figures = [c for c in stacked.columns if c not in by]
    return stacked.groupBy(*by).agg(*[F.max(c).alias(c) for c in figures])


def smallest_texts(values: DataFrame, by: Sequence[str], column: str, n: int) -> DataFrame:
    """The ``n`` smallest texts of each group as one line; ``values`` has each text once."""
    if by:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(column))
        first = values.withColumn("__rn", place).filter(F.col("__rn") <= n)
    else:
        first = values.orderBy(column).limit(n)
    return first.groupBy(*by).agg(F.sort_array(F.collect_list(column)).alias("__t")).select(
        *by, F.array_join(F.transform("__t", lambda t: shorten(t)), "^").alias("examples")
    )
