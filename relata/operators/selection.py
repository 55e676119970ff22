"""Exact quantiles of a whole table by selection: ranks narrowed to brackets, no global sort.

Three passes over the values. A sketch gives, for each quantile, two values that its rank lies
between; counts of the values below and up to these verify that and give the rank inside; the few
values inside the brackets, about four times ``1/accuracy`` of the rows, are counted and ranked.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relata.operators.numbering import running_totals
from relata.operators.summaries import EDGES


@dataclass(frozen=True)
class Bracket:
    """Two values (null: no limit) with the rank of a quantile in between, and the rows below."""

    low: Any
    high: Any
    rank: int
    below: int

    def holds(self, value: Column) -> Column:
        """Whether a value lies inside. Values without either limit are all inside."""
        inside = F.lit(True)
        if self.low is not None:
            inside = inside & (value >= F.lit(self.low))
        if self.high is not None:
            inside = inside & (value <= F.lit(self.high))
        return inside


def _rank(share: float, total: int) -> int:
    """Of the smallest value that at least this share of the values does not exceed."""
    return max(total - math.floor(total - share * total), 1)


def brackets(known: DataFrame, edges: Mapping[str, float], accuracy: int) -> dict[str, Bracket]:
    """Brackets for the quantiles of the column ``value``; none if there are no rows. Two passes."""
    around = [
        min(max(share + side * 2 / accuracy, 0.0), 1.0)
        for share in edges.values()
        for side in (-1, 1)
    ]
    first = known.agg(
        F.count("*").alias("n"), F.percentile_approx("value", around, accuracy).alias("q")
    ).head()
    if not first["n"]:
        return {}
    limits = {
        name: (first["q"][2 * i], first["q"][2 * i + 1]) for i, name in enumerate(edges)
    }
    value = F.col("value")
    counts = known.agg(
        *[F.count_if(value < F.lit(low)).alias(f"below_{n}") for n, (low, _) in limits.items()],
        *[F.count_if(value <= F.lit(high)).alias(f"upto_{n}") for n, (_, high) in limits.items()],
    ).head()
    found = {}
    for name, share in edges.items():
        rank, (low, high) = _rank(share, first["n"]), limits[name]
        below = counts[f"below_{name}"]
        if rank <= below:  # beyond the sketch's promise: search without this limit
            low, below = None, 0
        if rank > counts[f"upto_{name}"]:
            high = None
        found[name] = Bracket(low, high, rank, below)
    return found


def quantiles_by_selection(
    df: DataFrame, value: Column, edges: Mapping[str, float] = EDGES, accuracy: int = 10_000
) -> DataFrame:
    """The one row of ``summaries.quantiles`` without groups, for numbers, dates and timestamps.

    Meant for fields of very many distinct values: only values inside the brackets are sorted, and
    their limits reach the scan as filters. Neither skew of the values nor equal ones matter, as
    limits are values of the table and equal values are counted. The driver reads two rows: the
    limits and their counts. Nulls are left out; without a value all quantiles are null. ``df`` is
    read three times; store it first if it is costly.
    """
    named = df.select(value.alias("value"))
    kind = named.schema["value"].dataType
    known = named.filter(F.col("value").isNotNull())
    found = brackets(known, edges, accuracy)
    if not found:
        nulls = [F.lit(None).cast(kind).alias(name) for name in edges]
        return df.sparkSession.range(1).select(*nulls)
    inside = F.lit(False)
    for each in found.values():
        inside = inside | each.holds(F.col("value"))
    counts = known.filter(inside).groupBy("value").agg(F.count("*").alias("ct"))
    places = F.array(
        *[F.when(each.holds(F.col("value")), F.lit(i)) for i, each in enumerate(found.values())]
    )
    dealt = counts.withColumn("edge", F.explode(F.array_compact(places)))
    ranked = running_totals(dealt, ["edge"], [F.col("value").asc()], {"n": F.col("ct")})

    def pick(i: int, each: Bracket) -> Column:
        inner = each.rank - each.below
        here = (F.col("n_before") < inner) & (inner <= F.col("n_before") + F.col("ct"))
        return F.min(F.when((F.col("edge") == i) & here, F.col("value")))

    return ranked.agg(*[pick(i, each).alias(name) for i, (name, each) in enumerate(found.items())])
