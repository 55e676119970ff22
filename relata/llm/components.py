"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.llm.arrow import settle


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each end of ``links`` (a, b): the smallest node that it reaches.

    Each round hangs nodes onto the smallest node they see, first seen from larger neighbours, then
    from smaller ones; rounds grow with the logarithm of the longest path. Minima are combined
    ahead of the shuffle and joined back; those of the large star are stored first, so that both
    sides of its join are plain shuffles and a node with very many links can be split. Every round
    is stored. The rounds end when no link changes.
    """
    pairs = links.where("a <> b").select(
        F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")
    )
    pairs = settle(pairs.distinct(), "links")
    before = None
    while (state := _state(pairs)) != before:
        before = state
        both = pairs.select(F.col("high").alias("node"), F.col("low").alias("other")).unionByName(
            pairs.select(F.col("low").alias("node"), F.col("high").alias("other"))
        )
        least = settle(both.groupBy("node").agg(F.min(F.least("node", "other")).alias("least")), "least")
        large = settle(
            both.where("other > node")
            .join(least, "node")
            .select(F.col("other").alias("high"), F.col("least").alias("low"))
            .distinct(),
            "large-star",
        )
        least = large.groupBy("high").agg(F.min("low").alias("least"))
        small = large.join(least, "high").select(
            F.explode(
                F.array(
                    F.struct(F.col("high").alias("high"), F.col("least").alias("low")),
                    F.struct(F.col("low").alias("high"), F.col("least").alias("low")),
                )
            ).alias("p")
        )
        pairs = settle(small.select("p.high", "p.low").where("high <> low").distinct(), "small-star")
    ends = pairs.select(F.col("high").alias("node"), F.col("low").alias("label"))
    roots = pairs.select(F.col("low").alias("node"), F.col("low").alias("label")).distinct()
    return ends.unionByName(roots)


def _state(pairs: DataFrame) -> tuple:
    return tuple(
        pairs.agg(
            F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))
        ).first()
    )
