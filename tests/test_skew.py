"""Joins on a hot key are split when they run."""

from __future__ import annotations

import contextlib

import pytest
from pyspark.sql import functions as F

from relata.operators.joins import anti, join_on, join_tagged, left_salted, semi
from relata.operators.numbering import attach, rank_rows
from relata.operators.ranking import shuffle_rows
from tests.conftest import rows

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@contextlib.contextmanager
def settings(spark, values):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def hot(spark):
    """Half of the rows share one key; they come in many pieces."""
    key = F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 500)
    return spark.range(0, 60_000, 1, 8).select(
        key.alias("k"), F.col("id"), F.concat(F.lit("payload"), F.sha2(F.col("id").cast("string"), 256)).alias("t")
    )


def keys(spark):
    return spark.range(0, 300, 1, 4).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))


@pytest.mark.parametrize(
    "build",
    [
        lambda spark, hot: semi(hot, keys(spark).unionByName(keys(spark)), ["k"]),
        lambda spark, hot: anti(hot, keys(spark).filter("k != 7"), ["k"]),
        lambda spark, hot: join_on(hot, keys(spark).withColumnRenamed("k", "key"), {"k": "key"}, "left"),
        lambda spark, hot: attach(hot, keys(spark).groupBy("k").agg(F.sum("v").alias("v")), ["k"]),
        lambda spark, hot: join_tagged(
            hot.select(F.concat_ws("|", "id", "t", "k").alias("value")).unionByName(
                keys(spark).select(F.concat_ws("|", "v", "k").alias("value"))
            )
        ),
    ],
    ids=["semi", "anti", "left", "attach", "tagged"],
)
def test_hot_key_is_split(spark, hot, build):
    with settings(spark, SMALL):
        df = build(spark, hot)
        n = len(df.collect())
        plan = df._jdf.queryExecution().executedPlan().toString()
    assert "skewed" in plan and "skew=true" in plan
    assert n == build(spark, hot).count()


def test_a_hot_key_is_ranked_by_many_tasks(spark, hot):
    """Ranks need no join that could be split: the key's rows lie in several ranges."""
    with settings(spark, SMALL):
        ranked = rank_rows(hot, [("k", True)])
        tasks = ranked.where("k = 7").groupBy(F.spark_partition_id().alias("p")).count().collect()
    rows_of_key = sum(t["count"] for t in tasks)
    assert rows_of_key > 30_000 and len(tasks) >= 3  # half of the rows, so half of the ranges
    assert max(t["count"] for t in tasks) < rows_of_key / 2
    assert ranked.count() == 60_000


def test_a_left_join_deals_out_the_hot_side(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, l string")
    right = spark.range(3000).select(F.lit(1).alias("k"), F.col("id").alias("r"))
    joined = left_salted(left, right, ["k"])
    assert joined.columns == ["k", "l", "r"]
    assert rows(joined) == rows(left.join(right, "k", "left"))
    assert rows(left_salted(left, right.limit(0), ["k"])) == rows(left.join(right.limit(0), "k", "left"))


def test_hot_keys_in_a_shuffle_spread(spark):
    hot = spark.range(6000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    done = shuffle_rows(hot, ["k"], "seed")
    assert sorted(r.row_no for r in done.select("row_no").collect()) == list(range(1, 6001))
    place = {r.k: r.row_no for r in done.filter("k <> 0").collect()}
    again = {r.k: r.row_no for r in shuffle_rows(hot.repartition(5), ["k"], "seed").filter("k <> 0").collect()}
    assert place == again
