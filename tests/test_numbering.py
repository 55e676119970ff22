from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from relata.operators import numbering
from relata.operators.numbering import number_copies, number_rows, rank_rows, running_totals
from tests.conftest import rows


def hot_table(spark, n=3000, seed=1):
    """A third of all rows belong to one key."""
    draw = random.Random(seed)
    data = [
        (0 if i % 3 == 0 else draw.randrange(1, 40), draw.randrange(-50, 50), i) for i in range(n)
    ]
    return spark.createDataFrame(data, "k int, v int, id int").repartition(8), data


def test_numbers_follow_the_order_without_gaps(spark):
    df, data = hot_table(spark)
    numbered = number_rows(df, [F.col("v").desc(), F.col("id")])
    got = [r.id for r in numbered.orderBy("row_no").collect()]
    assert got == [r[2] for r in sorted(data, key=lambda r: (-r[1], r[2]))]
    assert rows(numbered.select("row_no")) == [(i + 1,) for i in range(len(data))]


def test_numbers_without_an_order_are_still_consecutive(spark):
    df, data = hot_table(spark)
    numbered = number_rows(df, start=0)
    assert rows(numbered.select("row_no")) == [(i,) for i in range(len(data))]
    assert rows(numbered.drop("row_no")) == sorted(data)


def test_numbering_nothing(spark):
    empty = spark.createDataFrame([], "k int")
    assert rows(number_rows(empty, [F.col("k")])) == []
    assert rows(number_copies(empty, [F.col("k")])) == []


def test_equal_rows_are_numbered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(numbering, "_BLOCK", 7)
    values = ["b"] * 50 + ["a"] * 3 + [None] * 9 + ["c"]
    df = spark.createDataFrame([(v,) for v in values], "value string").repartition(5)
    got = [r.value for r in number_copies(df, [F.col("value").asc_nulls_first()]).orderBy("row_no").collect()]
    assert got == [None] * 9 + ["a"] * 3 + ["b"] * 50 + ["c"]


def test_running_totals_carry_over_partitions(spark):
    df, data = hot_table(spark)
    got = running_totals(df, ["k"], [F.col("id")], {"v": F.col("v"), "n": F.lit(1)})
    want = []
    for k, v, i in data:
        group = [r for r in data if r[0] == k]
        earlier = [r[1] for r in group if r[2] < i]
        want.append((k, v, i, sum(earlier), len(earlier), sum(r[1] for r in group), len(group)))
    assert rows(got) == sorted(want)


def test_running_totals_of_the_whole_table_and_of_null_groups(spark):
    data = [(None, 1), (None, 2), (1, 3), (1, 4)]
    df = spark.createDataFrame(data, "k int, v int")
    got = running_totals(df, ["k"], [F.col("v")], {"s": F.col("v")})
    assert rows(got) == [(None, 1, 0, 3), (None, 2, 1, 3), (1, 3, 0, 7), (1, 4, 3, 7)]
    whole = running_totals(df, [], [F.col("v")], {"s": F.col("v")})
    assert [r[2] for r in sorted(rows(whole), key=lambda r: r[1])] == [0, 1, 3, 6]


@pytest.mark.parametrize("order", [[("v", True)], [("v", True), ("k", False)], [("k", False)]])
def test_ranks_equal_those_of_a_window(spark, order):
    df, _ = hot_table(spark, 900)
    df = df.withColumn("v", F.when(F.col("v") != 7, F.col("v")))
    window = Window.orderBy(*[F.desc_nulls_last(c) if down else F.asc_nulls_first(c) for c, down in order])
    want = df.select("*", F.rank().over(window).alias("r"), F.dense_rank().over(window).alias("d"))
    assert rows(rank_rows(df, order, "r", "d").select(*want.columns)) == rows(want)


def test_a_hot_group_is_spread_when_totals_are_taken(spark):
    df, _ = hot_table(spark)
    totals = running_totals(df.filter("k = 0"), ["k"], [F.col("id")], {"n": F.lit(1)})
    plan = totals._jdf.queryExecution().toString()
    # the windows group by the range of the sorted table as well as by the key
    assert "__home" in plan.split("Window", 1)[1].split("\n", 1)[0]
