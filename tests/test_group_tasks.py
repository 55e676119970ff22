"""Tasks of a size that does not follow the table's."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from relata.operators import nesting
from relata.operators.nesting import bag_text, bags, set_changes, tasks_for
from relata.plans import nested as nested_plans
from relata.plans import stores  # noqa: F401
from relata.plans.registry import QUERIES
from tests.conftest import rows
from tests.test_nesting import expected_parts, member_rows


def test_number_of_tasks_follows_the_rows():
    assert [tasks_for(n) for n in (0, 1, 50_000, 50_001, 10_000_000, 200_000_000)] == [1, 1, 1, 2, 200, 200]
    assert tasks_for(3_000_000_000) == 3000


@pytest.mark.parametrize("whole", [16_000, 1])
def test_rows_of_a_task_are_bounded(spark, monkeypatch, whole):
    """Whether groups are gathered whole or sorted into places, adaptive execution puts no tasks together."""
    monkeypatch.setattr(nesting, "TASK_ROWS", 100)
    monkeypatch.setattr(nesting, "WHOLE_ROWS", whole)
    df = spark.range(4000).select((F.col("id") % 400).alias("g"), F.col("id").alias("m"))
    nested = bags(df, ["g"], ["m"], ["m"], part_size=4)
    sizes = nested.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.size("bag")).alias("n")).collect()
    assert sum(r["n"] for r in sizes) == 4000
    assert len(sizes) >= 30 and max(r["n"] for r in sizes) <= 300


@pytest.mark.parametrize("size, whole", [(7, 130), (7, 1), (30, 150), (100_000, 1)])
def test_whole_and_large_groups_together(spark, monkeypatch, size, whole):
    monkeypatch.setattr(nesting, "WHOLE_ROWS", whole)
    data = member_rows()
    df = spark.createDataFrame(data, "g string, o int, m string").repartition(8)
    totals = {"top": F.max("o"), "n": F.count("*"), "one": (F.count("*") == 1).cast("int")}
    got = bags(df, ["g"], ["m"], ["o"], part_size=size, totals=totals).collect()
    assert {(r.g, r.part): (r.n_members, [x.m for x in r.bag]) for r in got} == expected_parts(data, size)
    for r in got:
        group = [o for g, o, _ in data if g == r.g]
        assert (r.n, r.top, r.one) == (len(group), max(o for o in group if o is not None), 0)


def test_texts_of_large_groups_equal_those_of_whole_ones(spark, monkeypatch):
    df = spark.createDataFrame(member_rows(), "g string, o int, m string")
    texts = []
    for whole in (16_000, 1):
        monkeypatch.setattr(nesting, "WHOLE_ROWS", whole)
        texts.append(rows(bag_text(df, ["g"], F.col("m"), [-F.col("o"), F.col("m")], "|", part_size=20)))
    assert texts[0] == texts[1]


def test_no_rows_give_no_bags(spark):
    df = spark.createDataFrame([], "g string, m int")
    assert bags(df, ["g"], ["m"], ["m"], part_size=3, totals={"n": F.count("*")}).collect() == []


def test_changes_of_sets_do_not_depend_on_tasks(spark):
    data = [("a", 1, "x"), ("a", 2, "x"), ("a", 2, "y"), (None, 1, None), ("b", None, "z"), ("b", 3, "z"), ("b", 3, "z")]
    df = spark.createDataFrame(data, "g string, y int, m string")
    dealt = set_changes(df, ["g"], "m", "y", tasks=5)
    assert rows(dealt) == rows(set_changes(df, ["g"], "m", "y"))
    assert dealt.rdd.getNumPartitions() == 5


def test_lines_of_bags_are_checked_once(spark, data):
    """The bags and the number of rejects come from one stored reading of the lines."""
    plan = QUERIES["sink_bag_text"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "FileScan text" not in plan


def test_cities_are_added_up_from_stored_stays(spark, data, monkeypatch):
    labels = []
    settle = nested_plans.settle
    monkeypatch.setattr(nested_plans, "settle", lambda df, label: labels.append(label) or settle(df, label))
    QUERIES["park_farhome_json"](spark, data)
    assert labels == ["stays", "cities"]
