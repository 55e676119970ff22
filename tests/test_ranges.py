"""Tables laid out in ranges: ranks and secondary sorts across borders, stored relations."""

from __future__ import annotations

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from relata import session
from relata.operators.joins import join_tagged, join_tagged_sorted, left_salted, secondary_sort_join
from relata.operators.numbering import lay_out, rank_rows
from relata.plans import views
from relata.plans.registry import QUERIES
from tests.conftest import rows
from tests.test_queries import plan


@pytest.fixture(autouse=True)
def small_ranges(spark):
    """Adaptive execution would put tables this small into one range."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def by_key(exchanges: str, column: str) -> bool:
    return re.search(rf"Exchange (hash|range)partitioning\([^)]*\b{column}#", exchanges) is not None


def brute_ranks(values, descending):
    def key(v):
        return (v is not None, v if v is not None else 0)

    ordered = sorted(values, key=key, reverse=descending)
    distinct = sorted(set(values), key=key, reverse=descending)
    return sorted(((v, ordered.index(v) + 1, distinct.index(v) + 1) for v in values), key=lambda r: (r[1], r[0] or 0))


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize(
    "values",
    [
        [7] * 900 + list(range(600)) + [None] * 40,
        [1] * 500 + [2] * 500 + [3],
        [None] * 50,
        [5],
        [],
        [random.Random(2).randrange(30) for _ in range(700)],
    ],
    ids=["hot", "two-hot", "nulls", "one", "none", "ties"],
)
def test_ranks_across_ranges(spark, tmp_path, values, descending):
    frame = spark.createDataFrame([(v,) for v in values], "v int").repartition(3)
    frame.write.parquet(f"{tmp_path}/v")
    stored = spark.read.parquet(f"{tmp_path}/v")
    got = rank_rows(stored, [("v", descending)], sparse="s", dense="d").collect()
    assert sorted((tuple(r) for r in got), key=lambda r: (r[1], r[0] or 0)) == brute_ranks(values, descending)


def test_a_hot_key_lies_in_many_ranges_and_needs_no_second_shuffle(spark):
    stored = session.settle(spark.range(8000).select((F.col("id") % 3 > 0).cast("int").alias("v"), "id"))
    laid = lay_out(stored, [F.col("v"), F.col("id")])
    assert laid.where("v = 1").select("__range").distinct().count() >= 4
    ranked = rank_rows(stored, [("v", True)])
    assert "hashpartitioning" not in plan(ranked) and "rangepartitioning" not in plan(ranked)
    assert ranked.groupBy("v", "rank").count().orderBy("rank").collect()[1]["rank"] == 5334


def test_ranges_are_in_order_and_places_count_up(spark):
    laid = lay_out(spark.range(5000).repartition(5), [F.col("id").desc()])
    got = laid.orderBy("__range", "__place").select("id").collect()
    assert [r.id for r in got] == list(range(4999, -1, -1))
    assert laid.select("__range", "__home").distinct().count() == laid.select("__range").distinct().count()


def tagged(spark, data):
    return spark.createDataFrame([(line,) for line in data], "value string").repartition(4)


def test_secondary_sort_equals_the_join(spark):
    data = ["Aland|aa", "Aland again|aa", "Beta|bb", "None there|zz", "", "no fields"]
    data += [f"p{i}|s{i % 3}|{'aa' if i % 3 else 'bb'}" for i in range(3000)]
    data += ["q|s|nowhere", "q|s|aa", "q|s|aa", "r|s|bb|more"]
    lines = tagged(spark, data)
    expected = rows(join_tagged(lines))
    assert len(expected) == 2 * 2000 + 1000 + 2 * 2 + 1
    assert rows(join_tagged_sorted(lines)) == expected


def test_dimension_rows_reach_facts_in_later_ranges(spark):
    """All facts of one code, which lies in every range; its dimension rows lie in the first."""
    data = [("hot", True, f"d{i}", None) for i in range(3)] + [("hot", False, None, f"f{i}") for i in range(4000)]
    frame = spark.createDataFrame(data + [(None, True, "d", None), (None, False, None, "f")],
                                  "k string, first boolean, d string, f string")
    got = secondary_sort_join(frame, "k", F.col("first"), ["d"], ["f"])
    assert got.count() == 12_000 and got.distinct().count() == 12_000
    laid = lay_out(frame.where("k = 'hot'"), [F.col("k"), F.col("first").desc(), F.xxhash64("f")])
    assert laid.select("__range").distinct().count() >= 4
    assert rows(secondary_sort_join(frame.limit(0), "k", F.col("first"), ["d"], ["f"])) == []


def test_secondary_sort_reads_the_text_once(spark, data):
    text = plan(QUERIES["join_secondary_sort"](spark, data))
    assert "FileScan text" not in text and not by_key(text.split("BroadcastExchange")[0], "code")


@pytest.mark.parametrize("name", ["agg_career", "topk_per_group", "join_inner"])
def test_queries_on_the_stored_relation_do_not_shuffle_by_player(spark, data, name):
    text = plan(QUERIES[name](spark, data))
    assert "relata_seasons_" in text and not by_key(text, "player_id")


def test_large_sides_in_the_same_buckets_meet_in_place(spark, data):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES["join_inner"](spark, data))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in text and "Exchange" not in text


def test_a_relation_is_built_once_and_again_when_its_input_changes(spark, tmp_path):
    path, built = f"{tmp_path}/t.parquet", []

    def build():
        built.append(1)
        return session.settle(spark.read.parquet(path))

    spark.range(3).write.parquet(path)
    first = session.once(spark, "t", [path], build)
    assert session.once(spark, "t", [path], build) is first and len(built) == 1
    spark.range(5).write.mode("overwrite").parquet(path)
    assert session.once(spark, "t", [path], build).count() == 5 and len(built) == 2


def test_seasons_are_stored_in_files_of_one_bucket(spark, data):
    stored = views.seasons((spark, data))
    names = {os.path.basename(f) for f in stored.inputFiles()}
    assert len(names) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_left_join_keeps_equal_rows_of_a_hot_key(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, l string")
    right = spark.createDataFrame([(1, "x")] * 50 + [(1, "y"), (3, "z"), (None, "n")], "k int, r string")
    got = left_salted(left, right, ["k"], salts=4)
    assert rows(got) == rows(left.join(right, "k", "left"))
