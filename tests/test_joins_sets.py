from __future__ import annotations

import random

from pyspark.sql import functions as F

from relata.operators import sets
from relata.operators.joins import (
    anti,
    coverage,
    fanout,
    join_on,
    join_tagged,
    pair_counts,
    partners,
    semi,
    tagged_lines,
)
from tests.conftest import rows

# Two small record sets in one text.
LINES = [
    "United States|US", "Canada|CA", "United Kingdom|UK", "Italy|IT",
    "Alice Bob|not bad|US", "Sam Sneed|valued|CA", "Jon Sneed|valued|CA",
    "Arnold Wesise|not so good|UK", "Henry Bob|not bad|US", "Yo Yo Ma|not so good|CA",
    "Jon York|valued|CA", "Alex Ball|valued|UK", "Jim Davis|not so bad|JA",
]


def lines(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_tagged_lines_join_to_eight_rows(spark):
    joined = join_tagged(lines(spark, LINES))
    got = [(r.code, r.person) for r in joined.collect()]
    assert sorted(got) == [
        ("CA", "Jon Sneed"), ("CA", "Jon York"), ("CA", "Sam Sneed"), ("CA", "Yo Yo Ma"),
        ("UK", "Alex Ball"), ("UK", "Arnold Wesise"), ("US", "Alice Bob"), ("US", "Henry Bob"),
    ]


def test_lines_with_one_field_are_rejected(spark):
    shapes = tagged_lines(lines(spark, [*LINES, "nothing", ""]))
    assert rows(shapes["rejected"]) == [("",), ("nothing",)]
    assert shapes["dimension"].count() == 4 and shapes["fact"].count() == 9


def seasons(spark):
    return spark.createDataFrame(
        [("a", 1, 10), ("a", 2, 20), ("b", 1, 30), (None, 1, 40)], "p string, y int, h int"
    )


def stars(spark):
    return spark.createDataFrame([("a", 1), ("a", 1), ("c", 1), (None, 1)], "p string, y int")


def test_semi_keeps_each_row_once_where_an_inner_join_does_not(spark):
    left, right = seasons(spark), stars(spark)
    assert rows(semi(left, right, ["p", "y"])) == [("a", 1, 10)]
    assert rows(left.join(right, ["p", "y"])) == [("a", 1, 10), ("a", 1, 10)]


def test_anti_keeps_rows_with_a_null_key(spark):
    got = rows(anti(seasons(spark), stars(spark), ["p", "y"]))
    assert got == [(None, 1, 40), ("a", 2, 20), ("b", 1, 30)]


def test_left_join_on_three_keys_of_other_names(spark):
    parks = spark.createDataFrame(
        [("Fenway", "MA", "US", 1), ("Shea", "NY", "US", 2), (None, "NY", "US", 3)],
        "park_name string, state string, country string, n int",
    )
    geo = spark.createDataFrame(
        [("Fenway", "MA", "US", 42.3), ("Fenway", "MA", "US", 42.4), ("Shea", "NJ", "US", 1.0)],
        "name string, admin1 string, country_code string, lat double",
    )
    keys = {"park_name": "name", "state": "admin1", "country": "country_code"}
    got = join_on(parks, geo, keys, "left")
    assert got.columns == ["park_name", "state", "country", "n", "lat"]
    assert sorted((r.n, r.lat) for r in got.collect() if r.lat) == [(1, 42.3), (1, 42.4)]
    assert rows(coverage(got, F.col("lat").isNotNull(), "with_lat", "without_lat")) == [
        ("total", 4), ("with_lat", 2), ("without_lat", 2),
    ]


def test_fanout_equals_the_size_of_the_join(spark):
    draw = random.Random(5)
    left = spark.createDataFrame([(0 if i % 3 == 0 else draw.choice([None, 1, 2, 3]), i) for i in range(90)], "k int, a int")
    right = spark.createDataFrame([(0 if i % 3 == 0 else draw.choice([None, 2, 9]), i) for i in range(60)], "k int, b int")
    got = {r.label: int(r.total) for r in fanout(left, right, ["k"], ("l", "r", "j")).collect()}
    assert got == {"l": 90, "r": 60, "j": left.join(right, "k").count()}
    none = left.filter("k = 77")
    empty = {r.label: int(r.total) for r in fanout(none, none, ["k"], ("l", "r", "j")).collect()}
    assert empty == {"l": 0, "r": 0, "j": 0}


def test_pair_counts_equal_a_self_join(spark):
    draw = random.Random(6)
    data = [("hot" if i % 3 == 0 else draw.choice(["x", "y", None]), draw.choice([None, *range(9)])) for i in range(200)]
    df = spark.createDataFrame(data, "g string, m int")
    a, b = df.alias("a"), df.alias("b")
    brute = a.join(b, F.col("a.g") == F.col("b.g")).filter("a.m != b.m").groupBy("a.g").count()
    assert [(g, int(n)) for g, n in rows(pair_counts(df, ["g"], "m"))] == rows(brute)


def test_partners_of_a_chosen_member(spark):
    df = spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "c"), ("u", "a"), ("u", "a"), (None, "a")], "g string, m string")
    assert rows(partners(df, ["g"], "m", F.col("m") == "a")) == [("a", "b"), ("a", "c")]


def key_sets(spark):
    a = spark.createDataFrame([(v,) for v in ["x", "x", "y", "z", None]], "k string")
    b = spark.createDataFrame([(v,) for v in ["z", "w", "w", "x"]], "k string")
    return a, b


def test_set_operations_of_tables(spark):
    a, b = key_sets(spark)
    assert rows(sets.union(a, b)) == [(None,), ("w",), ("x",), ("y",), ("z",)]
    assert rows(sets.intersect(a, b)) == [("x",), ("z",)]
    assert rows(sets.minus(a, b)) == [(None,), ("y",)]
    assert rows(sets.minus(b, a)) == [("w",)]
    assert rows(sets.xor(a, b)) == [(None,), ("w",), ("y",)]
    both = rows(sets.union_all(sets.intersect(a, b), sets.minus(a, b)))
    assert both == rows(a.distinct())


def test_set_operations_agree_with_sql(spark):
    a, b = key_sets(spark)
    assert rows(sets.intersect(a, b)) == rows(a.intersect(b))
    assert rows(sets.minus(a, b)) == rows(a.subtract(b))


def test_set_equality_of_equal_different_and_empty_sets(spark):
    a, b = key_sets(spark)
    none = a.filter("k = 'none'")
    for left, right, want in [(a, a, 1), (a, b, 0), (none, none, 1), (a, none, 0)]:
        assert rows(sets.equal(left, right)) == [(want,)]


def test_cogroup_keeps_null_keys_apart_and_counts_both_sides(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), (None, 3)], "k string, v int")
    b = spark.createDataFrame([("x", 10.0), ("y", 20.0), (None, 30.0)], "j string, w double")
    got = sets.cogroup(
        a, b, {"k": (F.col("k"), F.col("j"))}, {"v": F.col("v")}, {"w": F.col("w")},
        [F.count_if("from_a").alias("na"), F.count_if("from_b").alias("nb"), F.sum("v").alias("v"), F.max("w").alias("w")],
    )
    assert rows(got) == [
        (None, 0, 1, None, 30.0), (None, 1, 0, 3, None), ("x", 2, 1, 3, 10.0), ("y", 0, 1, None, 20.0),
    ]
    assert got.schema["v"].dataType.simpleString() == "bigint"


def test_cogroup_on_a_shifted_key(spark):
    a = spark.createDataFrame([("t", 1), ("t", 2), ("t", 2)], "t string, y int")
    got = sets.cogroup(
        a, a, {"t": (F.col("t"), F.col("t")), "y": (F.col("y"), F.col("y") - 1)}, {}, {},
        [F.count_if("from_a").alias("now"), F.count_if("from_b").alias("next")],
    )
    assert rows(got) == [("t", 0, 0, 1), ("t", 1, 1, 2), ("t", 2, 2, 0)]
