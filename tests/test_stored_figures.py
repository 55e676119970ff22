"""Bags as text, sketches and bitmaps that merge, equality by digests."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from relata.operators import sets, sketches
from relata.operators.delays import bad_lines, delay_histogram
from relata.operators.summaries import describe_numeric_sketched
from relata.session import fresh_path
from relata.sources.bagtext import accepted, bags_to_lines, lines_to_bags, rejects
from tests.conftest import rows

BAG = "k string, n int, bag array<struct<y:int,name:string,w:double>>"


def test_bags_come_back_whatever_their_fields_hold(spark):
    odd = ["", "a,b", "(x)", "{y}", "\\N", "\\", "\\2C", "tab\there", "line\nbreak\r", "),(", "é𝄞", None, "N", "\\5C2C"]
    data = [(f"k{i}", i, [(i, v, 0.5 * i), (None, v, None)]) for i, v in enumerate(odd)]
    data += [("empty", 1, []), (None, None, None), ("\\N", 2, [(1, "z", -1e300)]), ("t\tab", 3, [(1, None, 1.0)])]
    frame = spark.createDataFrame(data, BAG)
    lines = bags_to_lines(frame)
    assert lines.where("contains(value, '\n')").count() == 0
    read = lines_to_bags(lines, BAG)
    assert rejects(read).count() == 0
    assert sorted(map(str, accepted(read).collect())) == sorted(map(str, frame.collect()))


def test_a_null_member_becomes_a_tuple_of_nulls(spark):
    frame = spark.sql("SELECT 'k' AS k, 1 AS n, array(null, named_struct('y', 1, 'name', 'a', 'w', 2.0D)) AS bag")
    read = accepted(lines_to_bags(bags_to_lines(frame), BAG)).first()
    assert [tuple(m) for m in read.bag] == [(None, None, None), (1, "a", 2.0)]


@pytest.mark.parametrize(
    "text",
    ["{(1,a,2.0)", "(1,a,2.0)", "{(1,a)}", "{(1,a,2.0),}", "{(1,a,2.0)(2,b,3.0)}", "{(1,(a),2.0)}", "", "{",
     "{()}", "{(1,a,2.0),(2)}", "{(1,\\x,2.0)}", "{(1,a\\,2.0)}", "{}x", "{(1,a,2.0)}\textra", "{(1,a,\\NN)}"],
)
def test_malformed_bags_are_rejected_whole(spark, text):
    line = f"k\t1\t{text}"
    read = lines_to_bags(spark.createDataFrame([(line,), ("k\t1\t{}",)], "value string"), BAG)
    assert rows(rejects(read)) == [(line,)] and accepted(read).count() == 1


def test_plain_text_of_other_writers_is_read_and_odd_types_are_null(spark):
    lines = spark.createDataFrame([("BOS\tx\t{(1871,a b,1),(x,c,-2.5)}",), (None,), ("BOS",)], "value string")
    read = lines_to_bags(lines, BAG)
    assert [tuple(m) for m in accepted(read, ["bag"]).where("bag IS NOT NULL").first().bag] == [
        (1871, "a b", 1.0), (None, "c", -2.5)
    ]
    assert accepted(read).first().n is None and rows(rejects(read)) == [("BOS",)]


def values(spark, n=30_000):
    draw = random.Random(6)
    data = [(draw.choice("ab"), i % 5, draw.gauss(0, 1) if draw.random() > 0.01 else None) for i in range(n)]
    return data, spark.createDataFrame(data, "g string, part int, v double").repartition(6)


def test_merged_quantiles_stay_within_the_rank_error(spark):
    data, frame = values(spark)
    path = fresh_path(spark, "sketches")
    for part in range(5):
        figures = sketches.quantile_sketches(frame.where(f"part = {part}"), ["g", "part"], F.col("v"))
        sketches.add_part(figures, path, "part")
    stored = sketches.read_parts(spark, path, figures)
    edges = {"p01": 0.01, "p50": 0.5, "p99": 0.99}
    for row in sketches.merge_quantiles(stored, ["g"], edges).collect():
        mine = sorted(v for g, _, v in data if g == row.g and v is not None)
        assert row.n == len(mine)
        for name, share in edges.items():
            below = sum(v < row[name] for v in mine) / len(mine)
            upto = sum(v <= row[name] for v in mine) / len(mine)
            assert below - sketches.RANK_ERROR <= share <= upto + sketches.RANK_ERROR


def test_a_part_added_again_replaces_itself_only(spark):
    _, frame = values(spark, 500)
    path = fresh_path(spark, "sketches")
    for part in (0, 1, 1):
        figures = sketches.quantile_sketches(frame.where(f"part = {part}"), ["g", "part"], F.col("v"))
        sketches.add_part(figures, path, "part")
    merged = sketches.merge_quantiles(sketches.read_parts(spark, path, figures), [], {"p50": 0.5})
    assert merged.first().n == frame.where("part < 2 AND v IS NOT NULL").count()


def test_bitmaps_count_exactly_at_two_levels(spark):
    draw = random.Random(7)
    data = [(draw.choice("ab"), draw.randrange(3), draw.choice([None, -5, 0, 32767, 32768, 2**40, draw.randrange(90_000)]))
            for _ in range(5000)]
    frame = spark.createDataFrame(data, "g string, y int, m long").repartition(4)
    stored = sketches.distinct_bitmaps(frame, ["g", "y"], "m")
    for by, at in (["g"], 0), (["y"], 1):
        expected = sorted((k, len({m for *_, m in [r for r in data if r[at] == k]})) for k in {r[at] for r in data})
        assert rows(sketches.count_bitmaps(stored, by)) == expected
    assert sketches.count_bitmaps(stored, []).first().n == len({m for *_, m in data})
    assert rows(sketches.count_bitmaps(stored.limit(0), ["g"])) == []


def test_set_sizes_are_near(spark):
    a = spark.range(0, 60_000).select(F.lit("a").alias("g"), "id")
    b = spark.range(40_000, 120_000).select(F.lit("b").alias("g"), "id")
    made = sketches.set_sketches(a.unionByName(b), ["g"], "id").collect()
    both = spark.createDataFrame([(bytes(made[0].sketch), bytes(made[1].sketch), made[0].g)], "x binary, y binary, g string")
    sizes = both.select(*[s.alias(n) for n, s in sketches.set_sizes(F.col("x"), F.col("y")).items()]).first()
    first, second = (40_000, 60_000) if made[0].g == "a" else (60_000, 40_000)
    for found, exact in zip(sizes, (120_000, 20_000, first, second)):
        assert abs(found - exact) <= sketches.SET_ERROR * 120_000


def test_digests_tell_bags_and_sets(spark):
    schema = "a int, b string"
    one = spark.createDataFrame([(1, "x"), (None, "y"), (2, None)], schema)
    turned = spark.createDataFrame([(2, None), (1, "x"), (None, "y")], schema).select("b", "a")
    swapped = spark.createDataFrame([(1, "x"), (2, "y"), (None, None)], schema)
    empty = one.limit(0)

    def same(x, y, as_sets=False):
        return sets.equal_by_digest(x, y, as_sets).first().is_equal

    assert same(one, turned) and same(empty, empty) and same(empty, empty, True)
    assert not same(one, swapped) and not same(one, empty) and not same(empty, one, True)
    assert not same(one, one.unionByName(one)) and same(one, one.unionByName(one), True)
    names = spark.createDataFrame([(None, "z")], "a string, b string"), spark.createDataFrame([("z", None)], "a string, b string")
    assert not same(*names)


def test_a_digest_shuffles_no_row(spark):
    made = sets.equal_by_digest(spark.range(100), spark.range(100))
    text = made._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in text and text.count("partial_count") == 2


def test_sums_of_large_numbers_do_not_overflow(spark):
    frame = spark.createDataFrame([(9 * 10**18,), (9 * 10**18,), (None,)], "v long")
    assert describe_numeric_sketched(frame, F.col("v")).first().sum_val == 18 * 10**18


def test_bad_lines_are_those_without_a_delay(spark):
    data = ["2001-01-01\t2001-01-03\tx", "unknown\t2001-01-03\tx", "2001-01-01", "", None, "2001-01-01\t\tx"]
    lines = spark.createDataFrame([(v,) for v in data], "value string")
    assert rows(bad_lines(lines)) == [(None,), ("",), ("2001-01-01",), ("2001-01-01\t\tx",), ("unknown\t2001-01-03\tx",)]
    assert rows(delay_histogram(lines)) == [(2, 1)]
