from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from relata.operators import histograms as hist
from relata.operators.aggregate import (
    cardinality,
    first_of_unique,
    never,
    share_in_group,
    sums_by_subset,
    with_share,
)
from relata.operators.summaries import (
    EDGES,
    FULL_EDGES,
    describe_numeric,
    describe_numeric_sketched,
    describe_text,
    quantiles,
    quantiles_approx,
)
from tests.conftest import rows


def values(n=700, seed=9):
    draw = random.Random(seed)
    return [
        ("hot" if i % 3 == 0 else draw.choice(["a", "b"]), draw.choice([None, *range(-30, 60)]))
        for i in range(n)
    ]


def nearest_rank(numbers, share):
    ordered = sorted(numbers)
    return ordered[max(0, math.ceil(round(share * len(ordered), 9)) - 1)]


@pytest.mark.parametrize("edges", [EDGES, FULL_EDGES])
def test_quantiles_per_group(spark, edges):
    data = values()
    df = spark.createDataFrame(data, "g string, v int").repartition(6)
    for row in quantiles(df, F.col("v"), ["g"], edges).collect():
        known = [v for g, v in data if g == row.g and v is not None]
        assert [row[n] for n in edges] == [nearest_rank(known, p) for p in edges.values()]


def test_sketch_is_within_its_rank_error(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("v"))
    accuracy = 500
    row = quantiles_approx(df, F.col("v"), accuracy=accuracy).first()
    for name, share in EDGES.items():
        assert abs(row[name] - share * 20_000) <= 20_000 / accuracy + 1


def test_numeric_summary_against_the_values(spark):
    data = values()
    df = spark.createDataFrame(data, "g string, v int").repartition(6)
    for row in describe_numeric(df, F.col("v"), ["g"]).collect():
        group = [v for g, v in data if g == row.g]
        known = [v for v in group if v is not None]
        assert (row.n_recs, row.n_nulls) == (len(group), len(group) - len(known))
        assert row.cardinality == len(set(group))
        assert (row.min_val, row.max_val, row.sum_val) == (min(known), max(known), sum(known))
        assert row.avg_val == pytest.approx(statistics.fmean(known))
        assert row.stddev_val == pytest.approx(statistics.pstdev(known))
        assert row.some_vals == "^".join(map(str, sorted(set(known))[:5]))


def test_sketched_summary_is_close_to_the_exact_one(spark):
    df = spark.createDataFrame(values(), "g string, v int")
    exact = {r.g: r for r in describe_numeric(df, F.col("v"), ["g"]).collect()}
    for row in describe_numeric_sketched(df, F.col("v"), ["g"]).collect():
        want = exact[row.g]
        for name in ("min_val", "max_val", "n_recs", "n_nulls", "sum_val", *EDGES):
            assert row[name] == want[name], name
        assert row.avg_val == pytest.approx(want.avg_val)
        assert row.stddev_val == pytest.approx(want.stddev_val)
        assert abs(row.cardinality - want.cardinality) <= 0.15 * want.cardinality


def test_sample_deviation_and_fields_without_values(spark):
    df = spark.createDataFrame([(1,), (3,), (None,)], "v int")
    row = describe_numeric(df, F.col("v"), population=False).first()
    assert row.stddev_val == pytest.approx(statistics.stdev([1, 3]))
    blank = describe_numeric(df.filter("v IS NULL"), F.col("v")).first()
    assert (blank.n_recs, blank.n_nulls, blank.cardinality) == (1, 1, 1)
    assert (blank.avg_val, blank.stddev_val, blank.p50, blank.some_vals) == (None, None, None, "")


def test_text_summary(spark):
    names = ["Bob", "Al", None, "Al", "A name of many letters", ""]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    row = describe_text(df, "name").first()
    lengths = [len(n) for n in names if n is not None]
    assert (row["var"], row.minlen, row.maxlen, row.sumlen) == ("name", 0, 22, sum(lengths))
    assert row.avglen == pytest.approx(statistics.fmean(lengths))
    assert row.stdvlen == pytest.approx(statistics.pstdev(lengths))
    assert (row.n_recs, row.n_nulls, row.cardinality) == (6, 1, 5)
    assert (row.minval, row.maxval) == ("", "Bob")
    assert row.examples == "^A name of many …^Al^Bob"


def test_text_summary_per_group(spark):
    df = spark.createDataFrame([("x", "aa"), ("x", "b"), ("y", None)], "g string, name string")
    got = {r.g: r for r in describe_text(df, "name", ["g"]).collect()}
    assert (got["x"].minval, got["x"].p50, got["x"].examples) == ("aa", 1, "aa^b")
    assert (got["y"].n_nulls, got["y"].minlen, got["y"].examples) == (1, None, "")


def test_bins_of_negative_and_half_values(spark):
    df = spark.createDataFrame([(-2.5,), (-0.5,), (0.0,), (0.5,), (2.5,), (7.0,)], "x double")
    got = df.select(
        hist.floor_bin(F.col("x"), 5).alias("f"),
        hist.round_bin(F.col("x"), 5).alias("r"),
        hist.ceil_bin(F.col("x"), 5).alias("c"),
    ).collect()
    assert [r.f for r in got] == [-5, -5, 0, 0, 0, 5]
    assert [r.r for r in got] == [0, 0, 0, 0, 5, 5]
    assert [r.c for r in got] == [0, 0, 0, 5, 5, 10]


def test_log_bins(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (100,), (None,)], "x bigint")
    got = [r[0] for r in df.select(hist.log_bin(F.col("x"))).collect()]
    want = [math.floor(math.exp(math.floor(math.log(x or 0.001) * 10) / 10.0)) for x in (0, 1, 2, 100)]
    assert got == [*want, None]


def test_filled_histogram_keeps_values_beyond_the_bins(spark):
    df = spark.createDataFrame([(1,), (1,), (12,), (99,), (-3,), (None,)], "x int")
    got = rows(hist.fill_to(df, F.col("x"), 5, 15))
    assert got == [(None, 1), (-5, 1), (0, 2), (5, 0), (10, 1), (15, 0), (95, 1)]


def test_gaps_are_filled_up_to_the_largest_bin(spark):
    df = spark.createDataFrame([(100,), (400,), (400,), (None,)], "bin bigint")
    assert rows(hist.fill_gaps(df, F.col("bin"), 100)) == [(0, 0), (100, 1), (200, 0), (300, 0), (400, 2)]
    low = spark.createDataFrame([(-200,)], "bin bigint")
    assert rows(hist.fill_gaps(low, F.col("bin"), 100)) == [(-200, 1), (-100, 0), (0, 0)]
    assert rows(hist.fill_gaps(df.filter("bin = 5"), F.col("bin"), 100)) == []


def test_examples_of_each_bin(spark):
    df = spark.createDataFrame([(1, i) for i in range(9)] + [(2, 5)], "bin int, id int")
    got = hist.with_examples(df, "bin", F.col("id").cast("string"), [F.col("id")], 3)
    assert rows(got.select("bin", "ct", "examples")) == [(1, 9, "0|1|2"), (2, 1, "5")]


def test_shares_of_all_and_of_each_group(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, 1)], "g string, v int")
    assert rows(with_share(hist.histogram(df, "v"))) == [(1, 3, 0.75), (2, 1, 0.25)]
    got = rows(share_in_group(df, ["g"], "v"))
    assert got == [(None, 1, 1, 1.0), ("a", 1, 2, 2 / 3), ("a", 2, 1, 1 / 3)]


def test_readable_line_per_group(spark):
    df = spark.createDataFrame([("a", 10, 0.25), ("a", 5, 0.75), ("b", 1, 1.0)], "g string, bin int, f double")
    text = F.format_string("%3d: %4.0f", F.col("bin"), 100 * F.col("f"))
    got = hist.as_lines(df, "g", "bin", text, 100)
    assert rows(got.select("g", "line")) == [("a", "  5:   75   10:   25"), ("b", "  1:  100")]


def test_sums_over_overlapping_subsets(spark):
    df = spark.createDataFrame([(20, 1), (30, 2), (None, 4)], "age int, n int")
    sums = sums_by_subset(
        {"all": F.lit(True), "low": F.col("age") <= 30, "high": F.col("age") >= 30}, {"n": F.col("n")}
    )
    assert df.agg(*sums).first().asDict() == {"n_all": 7, "n_low": 3, "n_high": 2}


def test_never_counts_an_unknown_condition_as_not_met(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", None), ("c", "y")], "p string, t string")
    assert rows(never(df, "p", F.col("t") == "x")) == [("b",), ("c",)]


def test_distinct_values_with_null_as_one(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), ("a", None), ("b", 2)], "g string, v int")
    assert rows(cardinality(df, ["g"], "v", "n")) == [("a", 2), ("b", 1)]


def test_names_that_occur_once(spark):
    people = [
        ("Kristopher", "Negron"), ("John", "Smith"), ("John", "Walker"), ("Phenomenal", "Smith"), (None, "X"), (None, "Y"),
    ]
    df = spark.createDataFrame(people, "name_first string, name_last string")
    got = first_of_unique(df, F.col("name_first"), "first", ["name_last"])
    assert rows(got) == [("Kristopher", "Negron"), ("Phenomenal", "Smith")]


def test_large_numbers_dates_and_texts(spark):
    big = 9_000_000_000_000_000_000
    df = spark.createDataFrame(
        [(big, "2001-02-03", "b"), (big, "2001-02-04", "a"), (big - 1, None, "c")],
        "n bigint, d string, t string",
    ).withColumn("d", F.col("d").cast("date"))
    edges = {"low": 0.01, "half": 0.5, "high": 0.99}
    assert tuple(quantiles(df, F.col("n"), (), edges).first()) == (big - 1, big, big)
    assert [str(v) for v in quantiles(df, F.col("d"), (), edges).first()] == [
        "2001-02-03", "2001-02-03", "2001-02-04",
    ]
    assert tuple(quantiles(df, F.col("t"), (), edges).first()) == ("a", "b", "c")
    assert describe_numeric(df, F.col("n")).first().sum_val == 3 * big - 1
