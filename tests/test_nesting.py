from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from relata.functions.scalars import first_or, set_operations
from relata.operators.nesting import bag_text, bags, delimited, set_change_counts, set_changes, unnest
from tests.conftest import rows


def member_rows(n=600, seed=3):
    """One group holds a third of the rows, half of them equal; one group is null."""
    draw = random.Random(seed)
    data = []
    for i in range(n):
        if i % 3 == 0:
            data.append(("hot", 5 if i % 2 else draw.randrange(20), "same" if i % 2 else f"m{i}"))
        else:
            group = draw.choice(["a", "b", "c", None])
            data.append((group, draw.choice([None, *range(5)]), f"m{i}"))
    return data


def expected_parts(data, size):
    groups = defaultdict(list)
    for g, o, m in data:
        groups[g].append((o, m))
    out = {}
    for g, members in groups.items():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        for start in range(0, len(members), size):
            out[(g, start // size)] = (len(members), [m for _, m in members[start : start + size]])
    return out


@pytest.mark.parametrize("size", [1, 7, 64, 100, 100_000])
def test_parts_put_together_give_the_whole_group(spark, size):
    data = member_rows()
    df = spark.createDataFrame(data, "g string, o int, m string").repartition(8)
    nested = bags(df, ["g"], ["m"], ["o"], part_size=size)
    got = {(r.g, r.part): (r.n_members, [x.m for x in r.bag]) for r in nested.collect()}
    assert got == expected_parts(data, size)


def test_no_part_exceeds_the_limit_and_unnesting_restores_the_rows(spark):
    data = member_rows()
    df = spark.createDataFrame(data, "g string, o int, m string")
    nested = bags(df, ["g"], ["o", "m"], ["m"], part_size=10)
    assert nested.agg(F.max(F.size("bag"))).first()[0] <= 10
    assert rows(unnest(nested, "bag").select("g", "o", "m")) == rows(df)


@pytest.mark.parametrize("size", [9, 100_000])
def test_totals_cover_the_whole_group(spark, size):
    data = member_rows()
    df = spark.createDataFrame(data, "g string, o int, m string")
    got = bags(df, ["g"], ["m"], ["m"], part_size=size, totals={"top": F.max("o"), "n": F.count("*")})
    for row in got.collect():
        group = [r for r in data if r[0] == row.g]
        assert (row.n, row.n_members) == (len(group), len(group))
        assert row.top == max(o for _, o, _ in group if o is not None)


def test_small_and_large_groups_take_the_same_way(spark):
    df = spark.range(300_003).select(
        F.when(F.col("id") < 3, "few").otherwise("many").alias("g"), F.col("id").alias("m")
    )
    nested = bags(df, ["g"], ["m"], ["m"], part_size=50_000)
    got = {(r.g, r.part): tuple(r)[2:] for r in nested.select(
        "g", "part", "n_members", F.size("bag"), F.col("bag")[0].m, F.element_at("bag", -1).m
    ).collect()}
    assert got.pop(("few", 0)) == (3, 3, 0, 2)
    assert got == {
        ("many", k): (300_000, 50_000, 3 + 50_000 * k, 50_002 + 50_000 * k) for k in range(6)
    }


def test_schema_of_a_bag(spark):
    df = spark.createDataFrame([("t", "p", 1)], "team_id string, park_id string, year_id bigint")
    nested = bags(df, ["team_id"], ["park_id", "year_id"], ["year_id"], part_size=10)
    assert nested.schema.simpleString() == (
        "struct<team_id:string,part:bigint,n_members:bigint,bag:array<struct<park_id:string,year_id:bigint>>>"
    )


def test_text_keeps_the_given_order(spark):
    df = spark.createDataFrame(
        [("t", "A", 3), ("t", "B", 9), ("t", "C", 3), ("u", "D", 1)], "team string, park string, n int"
    )
    pair = F.concat("park", F.lit(":"), F.col("n").cast("string"))
    got = bag_text(df, ["team"], pair, [-F.col("n"), F.col("park")], "|", part_size=10, name="txt")
    assert rows(got.select("team", "txt")) == [("t", "B:9|A:3|C:3"), ("u", "D:1")]
    cut = bag_text(df, ["team"], pair, [-F.col("n"), F.col("park")], "|", part_size=2, name="txt")
    assert rows(cut.filter("team = 't'").select("part", "txt")) == [(0, "B:9|A:3"), (1, "C:3")]


def test_sequence_of_one_team_per_year(spark):
    seasons = [
        ("zupcibo01", "BOS", 1991), ("zupcibo01", "BOS", 1992), ("zupcibo01", "BOS", 1993),
        ("zupcibo01", "CHA", 1994), ("zuverge01", "BAL", 1955), ("zuverge01", "DET", 1954),
        ("zuverge01", "BAL", 1956),
    ]
    df = spark.createDataFrame(seasons, "player string, team string, year int")
    first = df.groupBy("player", "year").agg(F.min("team").alias("team"))
    got = bag_text(first, ["player"], F.concat_ws("|", "team", "year"), [F.col("year")], "|", part_size=10, name="seq")
    assert rows(got.select("player", "seq")) == [
        ("zupcibo01", "BOS|1991|BOS|1992|BOS|1993|CHA|1994"),
        ("zuverge01", "DET|1954|BAL|1955|BAL|1956"),
    ]


def test_members_with_nulls_as_flat_text(spark):
    df = spark.createDataFrame(
        [([("a", 1), (None, 2), ("c", None)],)], "bag array<struct<x:string,y:int>>"
    )
    assert df.select(delimited("bag", "|", "x", "y")).first()[0] == "a|1||2|c|"


def test_unnest_of_an_empty_bag(spark):
    df = spark.createDataFrame([(1, []), (2, [(5,)])], "k int, bag array<struct<x:int>>")
    assert rows(unnest(df, "bag")) == [(2, 5)]
    assert rows(unnest(df, "bag", keep_empty=True)) == [(1, None), (2, 5)]


def test_sets_of_consecutive_steps(spark):
    data = [("t", 1, "a"), ("t", 1, "b"), ("t", 1, "b"), ("t", 2, "b"), ("t", 2, "c"), ("t", 3, "b"), ("t", 3, "c")]
    df = spark.createDataFrame(data, "team string, year int, p string")
    members = set_changes(df, ["team"], "p", "year")
    assert members.schema["year"].dataType.simpleString() == "int"
    counts = set_change_counts(members, ["team", "year"])
    got = {r.year: r for r in counts.collect()}
    assert (got[1].n_first, got[1].n_second, got[1].n_either, got[1].n_stayed) == (2, 2, 3, 1)
    assert (got[1].n_departed, got[1].n_arrived, got[1].n_changed, got[1].is_equal) == (1, 1, 2, 0)
    assert got[2].is_equal == 1
    assert (got[0].n_first, got[3].n_second) == (0, 0)


def test_set_operations_in_a_row(spark):
    cases = [(["b", "a", "a", None], ["b", "c"]), ([], []), (["x"], ["x", "x"]), (["x"], ["y"])]
    df = spark.createDataFrame(cases, "a array<string>, b array<string>")
    ops = set_operations(F.col("a"), F.col("b"))
    got = df.select(*[c.alias(n) for n, c in ops.items()]).collect()
    for (a, b), row in zip(cases, got):
        sa, sb = set(a), set(b)
        assert set(row.either) == sa | sb and len(row.either) == len(sa | sb)
        assert set(row.stayed) == sa & sb
        assert set(row.departed) == sa - sb and set(row.arrived) == sb - sa
        assert set(row.changed) == sa ^ sb and row.is_equal == int(sa == sb)


def test_first_member_or_default(spark):
    df = spark.createDataFrame([([3, 1, 2],), ([],), (None,)], "a array<int>")
    assert [r[0] for r in df.select(first_or(F.col("a"), F.lit(-1))).collect()] == [1, -1, -1]
