from __future__ import annotations

import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from relata.functions.dates import date_of, date_of_text, instant, whole_days
from relata.functions.scalars import (
    key_digest,
    ratio,
    round_half_up,
    shorten,
    substring_range,
    whole_ratio,
)
from relata.functions.words import pig_latin, tokens
from relata.operators.delays import bad_lines, delay_histogram
from relata.operators.ranking import holder_of_max, nest_top, shuffle_rows, top, top_per_group
from relata.operators.rows import (
    column_range,
    hash_sample,
    prefix_sample,
    random_sample,
    split,
    split_tagged,
    where_matches,
)
from tests.conftest import rows


def ages(spark):
    return spark.createDataFrame([(29,), (30,), (31,), (39,), (40,), (None,)], "age int")


def conditions():
    age = F.col("age")
    return {"young": age <= 30, "middle": (age >= 30) & (age < 40)}


def test_split_may_overlap_and_drops_unknown(spark):
    parts = split(ages(spark), conditions(), "old")
    assert {n: [r[0] for r in rows(p)] for n, p in parts.items()} == {
        "young": [29, 30], "middle": [30, 31, 39], "old": [40],
    }


def test_one_pass_split_gives_the_same_parts(spark):
    parts = split(ages(spark), conditions(), "old")
    tagged = split_tagged(ages(spark), conditions(), "old")
    for name, part in parts.items():
        assert rows(tagged.filter(F.col("bucket") == name).select("age")) == rows(part)
    assert tagged.count() == sum(p.count() for p in parts.values())


def test_column_ranges(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int")
    assert column_range(df) == ["a", "b", "c", "d"]
    assert column_range(df, "b") == ["b", "c", "d"]
    assert column_range(df, 2) == ["c", "d"]
    assert column_range(df, "b", "c") == ["b", "c"]
    assert column_range(df, None, 1) == ["a", "b"]


def test_pattern_has_to_match_the_whole_text(spark):
    names = ["Russ", "Russell", "phillip", "Rus", "Cal Ripken", "joe", "O'Dea", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in rows(where_matches(df, "n", "(?i)(rus+(el+)?|ph.*p)"))] == [
        "Rus", "Russ", "Russell", "phillip",
    ]
    assert [r[0] for r in rows(where_matches(df, "n", "russ|Rus"))] == ["Rus"]
    assert [r[0] for r in rows(where_matches(df, "n", r"[a-z]+|.+'.+"))] == ["O'Dea", "joe", "phillip"]
    lines = spark.createDataFrame([("abc",), ("abc\n",), ("a\nc",)], "n string")
    assert [r[0] for r in rows(where_matches(lines, "n", "a.c"))] == ["abc"]
    assert [r[0] for r in rows(where_matches(lines, "n", "abc\\n"))] == ["abc\n"]


def test_samples_are_reproducible_parts_of_the_table(spark):
    df = spark.range(2000).withColumn("name", F.concat(F.lit("p"), F.col("id").cast("string")))
    sample = hash_sample(df, "name")
    assert sample.columns == ["keep_hash", "id", "name"]
    kept = rows(sample.select("name"))
    assert kept == rows(hash_sample(df.repartition(3), "name").select("name"))
    assert 60 < len(kept) < 200
    digits = [hash_sample(df, "name", d).count() for d in "0123456789abcdef"]
    assert sum(digits) == 2000
    assert rows(prefix_sample(df, "name", "p19")) == rows(df.filter("name LIKE 'p19%'"))
    some = random_sample(df, 0.1, seed=3)
    assert 100 < some.count() < 320 and some.exceptAll(df).count() == 0


def test_top_rows_with_ties(spark):
    df = spark.createDataFrame(
        [("a", 5, "x"), ("a", 5, "w"), ("a", 9, "y"), ("a", 1, "z"), ("b", 2, "q"), ("b", None, "r")],
        "g string, v int, id string",
    )
    order = [F.col("v").desc_nulls_last(), F.col("id")]
    assert [r.id for r in top(df, 2, order).collect()] == ["y", "w"]
    assert rows(top_per_group(df, ["g"], 2, order).select("g", "place", "id")) == [
        ("a", 1, "y"), ("a", 2, "w"), ("b", 1, "q"), ("b", 2, "r"),
    ]
    best = nest_top(df, ["g"], 2, order, ["id", "v"], "top").filter("g = 'a'").first().top
    assert [r.id for r in best] == ["y", "w"]
    last = nest_top(df, ["g"], 2, order, ["id"], "top", ascending=True).filter("g = 'a'").first().top
    assert [r.id for r in last] == ["w", "y"]


def test_holder_of_the_largest_metric(spark):
    df = spark.createDataFrame(
        [("p", 1, "B", 7), ("p", 1, "A", 7), ("p", 1, "C", None), ("p", 2, "D", None), ("q", 1, "A", 3), ("q", 1, "A", 4)],
        "p string, y int, t string, m int",
    )
    got = holder_of_max(df, ["p", "y"], "m", "t")
    assert rows(got.select("p", "y", "stints", "m", "t")) == [
        ("p", 1, 3, 7, "A"), ("p", 2, 1, None, "D"), ("q", 1, 2, 4, "A"),
    ]


def test_shuffle_is_a_permutation_that_depends_on_the_seed(spark):
    df = spark.range(50)

    def order(seed):
        return [r.id for r in shuffle_rows(df.repartition(3), ["id"], seed).orderBy("row_no").collect()]

    assert sorted(order("a")) == list(range(50))
    assert order("a") == order("a") != list(range(50))
    assert order("a") != order("b")


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'int'}" for n, v in zip(names, values)))
    return df.select(column(*map(F.col, names))).first()[0]


def test_substring_is_null_beyond_the_text(spark):
    assert one(spark, lambda c: substring_range(c, 5, 7), "2010-06-25") == "06"
    assert one(spark, lambda c: substring_range(c, 2, 9), "abcd") == "cd"
    assert one(spark, lambda c: substring_range(c, 5, 7), "abc") is None


def test_division_by_zero_is_null(spark):
    assert one(spark, ratio, 1, 0) is None
    assert one(spark, whole_ratio, 1, 0) is None
    assert one(spark, whole_ratio, -7, 2) == -3
    assert one(spark, ratio, 1, 4) == 0.25


def test_rounding_halves_goes_up(spark):
    assert [one(spark, round_half_up, v) for v in (-2.5, -0.5, 0.5, 2.5, 2.4)] == [-2, 0, 1, 3, 2]


def test_shorten(spark):
    assert one(spark, lambda c: shorten(c), "exactly fifteen") == "exactly fifteen"
    assert one(spark, lambda c: shorten(c), "sixteen letters!") == "sixteen letters…"


def test_digest_depends_on_the_seed_and_is_null_for_null(spark):
    assert one(spark, lambda c: key_digest(c), "a") == "0cc175b9c0f1b6a831c399e269772661"
    assert one(spark, lambda c: key_digest(c, seed="s"), "a") != one(spark, lambda c: key_digest(c), "a")
    assert one(spark, lambda c: key_digest(c), None) is None


def test_dates_from_parts_and_text(spark):
    assert one(spark, date_of, 2001, 2, 3) == datetime.date(2001, 2, 3)
    assert one(spark, date_of, 2001, 2, 30) is None
    assert one(spark, date_of, 2001, 0, 5) is None
    assert one(spark, lambda y: date_of(y, F.lit(None).cast("int")), 1999) == datetime.date(1999, 1, 1)
    assert one(spark, lambda y: date_of(y.cast("int")), None) is None
    assert one(spark, lambda c: date_of_text(c), "2012-06-07") == datetime.date(2012, 6, 7)
    assert one(spark, lambda c: date_of_text(c), "2012-6-") is None


def test_instants_in_any_zone(spark):
    def second(text):
        return one(spark, lambda c: F.unix_seconds(instant(c)), text)

    assert second("1970-01-02") == 86400
    for text in ("1970-01-01T00:01:00Z", "1970-01-01T00:01:00", "1970-01-01 00:01:00", "1970-01-01T02:01:00+02:00", "1970-01-01T00:01:00.000Z"):
        assert second(text) == 60
    for text in ("soon", "", "12:30", "T12:30:00Z", "12:30:00Z", "2000-13-01"):
        assert second(text) is None


def test_whole_days_are_floored(spark):
    def days(a, b):
        return one(spark, lambda x, y: whole_days(instant(x), instant(y)), a, b)

    assert days("2000-01-01T23:00:00Z", "2000-01-02T01:00:00Z") == 0
    assert days("2000-01-01", "2000-01-03T12:00:00Z") == 2
    assert days("2000-01-02", "2000-01-01T23:00:00Z") == -1


def test_delay_histogram_and_its_bad_lines(spark):
    lines = [
        "2000-01-01T00:00:00Z\t2000-01-04T01:00:00Z\tSt. Louis, MO",
        "2000-01-01\t2000-01-04\tx\ty",
        "2000-01-02T00:00:00Z\t2000-01-01T23:00:00Z\tback in time",
        "2000-01-01\t2000-01-04",
        "0000\t2000-01-04\tno date",
        "",
    ]
    df = spark.createDataFrame([(v,) for v in lines], "value string")
    assert rows(delay_histogram(df)) == [(-1, 1), (3, 2)]
    assert [r[0] for r in rows(bad_lines(df))] == sorted(lines[3:])


def test_words_between_blanks(spark):
    assert one(spark, lambda c: tokens(c), "  a b\tc\n\nd'e  ") == ["a", "b", "c", "d'e"]
    assert one(spark, lambda c: tokens(c), "") == []


def test_pig_latin(spark):
    text = "Hello rhythm, shh apple -- don't 'Yes' 42"
    assert one(spark, pig_latin, text) == "Helloway ythmrhay hshay appleway on'tday Yes'way 42way"
    assert one(spark, pig_latin, "... !") == ""


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="abchrstAEZ' _9.é\n", max_size=40))
def test_pig_latin_agrees_with_a_plain_scan(spark, text):
    assert one(spark, pig_latin, text) == plain_pig_latin(text)


def plain_pig_latin(text):
    """Scan letter by letter: an independent statement of the rule."""
    word = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
    out, at = [], 0
    while at < len(text):
        if text[at] not in word:
            at += 1
            continue
        end = at
        while end < len(text) and (text[end] in word or text[end] == "'"):
            end += 1
        piece = text[at:end]
        moved = 0
        while moved < len(piece) - 1 and piece[moved] in "bcdfghjklmnpqrstvwxz":
            moved += 1
        turned = piece[moved:] + (piece[:moved] or "w") + "ay"
        small = turned.lower()
        out.append(small[0].upper() + small[1:] if "A" <= turned[0] <= "Z" else small)
        at = end
    return " ".join(out)
