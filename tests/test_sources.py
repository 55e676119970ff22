from __future__ import annotations

import bz2
import gzip
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from relata import session
from relata.sources import text
from relata.sources.schemas import DDL, schema
from tests.conftest import rows


def write(path, content):
    path.write_text(content, encoding="utf-8")
    return str(path)


def test_bad_lines_do_not_lose_rows(spark, tmp_path):
    content = 'NYN\t1\tNorth "End\n' "short\n" "long\t3\tx\tsurplus\n" "bad\tseven\ty\n" "\\N\t\\N\t\\N\n" "back\\slash\t4\tN\n"
    path = write(tmp_path / "t.tsv", content)
    got = rows(text.read_separated(spark, path, "a string, n int, b string"))
    assert got == [
        (None, None, None), ("NYN", 1, 'North "End'), ("back\\slash", 4, "N"),
        ("bad", None, "y"), ("long", 3, "x"), ("short", None, None),
    ]


def test_compressed_files_and_patterns(spark, tmp_path):
    with gzip.open(tmp_path / "pagecounts-1.gz", "wt") as out:
        out.write("en Main_Page 5 100\nde Haupt 2 7\n")
    got = text.read_separated(spark, str(tmp_path / "pagecounts-*.gz"), schema("pageviews"), separator=" ")
    assert rows(got) == [("de", "Haupt", 2, 7), ("en", "Main_Page", 5, 100)]
    for i in range(2):
        (tmp_path / f"parts-{i}.tsv.bz2").write_bytes(bz2.compress(f"p{i}\t{i}\n".encode()))
    got = text.read_separated(spark, str(tmp_path / "parts-*.tsv.bz2"), "p string, n int")
    assert rows(got) == [("p0", 0), ("p1", 1)]


def test_separated_round_trip_keeps_nulls_quotes_and_blanks(spark, tmp_path):
    df = spark.createDataFrame(
        [('say "hi"', 1, True), (" lead and trail ", None, False), (None, 3, None), ("N", 4, True), ("#c", 5, True)],
        "s string, n int, b boolean",
    )
    path = str(tmp_path / "out")
    text.write_separated(df, path)
    assert rows(text.read_separated(spark, path, df.schema)) == rows(df)
    with pytest.raises(AnalysisException):
        text.write_separated(df, path)


def test_gzip_files_are_bounded(spark, tmp_path):
    path = tmp_path / "gz"
    text.write_separated(spark.range(100).coalesce(1), str(path), compression="gzip", rows_per_file=30)
    assert len(list(path.glob("*.gz"))) == 4


def test_nested_round_trip_narrows_the_year(spark, tmp_path):
    df = spark.createDataFrame(
        [("BOS", [(1990, "a"), (1991, None)]), ("CHA", [])],
        "team_id string, park_years array<struct<year:bigint,park_id:string>>",
    )
    text.write_table(df, str(tmp_path / "t"))
    stored = text.read_table(spark, str(tmp_path / "t"), DDL["team_park_seasons"])
    assert stored.schema.simpleString() == schema("team_park_seasons").simpleString()
    assert rows(stored.select("team_id", F.col("park_years.year").alias("y"))) == [("BOS", [1990, 1991]), ("CHA", [])]


def test_json_keeps_null_fields(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "mod")], "k int, m string")
    text.write_json(df.coalesce(1), str(tmp_path / "j"))
    written = "".join(p.read_text() for p in (tmp_path / "j").glob("part-*"))
    assert '{"k":1,"m":null}' in written
    assert rows(text.read_json(spark, str(tmp_path / "j"), df.schema)) == rows(df)


def test_lines(spark, tmp_path):
    text.write_lines(spark.createDataFrame([("b c",), ("a",), ("",)], "value string"), str(tmp_path / "l"))
    assert rows(text.read_lines(spark, str(tmp_path / "l"))) == [("",), ("a",), ("b c",)]


def test_partitioned_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "n int, bucket string")
    text.write_table(df, str(tmp_path / "t"), by=["bucket"])
    assert sorted(p.name for p in (tmp_path / "t").glob("bucket=*")) == ["bucket=x", "bucket=y"]
    assert rows(text.read_table(spark, str(tmp_path / "t"))) == rows(df)


def test_every_declared_schema_parses():
    for name in DDL:
        fields = schema(name).fieldNames()
        assert len(fields) == len(set(fields)) >= 2
    assert len(schema("events")) == 31 and len(schema("people")) == 25
    assert schema("bat_careers")["HR"].dataType.simpleString() == "bigint"
    assert schema("bat_seasons")["HR"].dataType.simpleString() == "int"


def test_stored_steps_go_to_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert session.shared_folder(spark) == folder
    assert session.fresh_path(spark, "x").startswith(folder)
    stored = session.settle(spark.range(5), "unit")
    assert rows(stored) == [(i,) for i in range(5)]
    assert stored.inputFiles()[0].removeprefix("file://").startswith(folder)
    assert list(Path(folder).glob("relata-*/unit-*"))
