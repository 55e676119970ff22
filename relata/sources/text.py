"""Text sources and sinks: separated fields, lines, nested records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from relata.session import fresh_path

NULL_MARK = "\\N"  # fixed value: how a null is written in separated text


def read_separated(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: StructType | str,
    separator: str = "\t",
    null_mark: str = NULL_MARK,
) -> DataFrame:
    """Fields by position. ``path`` may be a pattern; ``.gz`` and ``.bz2`` files are unpacked.

    A short line ends in nulls, surplus fields are left out, a field that does not fit its type
    is null. Quotes and capitals are data: only the whole null mark is null.

    A gzip file is read by one task, whatever its size; bzip2 and plain text are divided.
    """
    return (
        spark.read.schema(schema)
        .option("sep", separator)
        .option("quote", "")
        .option("escape", "")
        .option("nullValue", null_mark)
        .option("emptyValue", "")
        .option("mode", "PERMISSIVE")
        .csv(path)
    )


def write_separated(
    df: DataFrame,
    path: str,
    separator: str = "\t",
    compression: str | None = None,
    null_mark: str = NULL_MARK,
    rows_per_file: int | None = None,
) -> None:
    """Write fields as text. An existing target is an error.

    ``rows_per_file`` bounds each file, which matters for gzip as one task reads a whole file.
    """
    writer = (
        df.write.mode("errorifexists")
        .option("sep", separator)
        .option("quote", "")
        .option("escape", "")
        .option("escapeQuotes", "false")
        .option("nullValue", null_mark)
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
    )
    if compression:
        writer = writer.option("compression", compression)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.csv(path)


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.text(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON record per line, null fields written out."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_table(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    df.write.mode("errorifexists").partitionBy(*by).parquet(path)


def read_table(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    stored: StructType | None = None,
) -> DataFrame:
    """A stored table. ``stored`` is the schema it was written in, which an empty one may lack in
    its files; ``schema`` casts it, as when a nested whole number comes back smaller."""
    reader = spark.read.schema(stored) if stored is not None else spark.read
    table = reader.parquet(path)
    if schema is None:
        return table
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return table.select(*[F.col(f.name).cast(f.dataType) for f in wanted])


def through_store(df: DataFrame, label: str) -> DataFrame:
    """Write to a fresh folder of the shared storage and read back."""
    path = fresh_path(df.sparkSession, label)
    write_table(df, path)
    return read_table(df.sparkSession, path, stored=df.schema)

