"""Operator 11: exact copies by a 128-bit content hash, told from collisions by their bytes.

Built-in functions only. Rows are grouped by the hash of their text without white space and by the
text itself, so what the hash brings together is compared byte by byte in the aggregation. Copies
merge on the map side: a text with very many copies sends one row per task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.llm.arrow import settle
from relata.llm.registry import query, table

#: Room for every doc_id, and for a null behind them, below the count of characters in ``_order``.
IDS = 1 << 65
LOWEST = 1 << 63


def bare(text: Column) -> Column:
    """The text without blanks and 0x09-0x0D; a null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _order(n_chars: str, doc_id: str) -> Column:
    """A number that is least for the longest text, then for the smallest doc_id, nulls last.

    One decimal instead of a struct, as a hash aggregate can keep its minimum in place.
    """
    return F.expr(
        f"CAST(2147483647 - {n_chars} AS DECIMAL(38,0)) * CAST({IDS} AS DECIMAL(20,0))"
        f" + coalesce(CAST({doc_id} AS DECIMAL(38,0)) + {LOWEST}, CAST({IDS - 1} AS DECIMAL(38,0)))"
    ).cast("decimal(38,0)")


def _id_of(order: str) -> Column:
    rest = f"({order} % CAST({IDS} AS DECIMAL(38,0)))"
    return F.expr(f"CASE WHEN {rest} < {IDS - 1} THEN CAST({rest} - {LOWEST} AS BIGINT) END")


def _keyed(documents: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    texts = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
        bare(F.col("text")).alias("bare"),
    )
    return texts.withColumn("key", digest(F.col("bare")))


def exact_copies(
    documents: DataFrame, digest: Callable[[Column], Column] = F.md5
) -> DataFrame:
    """The row that stays for each row of ``documents`` (doc_id, text).

    Returns doc_id, n_chars (code points of the text), keep_id, group_size, kept, and text_sha256 of
    the text without white space. Texts are equal if they differ in blanks and 0x09-0x0D only. Of
    equal texts the longest stays, then the one with the smallest doc_id. ``digest`` is the content
    hash; texts that share a hash by chance stay apart.

    A null text is empty, and all empty texts are one group. A null doc_id comes last; if it is kept,
    keep_id is null. Rows that repeat the kept row's doc_id and length are that document and kept
    as well. Other columns are left out. No rows give no rows.
    """
    rows = _keyed(documents, digest)
    classes = settle(
        rows.groupBy("key", "bare")
        .agg(F.count("*").alias("group_size"), F.min(_order("n_chars", "doc_id")).alias("best"))
        .withColumn("text_sha256", F.sha2("bare", 256)),
        "classes",
    )
    collided = settle(
        classes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"),
        "collided",
    )
    verdict = ["group_size", "best", "text_sha256"]
    found = rows.drop("bare").join(classes.drop("bare"), "key")
    if not collided.isEmpty():
        # rows whose hash stands for several texts find their class by the text
        alone = settle(classes.join(collided, "key", "left_anti"), "classes-alone")
        shared = settle(classes.join(collided, "key"), "classes-shared")
        names = ["doc_id", "n_chars", *verdict]
        found = (
            rows.drop("bare").join(alone.drop("bare"), "key").select(*names)
            .unionByName(rows.join(shared, ["key", "bare"]).select(*names))
        )
    return found.withColumn("keep_id", _id_of("best")).select(
        "doc_id",
        "n_chars",
        "keep_id",
        "group_size",
        (_order("n_chars", "doc_id") == F.col("best")).alias("kept"),
        "text_sha256",
    )


def without_copies(documents: DataFrame, digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """``documents`` with all its columns, less the rows of which ``exact_copies`` keeps another.

    A repeated row of the kept document stays, as in ``exact_copies``.
    """
    gone = settle(
        exact_copies(documents, digest)
        .where("NOT kept")
        .select(F.col("doc_id").alias("gone_id"), F.col("n_chars").alias("gone_chars"), "text_sha256")
        .distinct(),
        "copies",
    )
    same = (
        F.col("doc_id").cast("long").eqNullSafe(F.col("gone_id"))
        & (F.length(F.coalesce("text", F.lit(""))) == F.col("gone_chars"))
        & (F.sha2(bare(F.col("text")), 256) == F.col("gone.text_sha256"))
    )
    return documents.join(gone.alias("gone"), same, "left_anti")


SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare
  FROM documents
), ranked AS (
  SELECT doc_id, bare, length(text) AS n_chars,
    first_value(doc_id) OVER kin AS keep_id, first_value(length(text)) OVER kin AS most,
    count(*) OVER (PARTITION BY bare) AS group_size
  FROM texts WINDOW kin AS (PARTITION BY bare ORDER BY length(text) DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size,
  doc_id IS NOT DISTINCT FROM keep_id AND n_chars = most AS kept, sha256(bare) AS text_sha256
FROM ranked
"""


@query("op11_exact_dedup", SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return exact_copies(table(spark, folder, "documents")).drop("n_chars")
