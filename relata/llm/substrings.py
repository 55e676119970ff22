"""Operator 6: repeated passages, by anchors at the positions of a difference cover.

The positions 0, 1 and 3 modulo 7 are a difference cover: for any two offsets there is a step
below 7 that brings both onto such positions. Two equal windows of 13 words therefore share an
anchor of 7 words that begins at such a position in both, and hashing 3 of 7 positions finds every
one of them. Anchors that several documents share are extended to all windows of 13 words around
them, and these alone are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.llm.arrow import map_batches, settle
from relata.llm.registry import query, table
from relata.llm.wordarrays import Words, slices

PERIOD, COVER = 7, (0, 1, 3)
WINDOW = 13
ANCHOR = WINDOW - PERIOD + 1  # an aligned step of up to PERIOD - 1 must stay inside the window

_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def _anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and place of each anchor."""
    hashes = words.hashes()
    rows = words.row_of()
    n = len(hashes) - ANCHOR + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    places = np.arange(n) - words.first[rows[:n]]
    at = np.flatnonzero(_IN_COVER[places % PERIOD] & (rows[:n] == rows[ANCHOR - 1 :]))
    return words.runs(hashes, at, ANCHOR), rows[at], places[at]


def _anchor_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    for first, words in slices(batch.column(1)):
        anchors, rows, places = _anchors(words)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(anchors.view(np.int64)),
                pa.array(ids[first + rows].astype(np.int64)),
                pa.array(places.astype(np.int32)),
            ],
            names=["anchor", "doc_id", "place"],
        )


def _list(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values))


def _window_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Extend the anchors at ``places`` to all windows that hold one of them."""
    ids = batch.column(0)
    lists = batch.column(2)
    for first, words in slices(batch.column(1)):
        part = lists.slice(first, words.rows)
        counts = part.value_lengths().to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(words.rows), counts)
        anchors = part.flatten().to_numpy(zero_copy_only=False) + words.first[rows]
        wanted = np.zeros(len(words.starts) + 1, dtype=bool)
        begins = words.first[rows]
        for back in range(PERIOD):
            at = anchors - back
            wanted[at[at >= begins]] = True
        row_of = words.row_of()
        n = max(len(row_of) - WINDOW + 1, 0)
        at = np.flatnonzero(wanted[:n] & (row_of[:n] == row_of[len(row_of) - n :]))
        starts = (at - words.first[row_of[at]]).astype(np.int32)
        cuts = np.searchsorted(row_of[at], np.arange(words.rows + 1))
        keys = words.runs(words.hashes(), at, WINDOW)
        checks = words.runs(words.hashes(1), at, WINDOW)
        yield pa.RecordBatch.from_arrays(
            [
                ids.slice(first, words.rows),
                _list(starts, cuts),
                _list(keys.view(np.int64), cuts),
                _list((checks >> np.uint64(32)).astype(np.uint32).view(np.int32), cuts),
            ],
            names=["doc_id", "starts", "keys", "checks"],
        )


def _removed_words(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ids, copies, lists = batch.column(0), batch.column(2), batch.column(3)
    for first, words in slices(batch.column(1)):
        n_words = np.diff(words.first)
        removed = np.zeros(len(words.starts), dtype=bool)
        digests, texts = [], []
        for row in range(words.rows):
            begin, end = words.first[row], words.first[row + 1]
            mine = removed[begin:end]
            if copies[first + row].as_py():
                mine[:] = len(mine) >= WINDOW
            elif (starts := lists[first + row]).is_valid:
                ends = np.zeros(len(mine) + 1, dtype=np.int64)
                at = np.unique(starts.values.to_numpy())
                at = at[at + WINDOW <= len(mine)]
                ends[at] += 1
                ends[at + WINDOW] -= 1
                mine[:] = np.cumsum(ends)[:-1] > 0
            kept = begin + np.flatnonzero(~mine)
            data = words.data.tobytes() if words.rows == 1 else None
            source = data if data is not None else memoryview(words.data)
            text = b" ".join(
                [bytes(source[a:b]) for a, b in zip(words.starts[kept], words.ends[kept])]
            )
            digests.append(hashlib.sha256(text).hexdigest())
            texts.append(text.decode("utf-8", "replace"))
        gone = np.add.reduceat(np.append(removed, False), words.first[:-1]) if words.rows else []
        gone = np.where(n_words > 0, gone, 0)
        yield pa.RecordBatch.from_arrays(
            [
                ids.slice(first, words.rows),
                pa.array(n_words.astype(np.int64)),
                pa.array(gone.astype(np.int64)),
                pa.array(texts),
                pa.array(digests),
            ],
            names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"],
        )


def remove_repeats(documents: DataFrame) -> DataFrame:
    """Remove words of windows of 13 that also start in a document of smaller doc_id.

    ``documents`` needs doc_id (whole numbers) and text. Returns doc_id, n_words, n_removed,
    kept_text (the words left, one blank between) and kept_sha256, a row per input row.

    Windows are judged on the input. A null or empty text has no words. Rows without doc_id are
    returned whole and take no part. Rows that repeat a doc_id are taken to hold one text: each
    is a document of that number, so they remove nothing from each other. Other columns are left
    out. An empty table gives no rows.

    A text that equals one of a smaller doc_id is a match over its whole length and needs no
    windows. Windows are compared by 96 bits of hash.
    """
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = texts.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    digests = known.select("doc_id", F.md5("text").alias("digest"))
    first = settle(
        digests.groupBy("digest")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .where("first < last"),
        "texts",
    )
    copies = settle(
        digests.join(first, "digest").where("doc_id > first").select("doc_id").distinct(),
        "copies",
    )
    anchors = map_batches(known, _anchor_rows, "anchor long, doc_id long, place int")
    shared = settle(
        anchors.groupBy("anchor")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .where("first < last")
        .select("anchor"),
        "shared-anchors",
    )
    places = settle(
        anchors.join(shared.hint("shuffle_hash"), "anchor")
        .groupBy("doc_id")
        .agg(F.collect_set("place").alias("places"))
        .join(copies, "doc_id", "left_anti"),
        "places",
    )
    extended = map_batches(
        known.join(places, "doc_id").select("doc_id", "text", "places"),
        _window_rows,
        "doc_id long, starts array<int>, keys array<long>, checks array<int>",
    )
    stored = settle(extended, "windows")
    windows = stored.select(
        "doc_id", F.explode(F.arrays_zip("starts", "keys", "checks")).alias("w")
    ).select("doc_id", "w.starts", "w.keys", "w.checks")
    repeated = settle(
        windows.groupBy("keys", "checks")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .where("first < last")
        .select("keys", "checks", "first"),
        "repeated-windows",
    )
    covered = settle(
        windows.join(repeated.hint("shuffle_hash"), ["keys", "checks"])
        .where("doc_id > first")
        .groupBy("doc_id")
        .agg(F.collect_set("starts").alias("starts")),
        "covered",
    )
    marked = (
        texts.join(copies.withColumn("copy", F.lit(True)), "doc_id", "left")
        .join(covered, "doc_id", "left")
        .select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "starts")
    )
    return map_batches(
        marked,
        _removed_words,
        "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string",
    )


SQL = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(words[i : i + 12], ' ')) AS key
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM split WHERE len(words) > 12)
), covered AS (
  SELECT DISTINCT doc_id, i + k AS place
  FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY key) AS first FROM windows),
    (SELECT unnest(range(0, 13)) AS k)
  WHERE doc_id > first
), words AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM split
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text
  FROM words ANTI JOIN covered USING (doc_id, place) GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""


@query("op6_substring_dedup", SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents")).drop("kept_text")
