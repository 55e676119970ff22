"""Operator 7: repeated runs of lines, by content-defined pieces.

A chunk ends where a rolling hash over the last two line hashes says so, but also by its size so
far: a run of a few lines is mostly cut together with foreign lines. Runs are therefore found by
windows, which depend on content alone: each line with a word and the next one. Pieces that occur
again anywhere are removed once their bytes have been compared with those of the first occurrence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.llm.arrow import map_batches, settle
from relata.llm.registry import query, table

LEAST, MEAN, MOST = 2, 3, 64  # lines of a chunk
BLANK = b" \t\n\x0b\x0c\r"


def chunks(lines: list[bytes]) -> list[tuple[int, int]]:
    """First line and the line behind the last of each chunk.

    A chunk ends after ``MOST`` lines, or after a line where the rolling hash is a multiple of
    ``MEAN`` if it has ``LEAST`` lines by then.
    """
    cuts, begin, before = [], 0, 0
    for at, line in enumerate(lines):
        now = xxhash.xxh3_64_intdigest(line)
        size = at + 1 - begin
        rolled = (before * 0x9E3779B97F4A7C15 + now) & 0xFFFFFFFFFFFFFFFF
        if size >= MOST or size >= LEAST and (rolled >> 32) % MEAN == 0:
            cuts.append((begin, at + 1))
            begin = at + 1
        before = now
    if begin < len(lines):
        cuts.append((begin, len(lines)))
    return cuts


def _candidates(lines: list[bytes]) -> Iterator[tuple[int, int, int, bytes]]:
    """Number, first line, end and bytes of each chunk with at least two lines that are not blank."""
    for number, (begin, end) in enumerate(chunks(lines)):
        if sum(bool(line.strip(BLANK)) for line in lines[begin:end]) > 1:
            yield number, begin, end, b"\n".join(lines[begin:end])


def _windows(lines: list[bytes]) -> Iterator[tuple[int, int, int, bytes]]:
    """Each line with a word up to the next such line, blank ones between them included.

    A run of lines that stands somewhere else as well is made of windows that do, wherever it begins
    and ends. The number of a window is its first line.
    """
    begin = -1
    for at, line in enumerate(lines):
        if line.strip(BLANK):
            if begin >= 0:
                yield begin, begin, at + 1, b"\n".join(lines[begin : at + 1])
            begin = at


Pieces = Callable[[list[bytes]], Iterator[tuple[int, int, int, bytes]]]


def _piece_rows(pieces: Pieces):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [
            (xxhash.xxh3_128_digest(content), doc_id, begin, end)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()))
            for _, begin, end, content in pieces(text.as_py().split(b"\n"))
        ]
        kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, kinds)],
            names=["piece", "doc_id", "begin", "end"],
        )

    return run


def _piece_bytes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The bytes of the listed pieces of each text, and whether they are those of the first place."""
    rows = []
    texts = batch.column(1).cast(pa.binary())
    for doc_id, text, places in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist()):
        lines = text.as_py().split(b"\n")
        for place in places:
            content = b"\n".join(lines[place["begin"] : place["end"]])
            rows.append((place["piece"], doc_id, place["begin"], place["end"], place["leads"], content))
    kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)],
        names=["piece", "doc_id", "begin", "end", "leads", "bytes"],
    )


def _without(blanks: bool):
    """Texts without the lines of the pieces that go; with ``blanks``, without blank lines behind them."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        texts = batch.column(1).cast(pa.binary())
        for text, gone in zip(texts, batch.column(2).to_pylist()):
            raw = text.as_py()
            lines = raw.split(b"\n")
            dropped, kept = 0, raw
            if gone:
                leaves = bytearray(len(lines))
                for place in gone:
                    for at in range(place["begin"], min(place["end"], len(lines))):
                        leaves[at] = True
                if blanks:
                    for at in range(1, len(lines)):
                        if leaves[at - 1] and not lines[at].strip(BLANK):
                            leaves[at] = True
                dropped = sum(leaves)
                kept = b"\n".join(line for line, leave in zip(lines, leaves) if not leave)
            out.append(
                (len(lines), len(chunks(lines)), dropped, kept.decode(), hashlib.sha256(kept).hexdigest())
            )
        columns = list(zip(*out))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)], *batch.columns[3:]],
            names=["doc_id", "n_lines", "n_chunks", "n_removed_lines", "clean_text", "kept_sha256"]
            + batch.schema.names[3:],
        )

    return run


def remove_runs(documents: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``remove_chunks`` for every run of lines that occurs earlier, however it lies to the chunks.

    A run has two lines with a word or more, and blank lines in between have to be equal as well.
    Blank lines behind a removed run go with it. In one text, a run does not count as a repeat of
    lines that it overlaps.
    """
    return _remove(documents, carry, _windows, blanks=True)


def remove_chunks(documents: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``documents`` (doc_id, text) without chunks of lines that occur earlier.

    Earlier is by doc_id, then by place in the text; the first occurrence stays. Chunks with fewer
    than two lines that hold a word stay. Returns doc_id, n_lines, n_chunks, n_removed_lines,
    clean_text, kept_sha256 and the columns named in ``carry``, a row per input row.

    A null text is empty, and an empty text is one empty line. Rows without doc_id are returned
    whole and take no part. Rows that repeat a doc_id are taken to hold one text and do not remove
    from each other. Chunks of equal hash but other bytes stay. Other columns are left out. No rows
    give no rows.
    """
    return _remove(documents, carry, _candidates, blanks=False)


def _remove(
    documents: DataFrame, carry: tuple[str, ...], pieces: Pieces, blanks: bool
) -> DataFrame:
    texts = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        *[F.col(c).alias(f"carried_{c}") for c in carry],
    )
    known = texts.where("doc_id IS NOT NULL").select("doc_id", "text")
    rows = map_batches(
        known, _piece_rows(pieces), "piece binary, doc_id long, begin int, end int"
    )
    place = F.struct("doc_id", "begin", "end")
    repeated = settle(
        rows.groupBy("piece")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where("first < last")
        .select("piece", "first"),
        "repeated-pieces",
    )
    leads = place == F.col("first")
    behind = (F.col("doc_id") != F.col("first.doc_id")) | (F.col("begin") >= F.col("first.end"))
    places = settle(
        rows.join(repeated.hint("shuffle_hash"), "piece")
        .where(leads | behind)
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct("piece", "begin", "end", leads.alias("leads"))).alias("places")),
        "repeated-places",
    )
    found = settle(
        map_batches(
            known.join(places.hint("merge"), "doc_id").select("doc_id", "text", "places"),
            _piece_bytes,
            "piece binary, doc_id long, begin int, end int, leads boolean, bytes binary",
        ),
        "pieces",
    )
    firsts = (
        found.where("leads")
        .select("piece", F.col("bytes").alias("first_bytes"))
        .dropDuplicates(["piece"])
    )
    removed = settle(
        found.where("NOT leads")
        .join(settle(firsts, "first-pieces"), "piece")
        .where("bytes = first_bytes")
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct("begin", "end")).alias("gone")),
        "removed-pieces",
    )
    kinds = dict(texts.dtypes)
    cleaned = map_batches(
        texts.join(removed.hint("merge"), "doc_id", "left").select(
            "doc_id", "text", "gone", *[f"carried_{c}" for c in carry]
        ),
        _without(blanks),
        "doc_id long, n_lines long, n_chunks long, n_removed_lines long, clean_text string,"
        " kept_sha256 string" + "".join(f", carried_{c} {kinds[f'carried_{c}']}" for c in carry),
    )
    return cleaned.withColumnsRenamed({f"carried_{c}": c for c in carry})


@query("op7_line_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return remove_runs(table(spark, folder, "documents")).drop("clean_text")
