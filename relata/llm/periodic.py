"""Operator 13: runs of words that repeat with a period, by string synchronising sets.

A run is a longest stretch of words with smallest period q and at least 4 q words. For each t = 1,
2, 4, ... a synchronising set marks the places whose window of t words has the smallest hash among
the t + 1 windows from there on, at the first or the last of them: the marks depend on the 2 t words
that follow, and of any t places one is marked unless the words around repeat at a quarter of t. In
a run with t <= q < 2 t, two marked places a period apart therefore see the same 2 t words, with no
such place between. So neighbours among marked places of equal context propose all periods of this
scale, and proposals are extended word by word. Windows with a period of at most t / 4 would be
marked too densely; they are those inside runs that smaller scales have found, and are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.llm.arrow import map_batches
from relata.llm.registry import query, table
from relata.llm.wordarrays import mix, slices

TIMES = 4  # least length of a run in periods
LEAST = 6  # least length of a run that is reported
CELLS = 1 << 20  # words compared at once

U = np.uint64
LAST = U(2**64 - 1)


def _synchronised(names: np.ndarray, periodic: np.ndarray, t: int) -> np.ndarray:
    """Places i whose least name in i .. i + t is that of i or of i + t; periodic windows have none."""
    names = np.where(periodic, LAST, names)
    n = len(names) - t
    least, width = names, 1
    while 2 * width <= t + 1:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    rest = t + 1 - width
    least = np.minimum(least[:n], least[rest : rest + n])
    return np.flatnonzero((least != LAST) & ((least == names[:n]) | (least == names[t:])))


def _reach(words: np.ndarray, at: np.ndarray, apart: np.ndarray, step: int) -> np.ndarray:
    """How many places in a row from ``at`` on, in steps of ``step``, equal the place ``apart`` later."""
    out = np.zeros(len(at), np.int64)
    who, width = np.arange(len(at)), 8
    while len(who):
        width = max(1, min(2 * width, CELLS // len(who)))
        x = (at[who] + step * out[who])[:, None] + step * np.arange(width)
        y = x + apart[who][:, None]
        inside = (x >= 0) & (y < len(words))
        last = len(words) - 1
        same = inside & (words[np.clip(x, 0, last)] == words[np.clip(y, 0, last)])
        whole = same.all(axis=1)
        out[who] += np.where(whole, width, same.argmin(axis=1))
        who = who[whole]
    return out


def _propose(context: np.ndarray, marked: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring marked places of one context that are t to 2 t - 1 apart: (place, distance)."""
    order = marked[np.argsort(context[marked], kind="stable")]
    apart = order[1:] - order[:-1]
    fits = (apart >= t) & (apart < 2 * t)
    first, apart = order[:-1][fits], apart[fits]
    same = context[first] == context[first + apart]
    return first[same], apart[same]


def _stretches(words: np.ndarray, first: np.ndarray, apart: np.ndarray, t: int):
    """Longest stretches (start, end, period) around the proposals, each once."""
    order = np.lexsort((first, apart))
    first, apart = first[order], apart[order]
    # marked places of one period at most 2 t apart lie in one stretch, as their contexts overlap
    begins = np.ones(len(first), bool)
    begins[1:] = (apart[1:] != apart[:-1]) | (first[1:] - first[:-1] > 2 * t)
    at = np.flatnonzero(begins)
    ends = np.append(at[1:], len(first)) - 1
    low, high, apart = first[at], first[ends] + 2 * t, apart[at]
    low = low - _reach(words, low - 1, apart, -1)
    high = high + _reach(words, high, apart, 1) + apart
    found = np.stack([low, high, apart], axis=1)
    return np.unique(found[high - low >= TIMES * apart], axis=0)


def find_runs(words: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """Runs (start, end, smallest period), by start and period, of at least ``TIMES`` periods.

    ``words`` are numbers of 64 bits; each text, whose number ``text_of`` has, ends in a number that
    occurs nowhere else.
    """
    runs = np.zeros((0, 3), np.int64)
    place = np.arange(len(words))  # the texts that are long enough for the scale
    lengths = np.bincount(text_of)
    names, kept, t = mix(words), words, 1
    while len(kept) > 2 * t:
        periodic = np.zeros(len(names) + 1, np.int64)
        inside = runs[(TIMES * runs[:, 2] <= t) & (runs[:, 1] - runs[:, 0] >= t)]
        inside = inside[lengths[text_of[inside[:, 0]]] > TIMES * t]
        at = np.searchsorted(place, inside[:, 0])
        np.add.at(periodic, at, 1)
        np.add.at(periodic, at + inside[:, 1] - inside[:, 0] - t + 1, -1)
        marked = _synchronised(names, np.cumsum(periodic[:-1]) > 0, t)
        doubled = mix(names[:-t] * U(0x9E3779B97F4A7C15) + names[t:])
        first, apart = _propose(doubled, marked, t)
        if len(first):
            found = _stretches(kept, first, apart, t)
            found[:, 1] = place[found[:, 1] - 1] + 1
            found[:, 0] = place[found[:, 0]]
            runs = np.concatenate([runs, found])
        t *= 2
        long_enough = lengths[text_of[place]] > TIMES * t
        if not long_enough.all():
            whole = np.zeros(len(place), U)
            whole[: len(doubled)] = doubled
            place, kept, doubled = place[long_enough], kept[long_enough], whole[long_enough]
            doubled = doubled[: max(0, len(kept) - t + 1)]
        names = doubled
    # a stretch has several of its periods at most; its smallest comes first
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    if len(runs):
        fresh = np.ones(len(runs), bool)
        fresh[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
        runs = runs[fresh]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _runs_of_texts(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``find_runs`` of the texts ``first[i]:first[i + 1]``, in places of ``hashes``."""
    rows = len(first) - 1
    text_of = np.repeat(np.arange(rows), np.diff(first) + 1)
    words = np.empty(len(text_of), U)
    ends = first[1:] + np.arange(rows)
    words[ends] = mix(mix(np.arange(1, rows + 1).astype(U)) + U(0x632BE59BD9B4E019))
    inside = np.ones(len(words), bool)
    inside[ends] = False
    words[inside] = hashes
    runs = find_runs(words, text_of)
    runs[:, :2] -= text_of[runs[:, 0]][:, None]
    return runs


def _exact(words: list[bytes]) -> np.ndarray:
    """The runs of one text, its words told by their bytes."""
    numbers: dict[bytes, int] = {}
    told = [numbers.setdefault(w, len(numbers) + 1) for w in words]
    return _runs_of_texts(np.array(told, U), np.array([0, len(told)]))


def _collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words outside all runs and those of each run's first period."""
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 1], -1)
    stays = np.cumsum(cover[:-1]) == 0
    return b" ".join(w for w, stay in zip(words, stays.tolist()) if stay)


def _describe(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for row, words in slices(batch.column(1)):
        runs = _runs_of_texts(words.hashes(), words.first)
        cuts = np.searchsorted(runs[:, 0], words.first)
        texts = batch.column(1).slice(row, words.rows).to_pylist()
        found, collapsed = [], []
        for k, text in enumerate(texts):
            # bytes.split parts at blanks and 0x09-0x0D
            spoken = (text or "").encode().split()
            mine = runs[cuts[k] : cuts[k + 1]].copy()
            mine[:, :2] -= words.first[k]
            if any(spoken[s : e - q] != spoken[s + q : e] for s, e, q in mine.tolist()):
                mine = _exact(spoken)
            mine = mine[mine[:, 1] - mine[:, 0] >= LEAST]
            collapsed.append(_collapse(spoken, mine) if len(mine) else b" ".join(spoken))
            found.append([{"start": s, "length": e - s, "period": q} for s, e, q in mine.tolist()])
        number = pa.int64()
        run = pa.struct([("start", number), ("length", number), ("period", number)])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).slice(row, words.rows),
                pa.array(np.diff(words.first), number),
                pa.array(found, pa.list_(run)),
                pa.array([c.decode() for c in collapsed], pa.string()),
            ],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )


def periodic_runs(documents: DataFrame) -> DataFrame:
    """The runs of words of each row of ``documents`` (doc_id, text), and the text without them.

    Returns doc_id, n_words, runs: an array of (start, length, period) by start and period, and
    collapsed: the words joined by one blank, without those that a run has after its first period.
    A run has a smallest period q and at least 4 q and 6 words, and goes as far as the period does.
    Words are told by 64 bits of hash; runs are compared by bytes, and where that differs the text
    is searched again by the words' bytes.

    A null or empty text has no words, no runs and an empty collapsed text. Repeated rows and rows
    without a doc_id all stay. Other columns are left out. No rows give no rows. Memory follows the
    longest text, about 100 bytes a word.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = (
        "doc_id long, n_words long, "
        "runs array<struct<start:long,length:long,period:long>>, collapsed string"
    )
    return map_batches(texts, _describe, schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest length in periods; of equal ones the first. Null without runs."""
    return F.aggregate(
        F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))),
        F.get(runs, F.lit(0)),
        lambda best, run: F.when(
            run["length"] * best["period"] > best["length"] * run["period"], run
        ).otherwise(best),
    )


def with_repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, text), the tail of each tenth text replaced by repeats of its beginning.

    Which texts, where and with which period follows from a checksum of doc_id; a text without
    doc_id or words stays.
    """
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.crc32(F.col("doc_id").cast("string")).alias("h"),
    )
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    tail = F.expr(
        "aggregate(array(named_struct('n', size(words), 'g', h div 10)), '', (s, x) ->"
        " concat_ws(' ', transform(sequence(0, x.n - 1), i -> get(words,"
        " CASE WHEN i < x.g % x.n THEN i"
        " ELSE CAST(x.g % x.n + (i - x.g % x.n) % (1 + (x.n - x.g % x.n) div (3 + x.g % 8)) AS INT)"
        " END))))"
    )
    chosen = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    return chosen.select(
        "doc_id",
        F.when(F.size("words") > 0, tail).otherwise(F.col("text")).alias("text"),
    )


@query("op13_periodic_runs")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs(with_repeats(table(spark, folder, "documents")))
    lines = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    )
    told = found.select(
        "doc_id",
        "n_words",
        F.size("runs").cast("long").alias("n_runs"),
        strongest(F.col("runs")).alias("top"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return told.select(
        "doc_id",
        "n_runs",
        "top.start",
        "top.length",
        "top.period",
        F.expr("(1000 * top.length) div top.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
        "n_words",
    )
