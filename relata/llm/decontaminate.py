"""Operator 1: passages of a benchmark in training text.

The test items are an inverted index under BM25, and every passage of every document is a query
against it. An item is a candidate if its score reaches a share of the score that its own text
would get. Items are numbered in blocks. A passage is dropped if the largest weights of its terms
cannot add up to the threshold; else whole blocks are skipped by the largest weights of its terms
inside them (block-max WAND, a block at a time), and only the others are scored. Candidates are
then verified by the overlap of question and answer.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.llm.arrow import map_batches, settle
from relata.llm.registry import query, table
from relata.llm.wordarrays import Words, slices

K1, B = 1.2, 0.75  # fixed values: usual BM25 parameters
SHARE = 0.5  # of the item's own score
OVERLAP = 0.6  # of the question's shingles, and of the answer's words
SHINGLE = 3  # words of a shingle of the question
LEAST_PASSAGE = 32  # words; the longest item if that is longer
ITEMS_IN_BLOCK = 16
PART_CHARS = 8 << 20  # item text indexed and broadcast at a time
BOUNDS = 2 << 20  # weights of terms in blocks that a task adds up at a time


@dataclass
class Index:
    """Weights of terms in items, as shares of each item's own score."""

    stride: int
    vocabulary: np.ndarray  # sorted word hashes
    largest: np.ndarray  # by term
    block_largest: np.ndarray  # by term and block
    postings: dict[tuple[int, int], list[tuple[int, float]]]  # by block and term
    items: list[int]
    questions: list[np.ndarray]
    answers: list[np.ndarray]

    def candidates(self, terms: np.ndarray, blocks: np.ndarray) -> Iterator[tuple[int, float]]:
        """Items of ``blocks`` that reach the threshold, with their scores."""
        listed = terms.tolist()
        for block in blocks.tolist():
            scores: dict[int, float] = defaultdict(float)
            for term in listed:
                for item, weight in self.postings.get((block, term), ()):
                    scores[item] += weight
            for item, score in scores.items():
                if score >= SHARE:
                    yield item, score


def _one_row(words: Words, row: int, hashes: np.ndarray) -> np.ndarray:
    return hashes[words.first[row] : words.first[row + 1]]


def _shingles(hashes: np.ndarray) -> np.ndarray:
    width = min(SHINGLE, len(hashes))
    at = np.arange(max(len(hashes) - width + 1, 0))
    return np.unique(Words.runs(hashes, at, width)) if width else np.zeros(0, np.uint64)


def build_index(
    rows: list, stride: int, n_items: int, mean_words: float, frequency: dict[int, int]
) -> Index:
    """Index ``rows`` (item_id, question, answer). ``frequency``: items that hold a word hash."""
    joined = pa.array([f"{r.question}\n{r.answer}" for r in rows], pa.string())
    weights: list[dict[int, float]] = []
    for _, words in slices(joined, lower=True, most=PART_CHARS * 16):
        hashes = words.hashes()
        for row in range(words.rows):
            terms, counts = np.unique(_one_row(words, row, hashes), return_counts=True)
            own = {}
            norm = K1 * (1 - B + B * counts.sum() / mean_words)
            for term, count in zip(terms.tolist(), counts.tolist()):
                df = frequency[term]
                idf = np.log1p((n_items - df + 0.5) / (df + 0.5))
                own[term] = idf * count * (K1 + 1) / (count + norm)
            total = sum(own.values())
            weights.append({t: w / total for t, w in own.items()})
    vocabulary = np.array(sorted({t for own in weights for t in own}), dtype=np.uint64)
    place = {t: i for i, t in enumerate(vocabulary.tolist())}
    n_blocks = -(-len(rows) // ITEMS_IN_BLOCK)
    block_largest = np.zeros((len(vocabulary), n_blocks), dtype=np.float32)
    postings = defaultdict(list)
    for item, own in enumerate(weights):
        block = item // ITEMS_IN_BLOCK
        for term, weight in own.items():
            at = place[term]
            postings[block, at].append((item, weight))
            block_largest[at, block] = max(block_largest[at, block], weight)

    def hashed(texts: list[str]) -> list[np.ndarray]:
        found = []
        for _, words in slices(pa.array(texts, pa.string()), lower=True, most=PART_CHARS * 16):
            hashes = words.hashes()
            found += [_one_row(words, row, hashes) for row in range(words.rows)]
        return found

    return Index(
        stride,
        vocabulary,
        block_largest.max(axis=1) if len(vocabulary) else np.zeros(0, np.float32),
        block_largest,
        dict(postings),
        [r.item_id for r in rows],
        [_shingles(h) for h in hashed([r.question for r in rows])],
        [np.unique(h) for h in hashed([r.answer for r in rows])],
    )


def _passages(words: Words, hashes: np.ndarray, index: Index):
    """Passages that may reach the threshold: row, first word, end, distinct terms.

    Passages are two strides long and begin at every stride, so a text of up to a stride lies whole
    in one of them.
    """
    if not len(index.vocabulary) or not len(hashes):
        return
    stride = index.stride
    at = np.minimum(np.searchsorted(index.vocabulary, hashes), len(index.vocabulary) - 1)
    hits = np.flatnonzero(index.vocabulary[at] == hashes)
    terms = at[hits]
    rows = words.row_of()[hits]
    places = hits - words.first[rows]
    lengths = np.diff(words.first)
    counts = np.maximum(1, -(-lengths // stride) - 1)
    base = np.concatenate([[0], np.cumsum(counts)])
    order = np.lexsort((places, terms, rows))
    same = (rows[order][1:] == rows[order][:-1]) & (terms[order][1:] == terms[order][:-1])
    before = np.full(len(hits), -1)
    before[order[1:][same]] = places[order[:-1][same]]
    passages, members = [], []
    for back in (0, 1):
        number = places // stride - back
        fits = (number >= 0) & (number < counts[rows]) & (before < number * stride)
        passages.append((base[rows] + number)[fits])
        members.append(terms[fits])
    passages, members = np.concatenate(passages), np.concatenate(members)
    bound = np.bincount(passages, weights=index.largest[members], minlength=base[-1])
    alive = bound >= SHARE * 0.9999
    kept = alive[passages]
    order = np.argsort(passages[kept], kind="stable")
    passages, members = passages[kept][order], members[kept][order]
    chunks = len(passages) * index.block_largest.shape[1] // BOUNDS + 1
    for some in np.array_split(np.unique(passages), chunks):
        if not len(some):
            continue
        low, high = np.searchsorted(passages, [some[0], some[-1] + 1])
        cuts = np.searchsorted(passages[low:high], some)
        sums = np.add.reduceat(index.block_largest[members[low:high]], cuts, axis=0)
        ends = np.append(cuts[1:], high - low)
        for i in np.flatnonzero((sums >= SHARE * 0.9999).any(axis=1)):
            row = int(np.searchsorted(base, some[i], side="right")) - 1
            first = words.first[row] + (some[i] - base[row]) * stride
            end = min(first + 2 * stride, words.first[row + 1])
            blocks = np.flatnonzero(sums[i] >= SHARE * 0.9999)
            yield row, first, end, members[low + cuts[i] : low + ends[i]], blocks


def _share(part: np.ndarray, whole: np.ndarray) -> float:
    return float(np.isin(whole, part).mean()) if len(whole) else 1.0


def _search(shared):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        index = shared.value
        ids = batch.column(0)
        for first_row, words in slices(batch.column(1), lower=True):
            hashes = words.hashes()
            best: dict[tuple[int, int], tuple[float, float, float]] = {}
            for row, first, end, terms, blocks in _passages(words, hashes, index):
                mine = shingles = None
                for item, score in index.candidates(terms, blocks):
                    if mine is None:
                        mine = hashes[first:end]
                        shingles = [Words.runs(mine, np.arange(len(mine) - w + 1), w)
                                    for w in range(1, min(SHINGLE, len(mine)) + 1)]
                    n = len(index.questions[item])
                    asked = max((_share(s, index.questions[item]) for s in shingles), default=0.0)
                    said = _share(mine, index.answers[item])
                    if n and asked >= OVERLAP and said >= OVERLAP:
                        key = (first_row + row, item)
                        best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (score, asked, said))
            if best:
                keys, values = list(best), list(best.values())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array([k[0] for k in keys])),
                        pa.array([index.items[k[1]] for k in keys], pa.int64()),
                        *[pa.array([v[i] for v in values], pa.float64()) for i in range(3)],
                    ],
                    names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                )

    return run


def _word_hashes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for _, words in slices(batch.column(0), lower=True):
        hashes = words.hashes()
        terms = [np.unique(_one_row(words, row, hashes)) for row in range(words.rows)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(terms).view(np.int64))], names=["term"]
        )


def contaminated(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Documents (doc_id, text) that hold items (item_id, question, answer).

    Returns doc_id, item_id and of the best passage the score (a share of the item's own),
    question_overlap and answer_overlap. Words are lower-cased.

    The items may be of any number: they are indexed, broadcast and searched in parts of about
    ``PART_CHARS``, with term statistics over all items. Items without a question or an item_id and
    documents without text or doc_id give nothing; an empty answer is taken as found. Repeated rows
    give one result. Other columns are left out. If either table is empty, so is the result.
    """
    spark = documents.sparkSession
    asked = items.where("item_id IS NOT NULL").select(
        F.col("item_id").cast("long").alias("item_id"),
        F.coalesce("question", F.lit("")).alias("question"),
        F.coalesce("answer", F.lit("")).alias("answer"),
    )
    whole = F.concat("question", F.lit("\n"), "answer")
    n_words = F.size(F.regexp_extract_all(whole, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    asked = asked.withColumn("n_words", n_words).where("n_words > 0").dropDuplicates()
    totals = asked.agg(
        F.count("*").alias("n"),
        F.sum(F.length(whole)).alias("chars"),
        F.avg("n_words").alias("mean"),
        F.max("n_words").alias("longest"),
    ).first()
    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    schema = (
        "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    )
    terms = map_batches(asked.select(whole), _word_hashes, "term long").groupBy("term").agg(
        F.count("*").alias("items")
    )
    parts = -(-(totals.chars or 0) // PART_CHARS)
    part = F.pmod(F.xxhash64("item_id", "question", "answer"), F.lit(max(parts, 1)))
    found = spark.createDataFrame([], schema)
    for number in range(parts):
        chosen = asked.where(part == number)
        held = map_batches(chosen.select(whole), _word_hashes, "term long").distinct()
        frequency = {
            row.term % 2**64: row["items"] for row in terms.join(held, "term").collect()
        }
        rows = chosen.orderBy("item_id", "question", "answer").collect()
        index = build_index(
            rows, max(LEAST_PASSAGE, totals.longest), totals.n, totals.mean, frequency
        )
        shared = spark.sparkContext.broadcast(index)
        # stored part by part, so that one index at a time is in memory
        found = found.unionByName(settle(map_batches(texts, _search(shared), schema), "leaks"))
        shared.unpersist()
    return found.groupBy("doc_id", "item_id").agg(
        F.max("score").alias("score"),
        F.max("question_overlap").alias("question_overlap"),
        F.max("answer_overlap").alias("answer_overlap"),
    )


def question_and_answer(items: DataFrame) -> DataFrame:
    """Split the text of ``items`` (item_id, text): the last sentence is the answer.

    A text of one sentence is all question.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    cut = F.regexp_extract(text, r"^([\s\S]*[.!?])\s+(\S[\s\S]*?)$", 1)
    return items.select(
        "item_id",
        F.when(cut == "", text).otherwise(cut).alias("question"),
        F.when(cut == "", F.lit("")).otherwise(F.substr(text, F.length(cut) + 1)).alias("answer"),
    )


@query("op1_benchmark_decontamination")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    items = question_and_answer(table(spark, folder, "benchmark"))
    return contaminated(table(spark, folder, "documents"), items)
