"""Operator 8: a log-bilinear language model, trained in numpy with noise-contrastive estimation.

The vocabulary is the most frequent training words; all others share one class, inside which a word
has its discounted unigram probability. A context is the two words before: the product of their
vectors with a weight vector per position, added up, predicts the vector of the next word.

Every task trains on its own share of the documents and the parameters are averaged (parameter
mixing), so all training text counts and what is sent grows with the number of tasks. Since the
prediction is a sum over positions, the normalisers of all contexts are one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.llm.arrow import map_all, map_batches, settle
from relata.llm.registry import query, table
from relata.llm.wordarrays import Words, slices

HEAD = 1022  # words with a vector of their own
LOOKUP = 1 << 16  # words whose counts are broadcast; other counts are joined
WIDTH = 24  # of a vector
NOISE = 32  # noise words of a batch
BATCH = 4096  # tokens
RATE = 0.1
ROUNDS = 2  # the training documents are dealt to so many rounds of mixing
BLOCKS = 32  # rows in which a task sends its parameters
END, OTHER = 0, 1  # classes; END is also the context before the first word

U = np.uint64


@dataclass
class Vocabulary:
    hashes: np.ndarray  # sorted hashes of looked-up words
    counts: np.ndarray
    classes: np.ndarray  # by looked-up word
    n_classes: int
    class_counts: np.ndarray
    tokens: int  # in training
    types: int
    discount: float
    other_types: int
    unseen_types: float  # estimated

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in ``hashes`` and whether it is there."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def classes_of(self, at: np.ndarray, known: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(at), OTHER)
        return np.where(known, self.classes[at], OTHER)

    @property
    def unigram(self) -> np.ndarray:
        smoothed = self.class_counts + 1.0
        return smoothed / smoothed.sum()


@dataclass
class Parameters:
    context: np.ndarray  # class x width
    target: np.ndarray
    positions: np.ndarray  # 2 x width
    bias: np.ndarray

    @staticmethod
    def start(vocabulary: Vocabulary, seed: int = 11) -> Parameters:
        draw = np.random.default_rng(seed)
        shape = (vocabulary.n_classes, WIDTH)
        return Parameters(
            draw.normal(0, 0.1, shape).astype(np.float32),
            draw.normal(0, 0.1, shape).astype(np.float32),
            np.ones((2, WIDTH), np.float32),
            np.log(vocabulary.unigram).astype(np.float32),
        )

    def flat(self) -> np.ndarray:
        parts = (self.context, self.target, self.positions, self.bias)
        return np.concatenate([p.ravel() for p in parts])

    @staticmethod
    def unflat(values: np.ndarray, n_classes: int) -> Parameters:
        cuts = np.cumsum([n_classes * WIDTH, n_classes * WIDTH, 2 * WIDTH])
        a, b, c, d = np.split(values.astype(np.float32), cuts)
        return Parameters(
            a.reshape(-1, WIDTH), b.reshape(-1, WIDTH), c.reshape(2, WIDTH), d
        )


class Scorer:
    """Log-probabilities of classes after two classes, normalised for every context."""

    def __init__(self, p: Parameters) -> None:
        self.first = (p.context * p.positions[0]) @ p.target.T
        self.second = (p.context * p.positions[1]) @ p.target.T + p.bias
        self.log_sums = np.log(np.exp(self.first) @ np.exp(self.second).T)

    def __call__(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
        """``one`` is the class just before the target, ``two`` the one before that."""
        return self.first[one, target] + self.second[two, target] - self.log_sums[one, two]


class Trainer:
    """Stochastic steps of noise-contrastive estimation, scaled by past gradients."""

    def __init__(self, parameters: Parameters, unigram: np.ndarray, seed: int) -> None:
        self.p = parameters
        self.noise = unigram
        self.log_noise = np.log(unigram * NOISE).astype(np.float32)
        self.draw = np.random.default_rng(seed)
        self.seen = 0
        self.past = [np.full(x.shape, 1e-2, np.float32) for x in self._all()]

    def _all(self) -> list[np.ndarray]:
        return [self.p.context, self.p.target, self.p.positions, self.p.bias]

    def _rows(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        """``values`` added up by row number ``at``."""
        n = len(self.p.bias)
        slots = (at[:, None] * WIDTH + np.arange(WIDTH)).ravel()
        return np.bincount(slots, values.ravel(), n * WIDTH).reshape(n, WIDTH)

    def step(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> None:
        p, n = self.p, len(target)
        self.seen += n
        noise = self.draw.choice(len(self.noise), NOISE, p=self.noise)
        r1, r2, q = p.context[one], p.context[two], p.target[target]
        predicted = r1 * p.positions[0] + r2 * p.positions[1]
        real = np.einsum("ij,ij->i", predicted, q) + p.bias[target] - self.log_noise[target]
        fake = predicted @ p.target[noise].T + (p.bias - self.log_noise)[noise]
        d_real = 1 / (1 + np.exp(np.clip(real, -30, 30)))  # gradient of log sigmoid(real)
        d_fake = -1 / (1 + np.exp(np.clip(-fake, -30, 30)))  # of log sigmoid(-fake)
        d_predicted = d_real[:, None] * q + d_fake @ p.target[noise]
        g_target = self._rows(target, d_real[:, None] * predicted)
        np.add.at(g_target, noise, d_fake.T @ predicted)
        g_bias = np.bincount(target, d_real, len(p.bias))
        np.add.at(g_bias, noise, d_fake.sum(axis=0))
        g_context = self._rows(one, d_predicted * p.positions[0])
        g_context += self._rows(two, d_predicted * p.positions[1])
        g_positions = np.stack([(d_predicted * r1).sum(axis=0), (d_predicted * r2).sum(axis=0)])
        gradients = (g_context, g_target, g_positions, g_bias)
        for values, gradient, past in zip(self._all(), gradients, self.past):
            mean = (gradient / n).astype(np.float32)
            past += mean * mean
            values += RATE * mean / np.sqrt(past)


def _sequence(words: Words, classes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Targets with an end after each row, the two classes before each, and each one's row."""
    lengths = np.diff(words.first) + 1
    ends = np.cumsum(lengths) - 1
    target = np.full(int(lengths.sum()), END)
    inside = np.ones(len(target), bool)
    inside[ends] = False
    target[inside] = classes
    begins = ends - lengths + 1
    one = np.concatenate([[END], target[:-1]])
    one[begins] = END
    two = np.concatenate([[END], one[:-1]])
    two[begins] = END
    return target, one, two, begins


def _count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    found, counts = [], []
    for _, words in slices(batch.column(0), lower=True):
        some, n = np.unique(words.hashes(), return_counts=True)
        found.append(some)
        counts.append(n)
    merged, place = np.unique(np.concatenate(found), return_inverse=True)
    summed = np.bincount(place, np.concatenate(counts), len(merged)).astype(np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(merged.view(np.int64)), pa.array(summed)], names=["word", "n"]
    )


def _train(shared, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, start = shared.value
        parameters = Parameters.unflat(start.copy(), vocabulary.n_classes)
        trainer = Trainer(parameters, vocabulary.unigram, seed)
        for batch in batches:
            for _, words in slices(batch.column(0), lower=True):
                classes = vocabulary.classes_of(*vocabulary.find(words.hashes()))
                target, one, two, _ = _sequence(words, classes)
                for at in range(0, len(target), BATCH):
                    part = slice(at, at + BATCH)
                    trainer.step(one[part], two[part], target[part])
        if trainer.seen:
            blocks = np.array_split(parameters.flat().astype(np.float64) * trainer.seen, BLOCKS)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(BLOCKS), pa.int32()),
                    pa.array([trainer.seen] * BLOCKS, pa.int64()),
                    pa.array([b.tobytes() for b in blocks], pa.binary()),
                ],
                names=["block", "weight", "sums"],
            )

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, list] = {}
    for batch in batches:
        for block, weight, sums in zip(*(c.to_pylist() for c in batch.columns)):
            mine = totals.setdefault(block, [0, 0.0])
            mine[0] += weight
            mine[1] = mine[1] + np.frombuffer(sums)
    if totals:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(totals), pa.int32()),
                pa.array([t[0] for t in totals.values()], pa.int64()),
                pa.array([t[1].tobytes() for t in totals.values()], pa.binary()),
            ],
            names=["block", "weight", "sums"],
        )


def build_vocabulary(counts: DataFrame, training_rows: int) -> Vocabulary:
    """From the ``counts`` (word, n) of all training words; an end per training row is added.

    The driver gets at most ``LOOKUP`` counts.
    """
    totals = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"),
        F.count("*").alias("types"),
        F.count_if(F.col("n") == 1).alias("once"),
        F.count_if(F.col("n") == 2).alias("twice"),
    ).first()
    top = counts.orderBy(F.desc("n"), "word").limit(LOOKUP).collect()
    hashes = np.array([r.word for r in top], np.int64).view(np.uint64)
    numbers = np.array([r.n for r in top], np.int64)
    order = np.argsort(hashes)
    rank = np.arange(len(top))[order]
    classes = np.where(rank < HEAD, rank + 2, OTHER)
    head = numbers[:HEAD]
    other = int(totals.tokens - head.sum())
    once, twice = totals.once, totals.twice
    discount = min(max(once / (once + 2 * twice) if once else 0.0, 0.1), 0.9)
    other_types = totals.types - len(head)
    # after Chao; and so many that none is likelier than a word seen once
    unseen = max(1.0, once, once * once / (2 * max(twice, 1)), discount * other_types / (1 - discount))
    return Vocabulary(
        hashes[order],
        numbers[order],
        classes,
        len(head) + 2,
        np.concatenate([[training_rows, other], head]).astype(np.int64),
        int(totals.tokens) + training_rows,
        totals.types + (training_rows > 0),
        discount,
        other_types,
        unseen,
    )


def train(texts: DataFrame, vocabulary: Vocabulary) -> Parameters:
    """Train on ``texts`` (text, round) in ``ROUNDS`` rounds of mixing."""
    spark = texts.sparkSession
    parameters = Parameters.start(vocabulary)
    schema = "block int, weight long, sums binary"
    for number in range(ROUNDS):
        shared = spark.sparkContext.broadcast((vocabulary, parameters.flat()))
        mine = texts.where(F.col("round") == number).select("text")
        sent = map_all(mine, _train(shared, number), schema)
        rows = map_all(sent.repartition("block"), _add_up, schema).collect()
        if rows:
            rows.sort(key=lambda r: r.block)
            mixed = np.concatenate([np.frombuffer(r.sums) / r.weight for r in rows])
            parameters = Parameters.unflat(mixed, vocabulary.n_classes)
    return parameters


def _inside_other(counts: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """log10 probability, within their class, of words with these training counts."""
    total = max(int(vocabulary.class_counts[OTHER]), 1)
    return np.log10((counts - vocabulary.discount) / total)


def unseen_in_other(vocabulary: Vocabulary) -> float:
    """log10 probability, within their class, of one word without training counts.

    The discounts of all words of the class are shared by the estimated number of unseen words.
    """
    mass = 1.0
    if vocabulary.other_types:
        mass = vocabulary.discount * vocabulary.other_types / int(vocabulary.class_counts[OTHER])
    return float(np.log10(mass / vocabulary.unseen_types))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            vocabulary, flat = shared.value
            if scorer is None:
                scorer = Scorer(Parameters.unflat(flat, vocabulary.n_classes))
                in_other = np.where(
                    vocabulary.classes == OTHER, _inside_other(vocabulary.counts, vocabulary), 0.0
                )
                base = np.log10(vocabulary.counts + 1.0)
            end_base = np.log10(vocabulary.class_counts[END] + 1.0)
            end_known = int(vocabulary.class_counts[END] > 0)
            for first, words in slices(batch.column(2), lower=True):
                at, known = vocabulary.find(words.hashes())
                target, one, two, begins = _sequence(words, vocabulary.classes_of(at, known))
                logs = scorer(one, two, target).astype(np.float64) / np.log(10)
                scores = np.add.reduceat(logs, begins)
                lengths = np.diff(words.first)

                def by_row(values: np.ndarray) -> np.ndarray:
                    return np.bincount(words.row_of(), values, words.rows)

                if len(vocabulary.hashes):
                    scores += by_row(np.where(known, in_other[at], 0.0))
                    bases = by_row(np.where(known, base[at], 0.0)) + end_base
                else:
                    bases = np.full(words.rows, end_base)
                n = words.rows
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        batch.column(1).slice(first, n),
                        pa.array(lengths + 1),
                        pa.array(by_row(known).astype(np.int64) + end_known),
                        pa.array(bases),
                        pa.array(scores),
                    ],
                    names=["doc_id", "text_key", "n_tokens", "n_known", "base", "score"],
                )

    return run


def _rare(shared):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        vocabulary, _ = shared.value
        for first, words in slices(batch.column(2), lower=True):
            hashes = words.hashes()
            _, known = vocabulary.find(hashes)
            rows, rare = words.row_of()[~known], hashes[~known]
            order = np.lexsort((rare, rows))
            rows, rare = rows[order], rare[order]
            new = np.ones(len(rare), bool)
            new[1:] = (rows[1:] != rows[:-1]) | (rare[1:] != rare[:-1])
            begins = np.flatnonzero(new)
            counts = np.diff(np.append(begins, len(rare)))
            at = pa.array(first + rows[begins])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at),
                    batch.column(1).take(at),
                    pa.array(rare[begins].view(np.int64)),
                    pa.array(counts.astype(np.int64)),
                ],
                names=["doc_id", "text_key", "word", "times"],
            )

    return run


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: one in seven, by its number."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def score_documents(documents: DataFrame) -> DataFrame:
    """Train on the documents (doc_id, text) that are not held out, and score all.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams, add one) and
    score, log10 probabilities of whole texts with their end. Words are told by 64 bits of hash.

    A null or empty text is an end alone. Rows without doc_id are training text. Repeated rows all
    stay, count as often as they occur and get one score. Other columns are left out. Without
    training text every word is unseen. No rows give no rows.
    """
    spark = documents.sparkSession
    texts = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("text_key", F.xxhash64("text"))
    training = texts.where(~held_out(F.col("doc_id")))
    counts = settle(
        map_batches(training.select("text"), _count, "word long, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n")),
        "word-counts",
    )
    vocabulary = build_vocabulary(counts, training.count())
    dealt = training.select(
        "text", F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(ROUNDS)).alias("round")
    )
    parameters = train(dealt, vocabulary)
    shared = spark.sparkContext.broadcast((vocabulary, parameters.flat()))
    keyed = texts.select("doc_id", "text_key", "text")
    scored = settle(
        map_all(
            keyed,
            _score(shared),
            "doc_id long, text_key long, n_tokens long, n_known long, base double, score double",
        ),
        "scored",
    )
    total = float(max(int(vocabulary.class_counts[OTHER]), 1))
    inside = F.log10((F.col("n") - vocabulary.discount) / total)
    rare = (
        map_batches(
            keyed, _rare(shared), "doc_id long, text_key long, word long, times long"
        )
        .join(counts.hint("shuffle_hash"), "word", "left")
        .groupBy("doc_id", "text_key")
        .agg(
            F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
            F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("rare_base"),
            F.sum(
                F.col("times") * F.coalesce(inside, F.lit(unseen_in_other(vocabulary)))
            ).alias("rare_score"),
        )
    )
    rows = scored.groupBy("doc_id", "text_key").agg(F.count("*").alias("copies"))
    rare = rare.withColumnsRenamed({"doc_id": "rare_id", "text_key": "rare_key"})
    per_row = rows.join(
        rare,
        F.col("doc_id").eqNullSafe(F.col("rare_id")) & (F.col("text_key") == F.col("rare_key")),
    ).select(
        "rare_id",
        "rare_key",
        (F.col("rare_known") / F.col("copies")).cast("long").alias("rare_known"),
        (F.col("rare_base") / F.col("copies")).alias("rare_base"),
        (F.col("rare_score") / F.col("copies")).alias("rare_score"),
    )
    smoothed = float(np.log10(vocabulary.tokens + vocabulary.types + 1.0))
    joined = scored.join(
        per_row,
        F.col("doc_id").eqNullSafe(F.col("rare_id")) & (F.col("text_key") == F.col("rare_key")),
        "left",
    )
    none = F.lit(0.0)
    return joined.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", none) - F.col("n_tokens") * smoothed).alias(
            "base_score"
        ),
        (F.col("score") + F.coalesce("rare_score", none)).alias("score"),
    )


@query("op8_lm_scoring")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(table(spark, folder, "documents"))
