"""Operator 3: n-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct five-word shingles. Sets are ordered alike: rare shingles
first, then frequent ones, each by hash. Two sets of similarity t share their first common shingle
within the first n - ceil(t n) + 1 shingles of both. A shingle is frequent if more than ``FREQUENT``
sets have it in their prefix by hash. A set whose prefix holds rare shingles only is indexed by
these. Where the prefix reaches frequent shingles it is extended so that partners with no rare
shingle in common share one frequent shingle more than there are buckets; they then share two in one
bucket, and only pairs of frequent shingles of one bucket are indexed.

Groups that share an index entry are not expanded into pairs. Each group, in blocks if it is large,
proposes a spanning forest of its most similar members by maps of parities, which rule pairs out but
not in. Proposals are verified on the whole sets. Where some fail, members of groups that are not
connected propose their nearest ones outside their component, more in every round and none twice.
A group leaves when its members have proposed all whom the maps allow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.llm.arrow import map_all, map_batches, settle, settle_by
from relata.llm.components import components
from relata.llm.registry import query, table
from relata.llm.wordarrays import Words, mix, slices

WIDTH = 5  # words of a shingle
PERCENT = 75  # least similarity
FREQUENT = 128  # sets that have a rare shingle in their prefix by hash, at most
BLOCK = 2048  # members of a group that one block holds, about
NEAREST = FREQUENT  # that a member proposes when forests have failed, 16 times as many every round

U = np.uint64


def shingle_sets(words: Words, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Sorted hashes of each row's distinct shingles; of fewer words, one shingle of all."""
    hashes = words.hashes()
    runs, at = words.windows(hashes, width)
    cuts = np.searchsorted(words.row_of()[at], np.arange(words.rows + 1))
    for row in range(words.rows):
        n = int(words.first[row + 1] - words.first[row])
        if n >= width:
            yield np.unique(runs[cuts[row] : cuts[row + 1]])
        elif n:
            yield mix(words.runs(hashes, words.first[row : row + 1], n) + U(n))
        else:
            yield np.zeros(0, U)


def _key(shingles: np.ndarray) -> int:
    """64 bits of a whole set."""
    return int(np.add.reduce(mix(shingles + U(1))).view(np.int64)) if len(shingles) else 0


def _prefix(n: int) -> int:
    """Length of the prefix in which similar sets share a shingle; a single one has no partner."""
    return n - -(-PERCENT * n // 100) + 1 if n > 1 else 0


def _level(n: int) -> int:
    """The size class: sizes of similar sets differ by one class at most."""
    return int(np.log(n) / np.log(100 / PERCENT) + 1e-9)


def _buckets(level: int) -> int:
    return max(1, int((100 / PERCENT) ** level / 8))


def signatures(shingles: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index entries of a set whose frequent shingles ``common`` marks: rare shingles of its
    prefix, and combinations of two frequent ones."""
    n = len(shingles)
    rare, often = shingles[~common], shingles[common]
    if len(rare) >= _prefix(n):
        return rare[: _prefix(n)], np.zeros(0, U)
    level = _level(n)
    extended = min(n, _prefix(n) + _buckets(level + 1))
    often = often[: extended - len(rare)]
    found = [np.zeros(0, U)]
    for which in (level, level + 1):
        buckets = (often >> U(20)) % U(_buckets(which))
        order = np.argsort(buckets, kind="stable")
        edges = np.flatnonzero(np.diff(buckets[order])) + 1
        for members in np.split(often[order], edges):
            a, b = np.triu_indices(len(members), 1)
            if len(a):
                found.append(mix(mix(members[a] + U(which)) * U(3) + members[b]))
    return rare, np.unique(np.concatenate(found))


def parity(shingles: np.ndarray) -> bytes:
    """A bit per slot, set if an odd number of shingles falls there; a slot per shingle or more.

    Two sets differ in at least as many shingles as such maps differ in bits.
    """
    size = max(64, 1 << (len(shingles) - 1).bit_length()) if len(shingles) else 64
    slots = ((shingles >> U(24)) & U(size - 1)).astype(np.int64)
    odd = (np.bincount(slots, minlength=size) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").tobytes()


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    cuts = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate([np.zeros(0, U), *arrays]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(values))


def _describe(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A row per document, with its text and the prefix of its set by hash."""
    for first, words in slices(batch.column(1), lower=True):
        sets = list(shingle_sets(words))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).slice(first, len(sets)),
                batch.column(1).slice(first, len(sets)),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_key(s) for s in sets], pa.int64()),
                pa.array([parity(s) for s in sets], pa.binary()),
                _lists([s[: _prefix(len(s))] for s in sets]),
            ],
            names=["doc_id", "text", "n", "key", "bits", "rare"],
        )


def _set_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    wanted = batch.column(1).to_pylist()
    for first, words in slices(batch.column(0), lower=True):
        keys, sets = [], []
        for row, shingles in enumerate(shingle_sets(words)):
            if (key := _key(shingles)) == wanted[first + row]:
                keys.append(key)
                sets.append(shingles)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), _lists(sets)], names=["key", "shingles"]
        )


def _signed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The index rows of sets with frequent shingles, from (text, key, often)."""
    often = batch.column(2)
    for first, words in slices(batch.column(0), lower=True):
        keys, rare, pairs = [], [], []
        for row, shingles in enumerate(shingle_sets(words), first):
            if (key := _key(shingles)) == batch.column(1)[row].as_py():
                common = np.isin(shingles, np.asarray(often[row].values).view(U))
                keys.append(key)
                for column, found in zip((rare, pairs), signatures(shingles, common)):
                    column.append(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), _lists(rare), _lists(pairs)], names=["key", "rare", "pairs"]
        )


def _near(m: int, n: int, x: bytes, y: bytes) -> bool:
    """Whether the maps of two sets of ``m`` and ``n`` shingles allow the similarity."""
    if len(x) < len(y):
        x, y = y, x
    p, q, size = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * len(x)
    while size > 8 * len(y):
        size //= 2
        p = (p >> size) ^ (p & ((1 << size) - 1))
    most = min((m + n - (p ^ q).bit_count()) // 2, m, n)
    return 100 * most >= PERCENT * (m + n - most)


def _with_neighbours(sizes: np.ndarray) -> np.ndarray:
    """The members that are not alone with their size."""
    order = np.argsort(sizes, kind="stable")
    close = 100 * sizes[order[:-1]] >= PERCENT * sizes[order[1:]]
    return order[np.append(close, False) | np.append(False, close)]


class Group:
    """Members of one block of a group: which pairs their maps do not rule out, and how near."""

    def __init__(self, keys, labels, sizes, maps, failed):
        self.keys, at = np.unique(keys, return_index=True)
        self.labels, self.sizes = labels[at], sizes[at]
        self.failed = [failed[i] for i in at]
        widths = np.array([len(maps[i]) for i in at])
        self.of_width = {w: np.flatnonzero(widths == w) for w in np.unique(widths)}
        self.maps = {
            w: np.frombuffer(b"".join(maps[i] for i in at[who]), U).reshape(len(who), -1)
            for w, who in self.of_width.items()
        }
        self.row = {w: {int(m): i for i, m in enumerate(who)} for w, who in self.of_width.items()}
        self.widths = widths
        self.folded: dict[tuple[int, int], np.ndarray] = {}

    def _at_width(self, width: int, wanted: int) -> np.ndarray:
        """The maps of ``width`` bytes, halves laid over each other down to ``wanted`` bytes."""
        if width == wanted:
            return self.maps[width]
        if (width, wanted) not in self.folded:
            larger = self._at_width(width, wanted * 2)
            half = larger.shape[1] // 2
            self.folded[width, wanted] = larger[:, :half] ^ larger[:, half:]
        return self.folded[width, wanted]

    def nearness(self, v: int) -> np.ndarray:
        """Of each member the largest similarity to ``v`` that the maps allow, 0 below the limit."""
        out = np.zeros(len(self.keys))
        mine = int(self.widths[v])
        for width, who in self.of_width.items():
            least = min(mine, int(width))
            if max(mine, int(width)) > 2 * least:
                continue  # sizes of similar sets differ by less
            own = self._at_width(mine, least)[self.row[mine][v]]
            apart = np.bitwise_count(self._at_width(int(width), least) ^ own).sum(axis=1, dtype=np.int64)
            total = self.sizes[who] + self.sizes[v]
            most = np.minimum((total - apart) // 2, np.minimum(self.sizes[who], self.sizes[v]))
            near = 100 * most >= PERCENT * (total - most)
            out[who] = np.where(near, most / (total - most), 0)
        if self.failed[v] is not None:
            out[np.isin(self.keys, self.failed[v])] = 0
        return out

    def forest(self) -> Iterator[tuple[int, int, bool]]:
        """Pairs that would connect all members near enough, the most similar first; members of one
        label are connected already."""
        n = len(self.keys)
        done, best, parent = np.zeros(n, bool), np.zeros(n), np.zeros(n, np.int64)
        for start in range(n):
            v = start
            while not done[v]:
                done[v] = True
                near = self.nearness(v)
                near[self.labels == self.labels[v]] = 2
                better = ~done & (near > best)
                best[better], parent[better] = near[better], v
                left = np.where(done, 0, best)
                v = int(left.argmax())
                if left[v] <= 0:
                    break
                if left[v] < 2:
                    yield int(self.keys[parent[v]]), int(self.keys[v]), False

    def nearest(self, most: int) -> Iterator[tuple[int, int, bool]]:
        """For each member the pairs with its ``most`` nearest members of other labels, and whether
        there are more."""
        for v in range(len(self.keys)):
            near = self.nearness(v)
            near[self.labels == self.labels[v]] = 0
            left = int((near > 0).sum())
            for other in np.argsort(-near, kind="stable")[: min(most, left)]:
                yield int(self.keys[v]), int(self.keys[other]), left > most


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, whose rows (entry, i, j, key, label, n, bits, failed, most) follow one another, to the
    pairs (entry, a, b, more) of their forests, or those of each member with its ``most`` nearest."""
    waiting: list[pa.RecordBatch] = []

    def pairs(blocks: pa.Table) -> pa.RecordBatch:
        blocks = blocks.combine_chunks()
        marks = np.stack([blocks[c].to_numpy() for c in ("entry", "i", "j")])
        cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
        keys, labels, sizes, most = (blocks[c].to_numpy() for c in ("key", "label", "n", "most"))
        maps, failed = blocks["bits"].to_pylist(), blocks["failed"].to_pylist()
        found = []
        for first, last in zip([0, *cuts], [*cuts, len(keys)]):
            if last - first == 2:
                x, y = first, first + 1
                apart = labels[x] != labels[y] and int(keys[y]) not in (failed[x] or ())
                near = apart and _near(int(sizes[x]), int(sizes[y]), maps[x], maps[y])
                ends = [(keys[x], keys[y], False)] if near else []
            else:
                # a forest's pairs are never all: the group goes on if one of them fails
                part = slice(first, last)
                part = first + _with_neighbours(sizes[part])
                group = Group(
                    keys[part], labels[part], sizes[part], [maps[i] for i in part], [failed[i] for i in part]
                )
                ends = group.nearest(int(most[first])) if most[first] else group.forest()
            found += [(marks[0][first], min(a, b), max(a, b), more) for a, b, more in ends]
        columns = np.array(found, np.int64).reshape(-1, 4).T
        return pa.RecordBatch.from_arrays(
            [*map(pa.array, columns[:3]), pa.array(columns[3].astype(bool))], names=["entry", "a", "b", "more"]
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(c).to_numpy() for c in range(3)])
        changes = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
        before = waiting[-1].slice(waiting[-1].num_rows - 1) if waiting else None
        fresh = before is not None and any(
            before.column(c)[0].as_py() != marks[c][0] for c in range(3)
        )
        last = int(changes[-1]) if len(changes) else 0
        if last or fresh:
            # all blocks but the last, which the next batch may go on with
            whole = waiting + ([batch.slice(0, last)] if last else [])
            if whole:
                yield pairs(pa.Table.from_batches(whole))
            waiting = []
        waiting.append(batch.slice(last))
    if waiting:
        yield pairs(pa.Table.from_batches(waiting))


def _verified(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    linked = []
    for x, y in zip(batch.column(2), batch.column(3)):
        p, q = np.asarray(x.values), np.asarray(y.values)
        both = len(np.intersect1d(p, q, assume_unique=True))
        linked.append(100 * both >= PERCENT * (len(p) + len(q) - both))
    yield pa.RecordBatch.from_arrays(
        [*batch.columns[:2], pa.array(linked, pa.bool_())], names=["a", "b", "linked"]
    )


def _described(texts: DataFrame) -> DataFrame:
    """What ``_describe`` finds, in buckets of ``home``, which is the doc_id.

    Texts and prefixes are dealt out once; later joins on ``home`` move ids alone. Rows without doc_id
    are dealt by their number. Texts that have no partner, for lack of an id or of shingles, are left out.
    """
    schema = "doc_id long, text string, n long, key long, bits binary, rare array<long>"
    pairs_up = F.col("doc_id").isNotNull() & (F.col("n") > 1)
    rows = map_batches(texts, _describe, schema).select(
        F.coalesce("doc_id", F.monotonically_increasing_id()).alias("home"),
        "doc_id",
        F.when(pairs_up, F.col("text")).alias("text"),
        "n",
        "key",
        "bits",
        "rare",
    )
    return settle_by(rows, "home", "described")


def _with_texts(described: DataFrame, wanted: DataFrame) -> DataFrame:
    """The columns of ``wanted`` (home, key, ...) but home, and the texts of that home."""
    # the numbers meet the texts in their buckets; a sort would be one of the texts
    texts = described.where("text IS NOT NULL").select("home", "text")
    return texts.join(wanted.hint("shuffle_hash"), "home").drop("home")


def _texts_of(described: DataFrame, first: DataFrame, keys: DataFrame) -> DataFrame:
    """(text, key) of ``keys``, the text that ``first`` names for each."""
    involved = first.join(keys, "key").select(F.col("doc_id").alias("home"), "key")
    return _with_texts(described, settle(involved, "involved"))


def _is_of() -> Column:
    """Whether key and of are equal, told in a way that deals no rows out by them: home does that."""
    return F.col("key").bitwiseXOR(F.col("of")) == 0


def _sets(texts: DataFrame) -> DataFrame:
    return map_batches(texts, _set_rows, "key long, shingles array<long>")


def _members(described: DataFrame, first: DataFrame) -> DataFrame:
    """(entry, key) for the sets of each index entry that several sets share.

    Entries of the same sets propose the same pairs, so that one of them stays.
    """
    alone = described.where("doc_id IS NOT NULL AND n > 1").join(
        first.select(F.col("doc_id").alias("home")).hint("shuffle_hash"), "home", "left_semi"
    )
    shingles = alone.select("home", "key", F.explode("rare").alias("entry"))
    counts = shingles.groupBy("entry").agg(F.count("*").alias("m"))
    frequent = settle(counts.where(F.col("m") > FREQUENT).select("entry"), "frequent")
    # sets with a frequent shingle in their prefix take it last
    touched = settle(shingles.join(frequent, "entry").select("home", "key").distinct(), "touched")
    often = settle(
        _sets(_with_texts(described, touched).select("text", "key"))
        .select("key", F.explode("shingles").alias("entry"))
        .join(frequent, "entry")
        .groupBy("key")
        .agg(F.collect_set("entry").alias("often"))
        .join(touched, "key")
        .select("home", "key", "often"),
        "frequent-of-set",
    )
    again = settle(
        map_batches(
            _with_texts(described, often).select("text", "key", "often"),
            _signed,
            "key long, rare array<long>, pairs array<long>",
        ),
        "touched-prefixes",
    )
    untouched = alone.join(
        touched.select("home", F.col("key").alias("of")).hint("shuffle_hash"),
        (alone.home == touched.home) & _is_of(),
        "left_anti",
    )

    def entries(rows: DataFrame, column: str, kind: str) -> DataFrame:
        found = rows.select("key", F.explode(column).alias("entry"))
        return found.select("key", F.xxhash64("entry", F.lit(kind)).alias("entry"))

    rows = entries(untouched, "rare", "one")
    rows = rows.unionByName(entries(again, "rare", "one")).unionByName(entries(again, "pairs", "two"))
    shared = settle(
        rows.groupBy("entry").agg(F.count("*").alias("m")).where("m > 1").select("entry"), "shared"
    )
    members = settle(rows.join(shared.hint("shuffle_hash"), "entry"), "members")
    wide = "decimal(38,0)"
    alike = members.groupBy("entry").agg(
        F.count("*").alias("m"),
        F.sum(F.xxhash64("key").cast(wide)).alias("x"),
        F.sum(F.xxhash64(F.lit(1), "key").cast(wide)).alias("y"),
    )
    one = alike.groupBy("m", "x", "y").agg(F.min("entry").alias("entry"))
    one = settle(one.select("entry"), "groups")
    return settle(members.join(one.hint("shuffle_hash"), "entry"), "members-of-groups")


def _blocks(rows: DataFrame, turn: int) -> DataFrame:
    """Members of open groups (entry, key, label, m, major, outside, ...) dealt to blocks (i, j).

    A group of up to ``BLOCK`` members is one block. In the first two turns the blocks of a larger one
    meet themselves only, which connects most. Then members outside its largest label meet every block.
    """
    number = F.ceil(F.col("m") / BLOCK)
    zero = F.lit(0).cast("long")
    own = F.pmod(F.xxhash64("key", F.lit(min(turn, 2))), number).alias("i")
    if turn < 2:
        return rows.select("*", own, zero.alias("j"))
    columns = F.ceil(F.col("outside") / BLOCK)
    columns = F.when(F.col("m") > BLOCK, columns).otherwise(1)
    own_j = F.pmod(F.xxhash64("key", F.lit(3)), columns).alias("own_j")
    rows = rows.select("*", own, own_j, number.alias("ni"), columns.alias("nj"))
    left = rows.withColumn("j", F.explode(F.sequence(zero, F.col("nj") - 1)))
    others = F.filter(F.sequence(zero, F.col("ni") - 1), lambda x: x != F.col("own_i"))
    right = rows.where("label <> major").withColumnRenamed("i", "own_i")
    right = right.withColumn("i", F.explode(others)).withColumn("j", F.col("own_j")).drop("own_i")
    return left.unionByName(right).drop("own_j", "ni", "nj")


def _most(turn: int) -> Column:
    """How many of its nearest ones a member of a group proposes; 0 for the forest of its block."""
    small = NEAREST * 16 ** (turn - 1) if turn else 0
    large = NEAREST * 16 ** (turn - 2) if turn > 1 else 0
    return F.when(F.col("m") > BLOCK, large).otherwise(small).cast("long")


def _labels(members: DataFrame, facts: DataFrame, first: DataFrame, described: DataFrame) -> DataFrame:
    """(node, label) for the keys that have links: the smallest key of those that links reach."""
    spark = members.sparkSession
    tried = spark.createDataFrame([], "a long, b long, linked boolean")
    sets = spark.createDataFrame([], "key long, shingles array<long>")
    labels = spark.createDataFrame([], "node long, label long")
    labelled, turn = members.withColumn("label", F.col("key")), 0
    while True:
        parts = labelled.groupBy("entry", "label").agg(F.count("*").alias("c"))
        groups = settle(
            parts.groupBy("entry")
            .agg(
                F.sum("c").alias("m"),
                F.max_by("label", "c").alias("major"),
                (F.sum("c") - F.max("c")).alias("outside"),
            )
            .where("outside > 0"),
            "open-groups",
        )
        fails = tried.where("NOT linked")
        fails = fails.unionByName(fails.select(F.col("b").alias("a"), F.col("a").alias("b"), "linked"))
        fails = fails.groupBy(F.col("a").alias("key")).agg(F.collect_list("b").alias("failed"))
        rows = _blocks(labelled.join(groups, "entry"), turn).join(facts, "key").join(fails, "key", "left")
        rows = rows.select(
            "entry", "i", "j", "key", "label", "n", "bits", "failed", _most(turn).alias("most")
        )
        dealt = rows.repartition("entry", "i", "j").sortWithinPartitions("entry", "i", "j")
        proposed = settle(
            map_all(dealt, _propose, "entry long, a long, b long, more boolean"), "proposed"
        )
        ends = proposed.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        ends = ends.join(sets.select("key"), "key", "left_anti")
        fresh = settle(_sets(_texts_of(described, first, ends)), "sets")
        sets = sets.unionByName(fresh) if turn else fresh
        left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("x"))
        right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
        both = proposed.select("a", "b").distinct().join(left, "a").join(right, "b")
        found = settle(
            map_batches(both.select("a", "b", "x", "y"), _verified, "a long, b long, linked boolean"), "found"
        )
        links = found.where("linked").select("a", "b")
        if not links.isEmpty():
            # labels stand for the links of earlier turns
            links = links.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
            labels = settle(components(links), "labels")
        # A forest that fails goes on, as do members who have more to propose, and groups whose blocks
        # have not met each other yet.
        failed = found.where("NOT linked").select("a", "b")
        again = proposed.where("more").select("entry")
        again = again.unionByName(
            proposed.join(groups.where(_most(turn) == 0), "entry").join(failed, ["a", "b"]).select("entry")
        )
        if turn < 2:
            again = again.unionByName(groups.where(F.col("m") > BLOCK).select("entry"))
        again = settle(again.distinct(), "again")
        if again.isEmpty():
            return labels
        tried = settle(tried.unionByName(found), "tried") if turn else found
        members = settle(members.join(again, "entry", "left_semi"), "members-left")
        labelled = settle(
            members.join(labels.withColumnRenamed("node", "key"), "key", "left").select(
                "entry", "key", F.coalesce("label", "key").alias("label")
            ),
            "labelled",
        )
        turn += 1


def near_duplicates(documents: DataFrame) -> DataFrame:
    """The group of near duplicates of each row of ``documents`` (doc_id, text).

    Returns doc_id, n_shingles and component_id, the smallest doc_id that links reach. Two
    documents link if 75 % of their united shingles are common to both. Equal sets are compared
    once, by their smallest doc_id, and are told by 64 bits of hash and their size.

    A null or empty text has no shingles and links with nothing. Rows without doc_id get a null
    component. Repeated rows all stay. Other columns are left out. No rows give no rows.
    """
    texts = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    described = _described(texts)
    sets = described.select("doc_id", "n", "key")
    real = sets.where("doc_id IS NOT NULL AND n > 0")
    first = settle(
        real.groupBy("key", "n").agg(F.min("doc_id").alias("doc_id")), "first-of-set"
    )
    members = _members(described, first)
    keys = settle(members.select("key").distinct(), "keys-in-groups")
    theirs = first.join(keys, "key").select(F.col("doc_id").alias("home"), F.col("key").alias("of"))
    facts = settle(
        described.select("home", "doc_id", "key", "n", "bits")
        .where("doc_id IS NOT NULL")
        .join(settle(theirs, "homes").hint("shuffle_hash"), "home")
        .where(_is_of())
        .select("key", "n", "bits")
        .dropDuplicates(["key"]),
        "facts",
    )
    labels = _labels(members, facts, first, described)
    smallest = (
        first.join(labels, first.key == labels.node)
        .select(F.col("key"), "label", F.col("doc_id").alias("first_id"))
    )
    ids = smallest.groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_key = settle(smallest.join(ids, "label").select("key", "component_id"), "component-of-set")
    whole = first.join(by_key, "key", "left").select(
        "key", F.col("n").alias("size"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
    return (
        sets.join(settle(whole, "component"), "key", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") == 0, F.col("doc_id"))
            .when(F.col("doc_id").isNotNull(), F.col("component_id"))
            .alias("component_id"),
        )
    )


@query("op3_ngram_jaccard_join")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))
