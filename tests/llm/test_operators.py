"""The operators of the llm folder against brute force, and on rows that are odd in every way."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from relata.llm import (
    bilinear,
    chat,
    components,
    decontaminate,
    jaccard,
    linechunks,
    mixing,
    pages,
    quality,
    sanitise,
    substrings,
    wordarrays,
)
from tests.conftest import rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, words string"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def split_words(text):
    return BLANK.findall(text or "")


def corpus(seed=5):
    """Random texts with copies, near copies, a passage in many texts, and odd rows."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["été", "ÄÖ", "naïve"]
    passage = " ".join(draw.choice(vocabulary) for _ in range(30))
    texts = {}
    for i in range(60):
        n = draw.choice([3, 12, 40, 90])
        lines = [" ".join(draw.choice(vocabulary) for _ in range(max(1, n // 4))) for _ in range(4)]
        if i % 3 == 0:
            lines.insert(draw.randrange(4), passage)
        texts[i] = "\n".join(lines)
    for i in range(60, 75):
        texts[i] = texts[3]
    for i in range(75, 90):
        words = texts[21].split(" ")
        words[draw.randrange(len(words))] = "changed"
        texts[i] = " ".join(words)
    texts |= {90: "", 91: None, 92: " \t\n\x0b ", 93: "one", 94: "a b c d", 95: "a b c d",
              96: "x\x0by\x0cz  x y z x y z", 97: "word " * 9000}
    return texts


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def documents(spark, texts):
    data = [(i, t, "en", None if i % 5 == 0 else f"src{i % 2}", 1, 7, "k", "w") for i, t in texts.items()]
    return spark.createDataFrame(data, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, repeated rows, empty texts."""
    data = [
        (None, None, None, None, None, None, None, None),
        (None, "no number here", None, None, None, 1, "a", "b"),
        (1, None, None, None, None, None, None, None),
        (1, "", "en", "src0", 0, 0, "", ""),
        (2, "same row twice\nand two lines", "en", "src1", 3, 3, "x", "y"),
        (2, "same row twice\nand two lines", "en", "src1", 3, 3, "x", "y"),
    ]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.limit(0)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# words as arrays


def test_words_are_those_of_the_pattern(texts):
    column = pa.array(list(texts.values()), pa.string())
    found = {}
    for first, words in wordarrays.slices(column, most=500):
        for row in range(words.rows):
            span = range(words.first[row], words.first[row + 1])
            found[first + row] = [
                bytes(words.data[words.starts[i] : words.ends[i]]).decode() for i in span
            ]
    assert list(found.values()) == [split_words(t) for t in texts.values()]


def test_hashes_tell_words_apart():
    names = ["a", "aa", "abcdefgh", "abcdefghi", "abcdefghi\0", "b" * 40, "b" * 41]
    (_, words), = wordarrays.slices(pa.array([" ".join(names * 2)]))
    hashes = words.hashes()
    assert len(set(hashes.tolist())) == len(names)
    assert (hashes[: len(names)] == hashes[len(names) :]).all()
    assert not set(hashes.tolist()) & set(words.hashes(1).tolist())


# 1 decontamination


def test_items_are_found_in_passages(spark, documents, texts):
    own = next(i for i in texts if i % 3 and len(split_words(texts[i])) > 60)
    items = [(1, " ".join(split_words(texts[own])[2:38])), (2, " ".join(f"q{i}" for i in range(20)))]
    items = decontaminate.question_and_answer(
        spark.createDataFrame([*items, (3, texts[7] + ". The answer"), (4, None), (None, "x y")],
                              "item_id long, text string"))
    hidden = documents.withColumn(
        "text",
        F.when(F.col("doc_id") == 11, F.concat("text", F.lit(" q0 q1 Q2 q3 q4 q5 q6 q7 q8 q9 q10 q11"
               " q12 q13 q14 q15 q16 other q18 q19"))).otherwise(F.col("text")),
    )
    found = decontaminate.contaminated(hidden, items).collect()
    pairs = {(r.doc_id, r.item_id) for r in found}
    assert (own, 1) in pairs and (11, 2) in pairs
    for doc_id, item_id in pairs:
        if item_id == 1:
            assert len(set(split_words(texts[doc_id])) & set(split_words(texts[own]))) > 15
    assert {d for d, i in pairs if i == 2} == {11}
    assert all(r.score >= decontaminate.SHARE for r in found)


def test_parts_of_a_benchmark_give_what_the_whole_gives(spark, documents, texts, monkeypatch):
    items = spark.createDataFrame(
        [(i, " ".join(split_words(texts[i])), "") for i in range(3, 40, 4)],
        "item_id long, question string, answer string",
    )
    whole = rows(decontaminate.contaminated(documents, items).select("doc_id", "item_id"))
    monkeypatch.setattr(decontaminate, "PART_CHARS", 600)
    assert rows(decontaminate.contaminated(documents, items).select("doc_id", "item_id")) == whole
    assert {(i, i) for i in range(3, 40, 4)} <= set(whole)


def test_decontamination_of_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame([(1, "same row twice and two lines")], "item_id long, text string")
    asked = decontaminate.question_and_answer(items)
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd, asked).collect()] == [(2, 1)]
    assert decontaminate.contaminated(nothing, asked).count() == 0
    assert decontaminate.contaminated(odd, asked.limit(0)).count() == 0


# 2 mixing


def test_margins_meet_their_targets(documents):
    targets = {
        "source": {"src0": 2.0, "src1": 1.0, "absent": 5.0},
        "lang": {"en": 1.0},
        "topic": {"prose": 0.8, "contact": 0.2},
    }
    mixed = mixing.mix(documents.withColumn("source", F.coalesce("source", F.lit("src0"))), targets)
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("probability")).alias("m")).collect()
    mass = {r.source: r.m for r in got}
    assert mass["src0"] == pytest.approx(2 * mass["src1"], rel=1e-6)
    assert mixed.agg(F.max("probability")).first()[0] == pytest.approx(1.0)


def test_unlisted_values_keep_their_share(documents):
    targets = {"source": {"src0": 1.0, "src1": 3.0}, "topic": {"prose": 1.0}}
    mixed = mixing.mix(documents, targets).withColumn("chance", F.col("n_tokens") * F.col("probability"))
    got = {r.source: r for r in mixed.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.sum("chance").alias("m")).collect()}
    tokens, mass = (sum(r[k] for r in got.values()) for k in ("n", "m"))
    assert got[None].m / mass == pytest.approx(got[None].n / tokens)
    assert got["src1"].m == pytest.approx(3 * got["src0"].m)


def test_mixing_of_odd_rows(odd, nothing):
    mixed = mixing.mix(odd, carry=("n", "key"))
    assert mixed.count() == 6 and {"n", "key"} <= set(mixed.columns)
    alone = [r for r in mixed.collect() if r.source == "src0"]  # a cell without tokens
    assert [(r.weight, r.probability, r.sampled) for r in alone] == [(0.0, 0.0, False)]
    twice = [r.sampled for r in mixed.collect() if r.doc_id == 2]
    assert twice[0] == twice[1]
    assert mixing.mix(nothing).count() == 0


# 3 Jaccard join


def shingle_set(text):
    words = [w.encode().lower() for w in split_words(text)]
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_components(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("frequent, block", [(16, 2048), (0, 2048), (1, 4)])
def test_groups_of_near_duplicates(documents, texts, monkeypatch, frequent, block):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)  # 0: every shingle of a prefix is frequent
    monkeypatch.setattr(jaccard, "BLOCK", block)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(documents).collect()}
    assert got == brute_components(texts)


@pytest.mark.parametrize("block", [2048, 16])
def test_chains_of_variants_of_one_text(spark, monkeypatch, block):
    """Variants of which few are similar to any one of them, beside texts that share a passage."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    draw = random.Random(11)
    base = [f"t{i}" for i in range(90)]
    passage = " ".join(f"p{i}" for i in range(40))
    texts = {}
    for i in range(120):
        words = list(base) if i < 40 or not texts else texts[draw.randrange(i)].split(" ")
        for _ in range(draw.choice([1, 1, 2, 3, 4])):
            words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
        texts[i] = " ".join(words)
    for i in range(120, 180):
        texts[i] = passage + " " + " ".join(f"y{draw.randrange(10**6)}" for _ in range(draw.choice([3, 12, 80])))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame).collect()}
    assert got == brute_components(texts)
    assert len({c for _, c in got.values()}) > 30


def test_similar_sets_share_an_index_entry():
    draw = np.random.default_rng(3)
    for n in (2, 3, 4, 7, 20, 60, 200, 900):
        for common in (False, True):
            frequent = np.full(1 << 16, common)
            if n > 4:
                frequent[draw.random(len(frequent)) < 0.5] = not common

            def entries(shingles):
                rare, pairs = jaccard.signatures(shingles, frequent[shingles % np.uint64(len(frequent))])
                return {(1, x) for x in rare.tolist()} | {(2, x) for x in pairs.tolist()}

            for _ in range(20):
                a = np.unique(draw.integers(0, 2**63, n, dtype=np.uint64))
                extra = draw.integers(0, n // 4 + 1)
                gone = draw.integers(0, n // 4 + 1)
                b = np.unique(np.concatenate(
                    [draw.permutation(a)[gone:], draw.integers(0, 2**63, extra, dtype=np.uint64)]))
                both = len(np.intersect1d(a, b))
                if 100 * both >= 75 * (len(a) + len(b) - both) and not np.array_equal(a, b):
                    assert entries(a) & entries(b)
                    group = jaccard.Group(np.array([1, 2]), np.array([1, 2]), np.array([len(a), len(b)]),
                                          [jaccard.parity(a), jaccard.parity(b)], [None, None])
                    assert group.nearness(0)[1] >= both / (len(a) + len(b) - both) and list(group.forest())


def test_near_duplicates_of_odd_rows(odd, nothing):
    got = rows(jaccard.near_duplicates(odd))
    assert got == rows_sorted([(None, 0, None), (None, 1, None), (1, 0, 1), (1, 0, 1), (2, 2, 2), (2, 2, 2)])
    assert jaccard.near_duplicates(nothing).count() == 0


def test_texts_and_prefixes_of_near_duplicates_are_dealt_out_once(documents, texts, monkeypatch):
    """Joins move ids, also where no table is small enough for a broadcast."""
    spark, dealt = documents.sparkSession, []
    store = jaccard.settle

    def watched(df, label):
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        for columns in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", plan):
            if {c.split("#")[0] for c in columns.split(", ")} & {"text", "rare", "bits"}:
                dealt.append((label, columns))
        return store(df, label)

    monkeypatch.setattr(jaccard, "settle", watched)
    monkeypatch.setattr(jaccard, "FREQUENT", 16)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(documents).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == brute_components(texts)
    # maps meet their groups, and no text or prefix is dealt out again
    assert {label for label, _ in dealt} <= {"facts", "proposed"}


def test_near_duplicates_of_repeated_ids(spark):
    """Rows that share a doc_id but not a text keep their own sets."""
    base = [f"w{i}" for i in range(40)]
    other = [f"v{i}" for i in range(40)]
    data = [(5, base), (5, other), (3, other[:-1]), (7, [*base, "z"]), (None, base), (0, base[:2])]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in data], "doc_id long, text string")
    got = rows(jaccard.near_duplicates(frame))
    assert got == rows_sorted(
        [(None, 36, None), (0, 1, 0), (3, 35, 3), (5, 36, 5), (5, 36, 3), (7, 37, 5)]
    )


def rows_sorted(data):
    return sorted(data, key=lambda r: [(v is not None, str(type(v)), v) for v in r])


def test_components_of_a_long_path(spark):
    draw = random.Random(2)
    order = list(range(40))
    draw.shuffle(order)
    links = spark.createDataFrame([*zip(order, order[1:]), (90, 91), (91, 91)], "a long, b long")
    got = {r.node: r.label for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(40)}, 90: 90, 91: 90}
    assert components.components(links.limit(0)).count() == 0


# 4 quality


def brute_quality(text):
    words = split_words(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if split_words(line)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)), len(repeated),
        len(words) < 50 or 100 * len(repeated) > 50 * len(words),
    )


def test_counts_of_the_rules(documents, texts):
    got = by_id(quality.judge(documents))
    for i, text in texts.items():
        r = got[i]
        assert brute_quality(text) == (
            r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed,
        ), i


def test_lines_of_a_host_are_removed(spark):
    body = " ".join(f"w{i}" for i in range(60))
    names = "abcdefghijklmnopqrstuvwxy"  # numbers would be taken for the same line
    data = [(i, f"Share  THIS page 12\n{body} {names[i]}", "host") for i in range(25)]
    data += [(25, "share this page 7\n" * 30, "host"), (26, f"share this page 1\n{body}", "other")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    verdicts = quality.judge(df)
    got = by_id(verdicts)
    assert all(got[i].kept and got[i].removed_words == 4 for i in range(25))
    assert not got[25].kept and got[26].removed_words == 0
    cleaned = by_id(quality.clean(df, verdicts))
    assert cleaned[3].clean_text == f"{body} d" and cleaned[26].clean_text == data[26][1]
    assert set(cleaned) == {*range(25), 26}


def test_quality_of_odd_rows(odd, nothing):
    verdicts = quality.judge(odd)
    assert [r.kept for r in verdicts.collect()] == [False] * 6
    assert quality.judge(nothing).count() == 0
    assert quality.clean(odd, verdicts.withColumn("kept", F.lit(True)), ("n", "words")).count() == 6


# 5 sanitising

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    def luhn(digits):
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0

    def fits(kind, value):
        digits = re.sub("[^0-9]", "", value)
        return {
            "email": True,
            "ip": kind != "ip" or all(int(p) <= 255 for p in value.split(".")),
            "card": 14 <= len(digits) <= 19 and luhn(digits),
            "phone": 10 <= len(digits) <= 15,
        }[kind]

    found = [
        (m.start(), rank, m.end(), kind)
        for rank, (kind, pattern) in enumerate(PATTERNS.items())
        for m in re.finditer(pattern, text or "")
        if fits(kind, m.group())
    ]
    return sorted(found)


def test_base_spans(spark):
    draw = random.Random(8)
    pieces = ["a@b.c", "@", ".", "x.y@", "1.2.3.4", "256.1.1.1", "007.08.9.10", " ", "-", "--", "+1", "+49 (0)30 1234567",
              "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "é", "😀", "", "_", "%", "0", "12",
              "a.b-c@d-e.f..g", "@x.y", "1.2.3.4.5.6.7.8", "\n"]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randrange(1, 14))) for _ in range(400)]
    texts += [None, "", "1 " * 30000, "x@" + "a." * 30000 + "b", "+1" + "." * 20000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = by_id(sanitise.find_personal(df))
    for i, text in enumerate(texts):
        assert [(s.start, s.rank, s.end, s.kind) for s in got[i].found] == brute_spans(text), text


def test_disclosing_words_are_found(spark):
    near = ["Contact Meierhuber at", "ask Meierhuber under", "write Meierhuber via", "from Meierhuber, see"]
    data = [(i, f"{a} m@x.org please, common words number {i}") for i, a in enumerate(near)]
    data += [(i, f"please common words number {i}, nothing else") for i in range(10, 60)]
    data.append((99, "one Meierhuber more"))
    df = spark.createDataFrame(data, "doc_id long, text string")
    found = sanitise.find_personal(df)
    got = by_id(found.withColumn("clean", sanitise.sanitised(F.col("text"), F.col("spans"))))
    assert [(s.kind, s.value) for s in got[0].spans] == [("term", "meierhuber"), ("email", "m@x.org")]
    assert got[0].clean == "Contact <word> at <email> please, common words number 0"
    assert not got[99].spans and not got[10].spans


def test_terms_far_from_the_value_are_found(spark):
    fill = [" ".join(f"filler{k}" for k in range(30)), " ".join(f"other{k}" for k in range(30))]
    data = [(i, f"Dear Lee, case K7 of {i}: {fill[i % 2]} m@x.org {fill[i % 2]} yours, Lee 王") for i in range(4)]
    data += [(i, f"Dear reader, case of {i}: {fill[i % 2]} yours") for i in range(10, 60)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = by_id(sanitise.find_personal(df))
    for i in range(4):
        found = [s.value for s in got[i].spans]
        assert found == ["lee", "k7", "m@x.org", "lee", "王"], found
        assert all(data[i][1][s.start : s.end].lower() == s.value for s in got[i].spans)
    assert not any(got[i].spans for i in range(10, 60))


def test_sanitising_odd_rows(odd, nothing):
    assert [len(r.spans) for r in sanitise.find_personal(odd).collect()] == [0] * 6
    assert sanitise.find_personal(nothing).count() == 0


# 6 repeated passages


def brute_repeats(texts):
    words = {i: split_words(t) for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for at in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][at : at + 13]), i)
    out = {}
    for i, mine in words.items():
        gone = {
            at + k
            for at in range(len(mine) - 12)
            if first[tuple(mine[at : at + 13])] < i
            for k in range(13)
        }
        kept = " ".join(w for at, w in enumerate(mine) if at not in gone)
        out[i] = (len(mine), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_repeated_passages(documents, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(documents).collect()}
    assert got == brute_repeats(texts)


def test_the_cover_aligns_all_offsets():
    cover = set(substrings.COVER)
    for i in range(substrings.PERIOD):
        for j in range(substrings.PERIOD):
            steps = [d for d in range(substrings.PERIOD)
                     if (i + d) % substrings.PERIOD in cover and (j + d) % substrings.PERIOD in cover]
            assert steps and steps[0] + substrings.ANCHOR <= substrings.WINDOW


def test_passages_of_odd_rows(odd, nothing):
    got = sorted((r.n_words, r.n_removed) for r in substrings.remove_repeats(odd).collect())
    assert got == [(0, 0), (0, 0), (0, 0), (3, 0), (6, 0), (6, 0)]
    assert substrings.remove_repeats(nothing).count() == 0


# 7 line chunks


def test_chunks_are_cut_alike_behind_an_insertion():
    draw = random.Random(4)
    lines = [str(draw.random()).encode() for _ in range(300)]
    whole = {tuple(lines[b:e]) for b, e in linechunks.chunks(lines)}
    longer = [b"new", *lines]
    moved = {tuple(longer[b:e]) for b, e in linechunks.chunks(longer)}
    assert len(whole & moved) > 0.9 * len(whole)
    assert [line for b, e in linechunks.chunks(lines) for line in lines[b:e]] == lines


def test_repeated_chunks_go(documents, texts):
    seen, expected = set(), {}
    for i in sorted(texts):
        lines = (texts[i] or "").encode().split(b"\n")
        candidates = {n for n, *_ in linechunks._candidates(lines)}
        kept = []
        for number, (b, e) in enumerate(linechunks.chunks(lines)):
            content = b"\n".join(lines[b:e])
            if number not in candidates or content not in seen:
                kept += lines[b:e]
            if number in candidates:
                seen.add(content)
        expected[i] = b"\n".join(kept).decode()
    got = by_id(linechunks.remove_chunks(documents, ("n", "key")))
    assert {i: r.clean_text for i, r in got.items()} == expected
    assert got[61].clean_text != texts[61] and got[3].n == 7


def brute_runs(texts):
    """Of each text the lines in runs of two or more that stand earlier, by comparing all pairs."""
    split = {i: (t or "").split("\n") for i, t in texts.items()}
    gone = {i: set() for i in texts}
    for i, lines in split.items():
        for j, others in split.items():
            if j > i:
                continue
            for a in range(len(lines)):
                for b in range(len(others) if j < i else a):
                    size = 0
                    while (
                        a + size < len(lines)
                        and b + size < len(others)
                        and (j < i or b + size < a)
                        and lines[a + size] == others[b + size]
                    ):
                        size += 1
                    words = [k for k in range(size) if lines[a + k].strip(" \t\n\x0b\x0c\r")]
                    if len(words) > 1:
                        gone[i] |= set(range(a + words[0], a + words[-1] + 1))
        for k in range(1, len(lines)):
            if k - 1 in gone[i] and not lines[k].strip(" \t\n\x0b\x0c\r"):
                gone[i].add(k)
    return {i: "\n".join(t for k, t in enumerate(lines) if k not in gone[i]) for i, lines in split.items()}


def test_runs_inside_foreign_lines_go(spark, texts):
    draw = random.Random(12)
    shared = [[f"shared {r} {k}" for k in range(draw.choice([2, 3, 5]))] for r in range(8)]
    mixed = dict(texts)
    for i in range(100, 180):
        lines = [f"own {i} {k}" for k in range(draw.randrange(3, 9))]
        run = draw.choice(shared)
        run = run if i % 2 else [x for line in run for x in (line, "")]
        at = draw.randrange(len(lines))
        mixed[i] = "\n".join(lines[:at] + run + lines[at:])
    mixed |= {190: "a\na\na", 191: "b\nb\nb\nb\nb", 192: "c\nd\nc\nd\n\n", 193: "\nc\nd\n"}
    df = spark.createDataFrame(list(mixed.items()), "doc_id long, text string").repartition(3)
    got = {i: r.clean_text for i, r in by_id(linechunks.remove_runs(df)).items()}
    assert got == brute_runs(mixed)
    assert all("own" in got[i] for i in range(100, 180)) and got[193] == ""
    assert sum("shared" in got[i] for i in range(100, 180)) <= 2 * len(shared)


def test_chunks_of_odd_rows(odd, nothing):
    got = linechunks.remove_chunks(odd).collect()
    assert [r.n_removed_lines for r in got] == [0] * 6
    assert linechunks.remove_chunks(nothing, ("lang",)).count() == 0


# 8 language model


def test_model_is_normalised_and_learns(texts):
    counts = np.array([20, 30, 50, 40, 10])
    vocabulary = bilinear.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), 5,
                                     counts, 150, 40, 0.5, 30, 15.0)
    parameters = bilinear.Parameters.start(vocabulary)
    again = bilinear.Parameters.unflat(parameters.flat(), 5)
    assert np.allclose(again.positions, parameters.positions) and np.allclose(again.bias, parameters.bias)
    everything = np.indices((5, 5, 5)).reshape(3, -1)
    draw = np.random.default_rng(1)
    target = draw.integers(0, 5, 20_000)
    target[1:] = np.where(draw.random(19_999) < 0.8, (target[:-1] + 1) % 5, target[1:])
    one, two = np.roll(target, 1), np.roll(target, 2)
    before = bilinear.Scorer(parameters)(one, two, target).mean()
    trainer = bilinear.Trainer(parameters, vocabulary.unigram, 3)
    for at in range(0, 20_000, 500):
        trainer.step(*(x[at : at + 500] for x in (one, two, target)))
    scorer = bilinear.Scorer(parameters)
    assert np.allclose(np.exp(scorer(*everything)).reshape(5, 5, 5).sum(axis=2), 1, atol=1e-4)
    assert scorer(one, two, target).mean() > before + 0.02


@pytest.mark.parametrize("once, twice, more", [(900, 20, 400), (0, 0, 1600), (3, 700, 900), (1500, 0, 0)])
def test_no_unseen_word_is_likelier_than_one_seen_once(spark, once, twice, more):
    numbers = [1] * once + [2] * twice + [9] * more
    counts = spark.createDataFrame(list(enumerate(numbers)), "word long, n long")
    vocabulary = bilinear.build_vocabulary(counts, 50)
    seen = bilinear._inside_other(np.array([1, 2, 9]), vocabulary)
    unseen = bilinear.unseen_in_other(vocabulary)
    assert unseen <= seen[0] + 1e-9
    inside = sorted(numbers, reverse=True)[bilinear.HEAD :]
    known = sum(10.0 ** bilinear._inside_other(np.array(inside), vocabulary))
    assert known + vocabulary.unseen_types * 10.0**unseen == pytest.approx(1)


def test_scores(documents, texts):
    import zlib

    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    tokens = {i: [w.encode().lower() for w in split_words(t)] + [b""] for i, t in texts.items()}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    got = by_id(bilinear.score_documents(documents))
    for i, mine in tokens.items():
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in mine)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[i], len(mine), total)
        assert r.n_known == sum(counts[w] > 0 for w in mine)
        assert r.base_score == pytest.approx(base) and r.score < 0


def test_counts_beyond_the_broadcast_are_joined(documents, monkeypatch):
    whole = {r.doc_id: r for r in bilinear.score_documents(documents).collect()}
    monkeypatch.setattr(bilinear, "LOOKUP", 50)
    monkeypatch.setattr(bilinear, "HEAD", 40)
    for r in bilinear.score_documents(documents).collect():
        assert r.n_known == whole[r.doc_id].n_known
        assert r.base_score == pytest.approx(whole[r.doc_id].base_score)


def test_scores_of_odd_rows(odd, nothing):
    got = bilinear.score_documents(odd).collect()
    assert len(got) == 6 and all(math.isfinite(r.score) for r in got)
    assert len({r.score for r in got if r.doc_id == 2}) == 1
    assert bilinear.score_documents(nothing).count() == 0
    held = odd.where("doc_id = 2").withColumn("doc_id", F.lit(14).cast("long"))
    held = held.where(bilinear.held_out(F.col("doc_id")))
    for r in bilinear.score_documents(held).collect():
        assert (r.train_tokens, r.n_known, r.base_score) == (0, 0, 0.0)


# 9 pages


def page(title, *paragraphs, extra="", tail=""):
    body = "".join(f"<p>{p}" for p in paragraphs)
    return (
        "<html><head><title>T</title><script>if (a > b) '</p>'</script></head><body>"
        f"<nav><ul><li><a href='/{title}'>{title} link</a></ul></nav>{extra}"
        f"<article><h1>{title}</h1>{body}</article>"
        f"<div class='comments'><article><p>a reader says</article></div><footer>&copy; us</footer>{tail}"
    )


def test_main_text_of_pages(spark):
    data = [
        (1, "http://a.org/1", page("One &amp; only", "first  \n text", "<b>bold</b>ly<br>said")),
        (2, "http://a.org/2", page("Two", "", extra="<div class='ad banner'>Buy</div>", tail="</body></html>")),
        (3, "http://b.org/3", "<div id=main-menu>Home</div><div>just <i>this</i></div><form>name</form>tail"),
        (4, None, None),
        (5, "odd", "no markup < at > all &lt;b&gt;"),
        (6, "http://a.org/6", "<article><p>cut <b"),
    ]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {r.page_id: r for r in pages.main_text(df).collect()}
    assert got[1].text == "One & only\nfirst text\nboldly said"
    assert got[2].text == "Two"
    assert got[3].text == "just this\ntail"
    assert (got[4].text, got[4].n_chars) == ("", 0)
    assert got[5].text.startswith("no markup") and got[5].text.endswith("<b>")
    assert got[6].text.startswith("cut")


def test_template_of_a_host(spark):
    def made(i):
        return (
            f"<html><body><div class='top'>Site name</div><div class='story'><div class=by>By Staff</div>"
            f"<p>{' '.join(f'w{i}x{k}' for k in range(40))}</p>" + f"<p>more {i}</p>" * (i % 3) +
            f"</div><div class='box'>see {i}</div></body></html>"
        )

    df = spark.createDataFrame(
        [(i, f"http://h.org/{i}", made(i)) for i in range(30)], "page_id long, url string, html string"
    )
    named = df.select(F.lit("h.org").alias("host"), F.col("page_id").alias("page"), "html")
    found = pages.templates(named).collect()
    assert {r.path for r in found if r.path and r.once} >= {"/html/body", "/html/body/div.story"}
    assert sum(r.run is not None for r in found) == 2
    got = {r.page_id: r.text for r in pages.main_text(df).collect()}
    assert got[4] == " ".join(f"w4x{k}" for k in range(40)) + "\nmore 4"


ROLE_WORDS = [
    ("<body class='has-sidebar'><article><p>kept words</article>", "kept words"),
    ("<article class='post social-share'>kept words</article>", "kept words"),
    ("<main id='search-results'>kept words</main>", "kept words"),
    ("<div class='content-with-comments'><article>kept words</article></div>", "kept words"),
    ("<div class='sidebar'><article>kept words</article></div>", "kept words"),
    ("<article>kept <a class='share'>words</a><p><a class=share>Share</a></p></article>", "kept words"),
    ("<div>kept words</div><div class=comments><article>a much longer comment</article></div>", "kept words"),
    ("<div>kept words</div><div class=sidebar><article>teaser</article></div>", "kept words"),
    ("<article>kept words<div class='comment-list'>a reader</div><div class=ad-container>Buy</div></article>", "kept words"),
    ("<article>kept <b>words</b><span class=ad></article><aside><article>not this one</article></aside>", "kept words"),
]


def test_role_words_hide_what_they_name_only(spark):
    data = [(i, f"http://h{i}.org/", html) for i, (html, _) in enumerate(ROLE_WORDS)]
    data.append((0, data[0][1], data[0][2]))  # a repeated row
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    got = pages.main_text(df).collect()
    assert len(got) == len(data)
    for row in got:
        assert row.text == ROLE_WORDS[row.page_id][1], row.page_id


ODD_PAGES = {
    "unclosed": ("x<a " * 250_000, None),
    "unclosed with quotes": ("<a '\"x" * 200_000, None),
    "declarations": ("<!x" * 300_000, None),
    "scripts": ("<script " * 100_000, None),
    "deep": ("<div>" * 50_000 + "deep", "deep"),
    "deep with text": ("<div class='a long name of a class'>t" * 50_000 + "</x>" * 50_000, "\n".join("t" * 50_000)),
    "inline": ("<b class=ad>" * 50_000 + "</i>" * 50_000 + "x", ""),
    "paragraphs": ("<p>x" * 100_000, "\n".join("x" * 100_000)),
    "hidden articles": ("<div class=ad><article>" * 30_000, ""),
}


@pytest.mark.parametrize("name", ODD_PAGES)
def test_a_long_or_deep_page_takes_seconds(name):
    source, text = ODD_PAGES[name]
    began = time.monotonic()
    page = pages._page(source)
    assert time.monotonic() - began < 5
    assert sum(map(len, page.tree)) <= len(page.tree) * (pages.LONG + 1)
    if text is not None:
        assert "\n".join(filter(None, (pages._spoken(runs) for _, runs in page.blocks))) == text


def test_paths_of_deep_elements_differ():
    page = pages._page("<div class='some words'>" * 300 + "<article>x</article>" + "</div>" * 300)
    assert len(page.tree) == 301 and page.sizes()[""] == 1
    assert page.tree[page.own_main()][1:] == ("article", 301)
    assert len(page.within(page.own_main())) == 1


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert pages.main_text(df).count() == 0


# 10 chat


def test_conversations_round_trip(spark):
    texts = ["plain", "", None, "<|im_end|>", "<\\|im_start|>", "\\", "<\\\\|", "a\nb", "<|<|", "<|im_start|>user\nx"]
    turns = [(c, t, role, text) for c, text in enumerate(texts)
             for t, role in enumerate(["system", "user", "assistant"])]
    turns += [(50, 1, "user", "second"), (50, 0, "assistant", "first"), (50, 0, "assistant", "first"),
              (None, None, None, None), (51, None, "a\nb\\n<|", "t")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    df = df.withColumn("segments", F.lit("clash")).repartition(4)
    done = chat.format_conversations(df)
    whole = done.select(
        "*",
        chat.formatted(F.col("segments")).alias("formatted"),
        chat.under_loss(F.col("segments")).alias("loss"),
    ).withColumn("back", chat.read_back(F.col("formatted")))
    got = {r.conv_id: r for r in whole.collect()}
    for c, text in enumerate(texts):
        assert [tuple(t) for t in got[c].back] == [(r, text or "") for r in ("system", "user", "assistant")]
        assert got[c].valid and got[c].loss == (text or "")
        assert got[c].formatted.count("<|") == 6
    assert [tuple(t) for t in got[50].back] == [("assistant", "first")] * 2 + [("user", "second")]
    assert not got[50].valid and got[50].n_turns == 3 and got[50].loss == "firstfirst"
    assert [tuple(t) for t in got[None].back] == [("", "")]
    assert [tuple(t) for t in got[51].back] == [("a\nb\\n<|", "t")]
    assert chat.format_conversations(df.limit(0)).count() == 0
