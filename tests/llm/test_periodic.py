"""Periodic runs against brute force over all periods, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np

from relata.llm.periodic import _exact, find_runs, periodic_runs, with_repeats
from relata.llm.queries import QUERIES
from tests.conftest import rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, runs string, period string, words string, h long, start int"


def brute(words, least=4):
    """(start, end, smallest period) of stretches with ``least`` periods, by trying each period."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, 4 * q):
                found.setdefault((start, i + q), q)
            i += 1
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def spoken(draw, n):
    words = [draw.choice(["a", "b", "c", "été", "dd"][: draw.choice([1, 2, 3, 5])]) for _ in range(n)]
    for _ in range(draw.randrange(4)):
        if n > 8:
            start = draw.randrange(n)
            q = 1 + draw.randrange((n - start) // 4 + 1)
            for i in range(start + q, min(n, start + q * draw.choice([3, 4, 5, 9, 40]) + draw.randrange(q))):
                words[i] = words[i - q]
    return words


def test_runs_equal_brute_force():
    draw = random.Random(8)
    for _ in range(800):
        words = spoken(draw, draw.choice([0, 1, 4, 5, 9, 30, 120, 300]))
        assert [tuple(r) for r in _exact([w.encode() for w in words]).tolist()] == brute(words)


def test_nested_runs_of_periods_of_all_sizes():
    inner = ["x", "y"] * 40 + ["z"]
    words = ["p"] + inner * 9 + ["q"]
    assert [tuple(r) for r in _exact([w.encode() for w in words]).tolist()] == brute(words)
    assert (1, 730, 81) in brute(words)


def test_runs_do_not_cross_texts():
    """Texts of one word end in different marks."""
    words = np.array([5, 5, 5, 901, 5, 5, 5, 5, 902, 903, 5, 904], np.uint64)
    text_of = np.array([0, 0, 0, 0, 1, 1, 1, 1, 1, 2, 3, 3])
    assert find_runs(words, text_of).tolist() == [[4, 8, 1]]


def test_a_long_text_takes_little_more_than_its_length():
    words = [b"w%d" % (i % 997) for i in range(400_000)]
    begun = time.time()
    assert _exact(words).tolist() == [[0, 400_000, 997]]
    assert time.time() - begun < 20


def expected(texts):
    out = []
    for doc_id, text in texts:
        words = WORD.findall(text or "")
        n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
        if n and h is not None and h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = [(s, e - s, q) for s, e, q in brute(words, 6)]
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        collapsed = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((
            doc_id, len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2],
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed.encode()).hexdigest(), n,
        ))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark, data):
    texts = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op13_periodic_runs"](spark, data)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected([tuple(t) for t in texts])


def test_query_on_odd_rows(spark, tmp_path):
    draw = random.Random(2)
    texts = [(i, draw.choice([" ", "\n", "\x0b\t"]).join(spoken(draw, draw.randrange(90)))) for i in range(400)]
    texts += [(None, None), (None, "a a a a a a"), (3, ""), (10, " \t\x0c"), (None, "a a a a a a"), (-8, "b " * 300),
              (8, "a\x1cb " * 9), (9, "x  y " * 7), (12, None), (13, "z " * 30_000)]
    frame = spark.createDataFrame([(i, t, "r", "p", "w", 1, 2) for i, t in texts], SCHEMA)
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    short = [t for t in texts if t[0] != 13]
    assert sorted((tuple(r) for r in got.where("doc_id <=> 13 IS FALSE").collect()), key=str) == sorted(
        [r for r in expected(short) if r[0] != 13], key=str
    )
    assert got.where("doc_id = 13").first()["n_words"] == 30_000


def test_operator_gives_runs_and_text(spark):
    frame = spark.createDataFrame([(1, "so so so so so so it  goes")], "doc_id long, text string")
    row = periodic_runs(frame).first()
    assert [tuple(r) for r in row.runs] == [(0, 6, 1)] and row.collapsed == "so it goes" and row.n_words == 8
    assert rows(periodic_runs(frame.limit(0))) == [] and rows(with_repeats(frame.limit(0))) == []
