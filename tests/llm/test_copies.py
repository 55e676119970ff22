"""Exact copies against brute force, with hashes that collide and odd rows."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from relata.llm.copies import exact_copies, without_copies
from tests.conftest import rows

SCHEMA = "doc_id long, text string, keep_id string, best string, bare string, key string, n int"


def frame(spark, data):
    return spark.createDataFrame([(i, t, "x", "y", "z", "k", 1) for i, t in data], SCHEMA).repartition(3)


def brute(data):
    groups = {}
    for i, text in data:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((i, len(text or "")))
    out = []
    for bare, members in groups.items():
        best = min((-n, i is None, i or 0) for i, n in members)
        keep = None if best[1] else best[2]
        out += [
            (i, n, keep, len(members), (-n, i is None, i or 0) == best,
             hashlib.sha256(bare.encode()).hexdigest())
            for i, n in members
        ]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def data():
    draw = random.Random(3)
    base = ["".join(draw.choice("ab é\n\x0b𝄞 ") for _ in range(draw.randrange(9))) for _ in range(300)]
    odd = [(None, None), (None, ""), (None, "long   blanks"), (7, None), (7, " \t"), (-5, "a a"), (-5, "aa"),
           (2**63 - 1, "edge"), (-(2**63), "ed ge"), (400, "x" * 200_000), (401, "x" * 200_000 + " "),
           (402, "ein\x1cs"), (403, "eins"), (404, " "), (7, " \t")]
    return list(enumerate(base)) + odd


@pytest.mark.parametrize(
    "digest", [F.md5, lambda c: F.length(c).cast("string"), lambda c: F.lit("one")], ids=["md5", "length", "one"]
)
def test_copies_equal_brute_force_whatever_collides(spark, data, digest):
    got = sorted((tuple(r) for r in exact_copies(frame(spark, data), digest).collect()), key=str)
    assert got == brute(data)


def test_one_of_each_text_stays_with_its_columns(spark, data):
    frame_ = frame(spark, data)
    got = without_copies(frame_)
    assert got.columns == frame_.columns
    expected = {(r[0], r[1], r[5]) for r in brute(data) if r[4]}
    bare = [(r.doc_id, len(r.text or ""), hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", r.text or "").encode()).hexdigest())
            for r in got.collect()]
    assert set(bare) == expected
    assert len({digest for _, _, digest in bare}) == len({r[5] for r in brute(data)})


def test_an_empty_table_gives_no_rows(spark):
    assert rows(exact_copies(frame(spark, []))) == []


def test_copies_merge_before_the_shuffle(spark, data):
    hot = frame(spark, [(i, "the same text") for i in range(3000)])
    got = exact_copies(hot).groupBy("keep_id", "group_size", "kept").count()
    assert rows(got) == [(0, 3000, False, 2999), (0, 3000, True, 1)]
