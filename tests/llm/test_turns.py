"""Repairs of conversations against all edits of short ones, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from functools import cache

import pytest

from relata.llm.queries import QUERIES
from relata.llm.turns import align, faults, repair, repaired
from tests.conftest import rows

SCHEMA = "conv_id long, turn long, role string, text string, cost string, said string, audit string"


def brute(initials, drop, cut):
    """Least (cost, audit) over all edits into all targets that can be worth it."""
    n = len(initials)
    targets = [""] + [s + "ua" * k for s in ("", "s") for k in range(1, n + 3)]

    def into(goal):
        @cache
        def go(i, j):
            if i == n and j == len(goal):
                return 0, ""
            choices = []
            if i < n:
                choices.append((4, "D", go(i + 1, j)))
            if j < len(goal) and goal[j] != "s":
                choices.append((3, "I", go(i, j + 1)))
            if i < n and j < len(goal) and not drop[i]:
                after = go(i + 1, j + 1)
                if initials[i] == goal[j]:
                    choices.append((3 * cut[i], "K", after))
                if goal[j] != "s":
                    choices.append((3 + 3 * cut[i], "R", after))
            return min(((c + rest, x + audit) for c, x, (rest, audit) in choices), default=(10**6, ""))

        return go(0, 0)

    return min(into(goal) for goal in targets)


def test_alignment_equals_all_edits():
    draw = random.Random(4)
    for _ in range(1500):
        n = draw.randrange(8)
        initials = [draw.choice(["s", "u", "a", "x", ""]) for _ in range(n)]
        drop = [draw.random() < 0.25 for _ in range(n)]
        cut = [not d and draw.random() < 0.3 for d in drop]
        assert align(initials, drop, cut) == brute(initials, drop, cut)


def test_a_long_conversation_keeps_few_rows_of_the_table():
    initials = ["u", "a"] * 5000
    drop = [i % 50 == 7 for i in range(10_000)]
    cost, audit = align(initials, drop, [False] * 10_000)
    assert cost == 200 * (4 + 3) and audit.count("D") == 200 and audit.count("I") + audit.count("R") == 200


def test_first_fault_counts():
    said = [("user", "a."), ("user", " \t"), ("user", "a."), ("user", "b"), ("user", "b"), ("user", " \t"),
            ("user", "c?\x0b"), ("user", "d! ")]
    assert faults(said) == ["", "blank", "duplicate", "truncated", "duplicate", "blank", "", "truncated"]


def test_edits_give_the_turns():
    said = [("system", "s."), ("user", ""), ("assistant", "b."), ("system", "c.")]
    assert repaired(said, "KDIKRI") == [
        ("system", "s."), ("user", ""), ("assistant", "b."), ("user", "c."), ("assistant", "")
    ]


def expected(conversations):
    """The query's rows by conversation, from the rows of the table."""
    out = {}
    for conv in {r[0] for r in conversations}:
        said = []
        for _, turn, role, text in [r for r in conversations if r[0] == conv]:
            role, text = (" " if v is None else v for v in (role, text))
            show = [" " if v is None else str(v) for v in (conv, turn)]
            hit = zlib.crc32(":".join(show).encode()) % 20
            text = "" if hit == 1 else "".join(c for c in text if c not in ".!?") if hit == 2 else text
            said += [(turn, "user" if hit == 4 else role, text)] * {0: 0, 3: 2}.get(hit, 1)
        said.sort(key=lambda s: (s[0] is not None, s))
        turns = [s[1:] for s in said]
        found = faults(turns)
        numbers = {s[0] for s in said if s[0] is not None}
        initials = [role[:1] for role, _ in turns]
        audit = brute(tuple(initials), tuple(f in ("blank", "duplicate") for f in found),
                      tuple(f == "truncated" for f in found))
        after = "\n".join(f"{role}:{text}" for role, text in repaired(turns, audit[1]))
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
            *(found.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            *audit,
            hashlib.sha256(after.encode()).hexdigest(),
        )
    return out


def test_query_equals_brute_force(spark, data):
    table = spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = QUERIES["op12_conversation_repair"](spark, data)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == expected([tuple(r) for r in table.collect()])


def test_query_on_odd_rows(spark, tmp_path):
    draw = random.Random(9)
    data = [
        (draw.choice([None, *range(120)]), draw.choice([None, 0, 1, 2, 3, 4, 9]),
         draw.choice(["system", "user", "assistant", "assistant", "user", "tool", None, "user "]),
         draw.choice(["Yes.", "No!", "cut", "\n", "", None, "é?\x0b"]), "c", "s", "a")
        for _ in range(420)
    ]
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op12_conversation_repair"](spark, str(tmp_path))
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == expected([r[:4] for r in data])


def test_lost_turns_and_empty_tables(spark):
    data = [(1, 0, "user", "a.", "", "", ""), (1, 1, "assistant", "b.", "", "", ""), (2, 5, "user", "x", "", "", "")]
    frame = spark.createDataFrame(data, SCHEMA)
    got = repair(frame, frame.conv_id == 1)
    assert rows(got.drop("turns")) == [(1, 0, 0, 0, 0, 0, 0, "KK"), (2, 0, 0, 0, 0, 0, 0, "")]
    assert rows(repair(frame.limit(0))) == []


def test_a_role_without_letters_cannot_stay(spark):
    data = [(1, 0, "", "a.", "", "", ""), (1, 1, "assistant", "b.", "", "", "")]
    row = repair(spark.createDataFrame(data, SCHEMA)).first()
    assert (row.cost, row.audit) == (3, "RK") and row.turns[0].role == "user"


@pytest.mark.parametrize("n", [400])
def test_one_long_conversation(spark, n):
    data = [(1, i, ("user", "assistant")[i % 2], f"text {i}.", "", "", "") for i in range(n)]
    row = repair(spark.createDataFrame(data, SCHEMA)).first()
    assert (row.cost, row.audit) == (0, "K" * n)
