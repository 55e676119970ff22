"""Operator 12: repair of the order of turns by alignment to the alternating grammar.

A sound conversation is empty, or a system turn or none and then user and assistant in turn, at
least once. Its turns are aligned to the grammar's string of every feasible length at once: seen
from the end all lengths share one Wagner-Fischer table, whose cell (i, r) is the least cost to turn
the rows from ``i`` on into the last ``r`` letters. The cost of a greedy repair, the incumbent,
bounds the deletions and insertions, so only Ukkonen's band of diagonals is filled. The audits of
all cheapest lengths are traced back letter by letter together, and the least goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.llm.arrow import map_batches
from relata.llm.registry import query, table

DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3  # costs; CUT is that of a truncated turn that stays
NEVER = np.int32(1 << 28)
SPACE = " \t\n\x0b\x0c\r"
SOUND_PAIRS = ("su", "ua", "au")
ROLES = ("user", "assistant")  # by the parity of the letters left


class Band:
    """The alignment table of one conversation inside the band that ``most`` cost allows.

    A row is indexed by the letters left less the rows left, plus ``low``. Every ``step``-th row is
    kept, the others are filled again when the trace needs them, so memory grows with the band times
    the root of the number of turns.
    """

    def __init__(self, initials: list[str], drop: list[bool], cut: list[bool], most: int):
        self.initials, self.drop, self.cut = initials, drop, cut
        self.n = len(initials)
        self.low = most // DELETE
        self.at = np.arange(self.low + most // INSERT + 1)
        self.slope = (INSERT * self.at).astype(np.int32)
        self.step = max(1, int(self.n**0.5))
        last = np.where(self.at < self.low, NEVER, self.slope - INSERT * self.low).astype(np.int32)
        self.kept = {self.n: last}
        self.told = [int(NEVER)] * (self.n + 1)  # cost from a row on, the system turn still to come
        row = last
        for i in range(self.n - 1, -1, -1):
            self.told[i] = min(self.told[i + 1] + DELETE, self._as_system(i, row))
            row = self._above(i, row)
            if i % self.step == 0:
                self.kept[i] = row
        self.filled: dict[int, np.ndarray] = {}

    def left(self, i: int) -> np.ndarray:
        """Letters left at each place of row ``i``."""
        return self.at - self.low + self.n - i

    def fits(self, i: int, left: np.ndarray) -> np.ndarray:
        """Where row ``i`` has the letter's role: user before an even number, else assistant."""
        even = left % 2 == 0
        return even if self.initials[i] == "u" else ~even if self.initials[i] == "a" else even & ~even

    def _pairs(self, i: int, below: np.ndarray) -> np.ndarray:
        """Where the letters left after row ``i`` are user and assistant pairs, one at least."""
        left = self.left(i + 1)
        return (left >= 2) & (left % 2 == 0) & (below < NEVER)

    def _as_system(self, i: int, below: np.ndarray) -> int:
        if self.initials[i] != "s" or self.drop[i] or not (where := self._pairs(i, below)).any():
            return int(NEVER)
        return int(below[where].min()) + CUT * self.cut[i]

    def _above(self, i: int, below: np.ndarray) -> np.ndarray:
        left = self.left(i)
        row = np.full(len(below), NEVER, np.int32)
        row[:-1] = below[1:] + DELETE
        if not self.drop[i]:
            use = below + np.where(self.fits(i, left), 0, REROLE) + CUT * self.cut[i]
            row = np.minimum(row, np.where(left > 0, use, NEVER))
        row = np.minimum.accumulate(np.where(left >= 0, row, NEVER) - self.slope) + self.slope
        return np.where(left >= 0, np.minimum(row, NEVER), NEVER).astype(np.int32)

    def row(self, i: int) -> np.ndarray:
        if i in self.kept:
            return self.kept[i]
        if i not in self.filled:
            end = min(self.n, (i // self.step + 1) * self.step)
            row, self.filled = self.kept[end], {}
            for k in range(end - 1, i - 1, -1):
                self.filled[k] = row = self._above(k, row)
        return self.filled[i]

    def cheapest(self) -> int:
        first, left = self.row(0), self.left(0)
        whole = first[(left >= 0) & (left % 2 == 0)]
        return min(int(whole.min(initial=NEVER)), self.told[0])

    def audit(self) -> tuple[int, str]:
        """The least cost and, of the edits that reach it, the initials that sort first."""
        cost = rest = self.cheapest()
        left = self.left(0)
        alive = np.flatnonzero((self.row(0) == rest) & (left >= 0) & (left % 2 == 0))
        system = self.told[0] == rest  # the system turn may still come
        letters, i = [], 0
        while i < self.n or rest:
            here = self.row(i)
            more = i < self.n
            if more:
                below = self.row(i + 1)
                inside = alive[alive + 1 < len(here)]
                gone = inside[below[inside + 1] + DELETE == rest] + 1
                system_gone = system and self.told[i + 1] + DELETE == rest
                if len(gone) or system_gone:
                    alive, system, i, rest = gone, system_gone, i + 1, rest - DELETE
                    letters.append("D")
                    continue
            inside = alive[alive > 0]
            put = inside[(here[inside - 1] + INSERT == rest) & (self.left(i)[inside] > 0)] - 1
            if len(put):
                alive, system, rest = put, False, rest - INSERT
                letters.append("I")
                continue
            left = self.left(i)[alive]
            extra = CUT * self.cut[i]
            fit = self.fits(i, left)
            keep = alive[(left > 0) & fit & (below[alive] + extra == rest)]
            if system and self.initials[i] == "s" and not self.drop[i]:
                begun = np.flatnonzero(self._pairs(i, below) & (below + extra == rest))
                keep = np.union1d(keep, begun)
            if len(keep):
                alive, rest = keep, rest - extra
                letters.append("K")
            else:
                alive = alive[(left > 0) & ~fit & (below[alive] + extra + REROLE == rest)]
                rest -= extra + REROLE
                letters.append("R")
            system, i = False, i + 1
        return cost, "".join(letters)


def incumbent(initials: list[str], drop: list[bool], cut: list[bool]) -> int:
    """The cost of a simple repair: what breaks the order gets the role it should have."""
    cost, turn, placed = 0, 0, 0
    for initial, gone, short in zip(initials, drop, cut):
        if gone:
            cost += DELETE
            continue
        cost += CUT * short
        if not (initial == "s" and not placed):
            cost += REROLE * (initial != "ua"[turn])
            turn ^= 1
        placed += 1
    if turn:
        cost += INSERT
    elif placed == 1:
        cost += 2 * INSERT
    return min(cost, DELETE * len(initials))


def align(initials: list[str], drop: list[bool], cut: list[bool]) -> tuple[int, str]:
    """Cost and audit (D, I, K, R in order) of the cheapest repair; ties go to the least audit.

    ``drop`` marks turns that have to go, ``cut`` truncated ones.
    """
    return Band(initials, drop, cut, incumbent(initials, drop, cut)).audit()


def faults(said: list[tuple[str, str]]) -> list[str]:
    """The first fault of each turn (role, text): blank, duplicate, truncated, or ''."""
    seen, found = set(), []
    for turn in said:
        bare = turn[1].strip(SPACE)
        if not bare:
            found.append("blank")
        elif turn in seen:
            found.append("duplicate")
        else:
            found.append("" if bare[-1] in ".!?" else "truncated")
        seen.add(turn)
    return found


def repaired(said: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The turns after the edits of ``audit``."""
    left = len(audit) - audit.count("D")
    out, rows = [], iter(said)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter != "D":
            out.append((role if letter == "K" else ROLES[left % 2], text))
            left -= 1
    return out


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "turns"]


def _repair(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    columns: list[list] = [[] for _ in NAMES[1:]]
    for said in batch.column(1):
        rows = [(t["turn"], t["role"], t["text"]) for t in said.as_py()]
        turns = [(role, text) for _, role, text in rows]
        numbers = {turn for turn, _, _ in rows if turn is not None}
        found = faults(turns)
        initials = [role[:1] for role, _ in turns]
        pairs = [a + b for a, b in zip(initials, initials[1:])]
        cost, audit = align(
            initials, [f in ("blank", "duplicate") for f in found], [f == "truncated" for f in found]
        )
        values = (
            max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
            *(found.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in SOUND_PAIRS for p in pairs),
            cost,
            audit,
            [{"role": role, "text": text} for role, text in repaired(turns, audit)],
        )
        for column, value in zip(columns, values):
            column.append(value)
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    kinds = [pa.int64()] * 6 + [pa.string(), turn]
    yield pa.RecordBatch.from_arrays(
        [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=NAMES
    )


def repair(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text).

    Returns conv_id; gaps in the numbering; the numbers of blank, duplicate and truncated turns; the
    neighbours whose role initials may not follow each other (illegal); cost and audit of the
    cheapest edits; and turns, the repaired conversation as an array of (role, text). Turns where
    ``present`` is false only tell that there is such a conversation.

    A null or empty role and a null text count as one blank. Turns are ordered by turn, nulls first,
    then by role and text. A turn that repeats an earlier one's role and text is a duplicate. A null
    conv_id is a conversation of its own; one without turns is sound. Other columns are left out. No
    rows give no rows. A conversation is one row, so its length is bounded by a row's; the alignment
    takes time in turns times cost, and memory in the cost times the root of the turns.
    """
    said = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.nullif("role", F.lit("")), F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    there = said if present is None else F.when(present, said)
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(there)).alias("said"))
    kind = dict(turns.dtypes)["conv_id"]
    longs = ", ".join(f"{name} long" for name in NAMES[1:7])
    schema = f"conv_id {kind}, {longs}, audit string, turns array<struct<role:string,text:string>>"
    return map_batches(whole, _repair, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with faults put in by a checksum of their place; ``present`` is false where one is lost."""
    text = F.coalesce("text", F.lit(" "))
    blank = F.lit(" ")
    place = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), blank),
        F.lit(":"),
        F.coalesce(F.col("turn").cast("string"), blank),
    )
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", blank).alias("role"), text.alias("text"),
        (F.crc32(place) % 20).alias("hit"),
    )
    hit = F.col("hit")
    changed = (
        F.when(hit == 1, F.lit("")).when(hit == 2, F.regexp_replace("text", "[.!?]", ""))
    ).otherwise(F.col("text"))
    times = F.when(hit == 3, F.lit(2)).otherwise(F.lit(1))
    return rows.select(
        "conv_id",
        "turn",
        F.when(hit == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        changed.alias("text"),
        (hit != 0).alias("present"),
        F.explode(F.sequence(F.lit(1), times)).alias("copy"),
    ).drop("copy")


@query("op12_conversation_repair")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    found = repair(damaged(table(spark, folder, "conversations")), F.col("present"))
    spelled = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return found.select(
        *NAMES[:-1], F.sha2(F.array_join(spelled, "\n"), 256).alias("repaired_sha256")
    )
