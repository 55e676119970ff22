"""Groups as nested collections ("bags"), in parts of bounded size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relata.operators.numbering import attach, running_totals

#: Rows of a group that a task may hold at once, unless a part alone has more.
WHOLE_ROWS = 16_000
#: Parts of a group that may be cut from one row.
WHOLE_PARTS = 16
#: Rows of a task that gathers or sorts members, up to as many tasks as a shuffle writes files for
#: without sorting rows in memory, and the rows of a task beyond that number.
TASK_ROWS, FILES, MOST_ROWS = 50_000, 200, 1_000_000
#: Numbers that groups are counted under.
SLOTS = 1 << 16


def bags(
    df: DataFrame,
    by: Sequence[str],
    members: Sequence[str],
    order: Sequence[str],
    *,
    part_size: int,
    bag: str = "bag",
    totals: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Each group as rows ``by..., part, n_members, bag, totals...`` of up to ``part_size`` members.

    Members are structs of the ``members`` columns, sorted by ``order`` and then by themselves. The
    parts of a group, put together in their order, are the whole group; every part but the last is
    full. ``n_members`` is the size of the whole group, ``totals`` are aggregates over it.

    Groups of a bounded size are gathered whole by one shuffle and cut. Of larger ones, equal rows
    are counted, sorted into places over all tasks, and gathered by group and part. So no row holds
    more than ``WHOLE_PARTS`` parts and no task a group without bound; choose a part size whose
    members fit into one row. Which groups may be large is found by counting rows under a hash of
    their keys. The number of tasks follows from the number of rows, see :func:`tasks_for`. ``df``
    is read twice or more; the counts, and the sorted places, whose numbers must hold in every later
    stage, are made while the plan is built.
    """
    totals = dict(totals or {})
    # a member that is a key is the same for the whole group
    places = [p for p in dict.fromkeys([*order, *members]) if p not in by]
    slot = F.pmod(F.xxhash64(*by), F.lit(SLOTS))
    limit = max(part_size, min(WHOLE_PARTS * part_size, WHOLE_ROWS))
    full = F.col("ct") > limit
    found = (
        df.groupBy(slot.alias("slot"))
        .agg(F.count("*").alias("ct"))
        .agg(
            F.sum("ct").alias("n"),
            F.sum(F.when(full, F.col("ct"))).alias("n_full"),
            F.collect_list(F.when(full, F.col("slot"))).alias("slots"),
        )
        .head()
    )
    n, n_full = found["n"] or 0, found["n_full"] or 0
    if not n_full:
        return _whole(df, by, members, places, bag, part_size, totals, tasks_for(n))
    large = slot.isin(found["slots"])
    rows = df.filter(large)
    parts = _parts(rows.select(*by, *places), by, members, places, bag, part_size, tasks_for(n_full))
    if totals:
        figures = rows.groupBy(*by).agg(*[c.alias(name) for name, c in totals.items()])
        parts = attach(parts, figures, by)
    if n_full == n:
        return parts
    whole = _whole(
        df.filter(~large), by, members, places, bag, part_size, totals, tasks_for(n - n_full)
    )
    return whole.unionByName(parts)


def tasks_for(n_rows: int) -> int:
    """Tasks for so many rows, of ``TASK_ROWS`` rows while they are few, at most ``MOST_ROWS``.

    Named in a repartition, the number holds: adaptive execution would put rows together until a
    task's memory is in proportion to the whole table.
    """
    return max(1, min(FILES, -(-n_rows // TASK_ROWS)), -(-n_rows // MOST_ROWS))


def _member(record: Column, members: Sequence[str], by: Sequence[str]) -> Column:
    return F.struct(*[(F.col(m) if m in by else record[m]).alias(m) for m in members])


def _whole(
    rows: DataFrame,
    by: Sequence[str],
    members: Sequence[str],
    places: Sequence[str],
    bag: str,
    part_size: int,
    totals: Mapping[str, Column],
    tasks: int,
) -> DataFrame:
    """Each group is gathered by one task, with its totals, and cut into its parts."""
    place = F.struct(*places) if places else F.struct(F.lit(1).alias("__copies"))
    gathered = (
        rows.repartition(tasks, *by)
        .groupBy(*by)
        .agg(
            F.count("*").alias("n_members"),
            F.sort_array(F.collect_list(place)).alias("__list"),
            *[c.alias(name) for name, c in totals.items()],
        )
    )
    last = F.expr(f"cast((n_members - 1) div {part_size} as int)")
    cuts = F.transform(
        F.sequence(F.lit(0), last), lambda p: F.slice("__list", p * part_size + 1, F.lit(part_size))
    )
    listed = gathered.select(
        *by, "n_members", *totals, F.posexplode(cuts).alias("__part", "__cut")
    )
    return listed.select(
        *by,
        F.col("__part").cast("bigint").alias("part"),
        "n_members",
        F.transform("__cut", lambda r: _member(r, members, by)).alias(bag),
        *totals,
    )


def _parts(
    rows: DataFrame,
    by: Sequence[str],
    members: Sequence[str],
    places: Sequence[str],
    bag: str,
    part_size: int,
    tasks: int,
) -> DataFrame:
    """Each distinct member goes to the parts its copies reach, with their number in that part."""
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("__ct"))
    order = [F.col(p).asc_nulls_first() for p in places]
    placed = running_totals(counted, by, order, {"__n": F.col("__ct")}, tasks)
    reached = F.sequence(
        F.expr(f"__n_before div {part_size}"), F.expr(f"(__n_before + __ct - 1) div {part_size}")
    )
    pieces = placed.select("*", F.explode(reached).alias("part"))
    start, stop = F.col("part") * part_size, (F.col("part") + 1) * part_size
    copies = F.least(stop, F.col("__n_before") + F.col("__ct")) - F.greatest(
        start, F.col("__n_before")
    )
    # the parts of one group are dealt out again: their rows may still share a partition
    listed = (
        pieces.withColumn("__copies", copies.cast("int"))
        .repartition(tasks, *by, "part")
        .groupBy(*by, "part")
        .agg(
            F.max("__n_total").alias("n_members"),
            F.sort_array(F.collect_list(F.struct(*places, "__copies"))).alias("__list"),
        )
    )
    repeated = F.flatten(
        F.transform("__list", lambda r: F.array_repeat(_member(r, members, by), r["__copies"]))
    )
    return listed.select(*by, "part", "n_members", repeated.alias(bag))


def flat_text(separator: str, *fields: Column | str) -> Column:
    """Fields as one text, nulls as empty text, so that every field keeps its place."""
    columns = [F.col(f) if isinstance(f, str) else f for f in fields]
    return F.concat_ws(separator, *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


def delimited(bag: Column | str, separator: str, *fields: str) -> Column:
    """A bag as text: the fields of every member joined flat."""
    column = F.col(bag) if isinstance(bag, str) else bag
    texts = F.transform(column, lambda m: flat_text(separator, *[m[f] for f in fields]))
    return F.array_join(texts, separator)


def bag_text(
    df: DataFrame,
    by: Sequence[str],
    text: Column,
    order: Sequence[Column],
    separator: str,
    *,
    part_size: int,
    name: str = "members",
    totals: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Each group's texts joined in order, null as empty text, in parts as in :func:`bags`:
    ``by..., part, n_members, name, totals...``.

    ``order`` may be descending by giving negated numbers.
    """
    places = [f"__o{i}" for i in range(len(order))]
    keyed = df.select("*", *[o.alias(p) for o, p in zip(order, places)], text.alias("__text"))
    nested = bags(
        keyed, by, ["__text"], places, part_size=part_size, bag="__bag", totals=totals
    )
    return nested.select(
        *by, "part", "n_members", delimited("__bag", separator, "__text").alias(name), *(totals or {})
    )


def unnest(df: DataFrame, bag: str, keep_empty: bool = False) -> DataFrame:
    """One row per member of a bag of structs. Rows with an empty bag go unless kept."""
    others = [c for c in df.columns if c != bag]
    expand = F.inline_outer if keep_empty else F.inline
    return df.select(*others, expand(bag))


def set_changes(
    df: DataFrame,
    by: Sequence[str],
    member: str,
    step: str,
    distance: int = 1,
    tasks: int | None = None,
) -> DataFrame:
    """Compare each group's set of members with the same group ``distance`` steps later.

    One row per group, step and member of either set, with ``in_first`` and ``in_second``. Rows
    are aligned on group, step and member, so a set of any size spreads over tasks. ``tasks`` is
    their number, for tables that hardly repeat a member: rows are then not added up ahead of the
    shuffle, which takes a map of all rows that a task reads.
    """
    kind = df.schema[step].dataType

    def seen(at: Column, first: int) -> Column:
        return F.struct(
            at.cast(kind).alias(step), F.lit(first).alias("a"), F.lit(1 - first).alias("b")
        )

    # each row counts for its own step and for the one before, from one scan
    both = F.inline(F.array(seen(F.col(step), 1), seen(F.col(step) - distance, 0)))
    flagged = df.select(*by, member, both)
    if tasks:
        flagged = flagged.repartition(tasks, *by, step, member)
    return flagged.groupBy(*by, step, member).agg(
        (F.max("a") == 1).alias("in_first"), (F.max("b") == 1).alias("in_second")
    )


def set_change_totals() -> dict[str, Column]:
    """Sizes of both sets and of their union, intersection and differences; 1 if equal."""
    first, second = F.col("in_first"), F.col("in_second")
    return {
        "n_first": F.count_if(first),
        "n_second": F.count_if(second),
        "n_either": F.count("*"),
        "n_stayed": F.count_if(first & second),
        "n_departed": F.count_if(first & ~second),
        "n_arrived": F.count_if(~first & second),
        "n_changed": F.count_if(first != second),
        "is_equal": (F.count_if(first != second) == 0).cast("int"),
    }


def set_change_counts(members: DataFrame, by: Sequence[str]) -> DataFrame:
    """The figures of :func:`set_change_totals` for the members of :func:`set_changes`."""
    return members.groupBy(*by).agg(*[c.alias(n) for n, c in set_change_totals().items()])
