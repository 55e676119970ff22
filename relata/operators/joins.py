"""Joins by equal keys, with the reports that tell how a join behaves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relata.operators.numbering import lay_out
from relata.session import settle


def key_condition(left: str, right: str, keys: Mapping[str, str]) -> Column:
    """Equality of differently named keys of two aliased tables."""
    condition = F.lit(True)
    for a, b in keys.items():
        condition = condition & (F.col(f"{left}.{a}") == F.col(f"{right}.{b}"))
    return condition


def join_on(
    left: DataFrame, right: DataFrame, keys: Mapping[str, str], how: str = "inner"
) -> DataFrame:
    """Join on keys named differently on each side, keeping the left side's key columns.

    Whether a side is broadcast, and whether a hot key's partition is split, is left to the
    optimizer, which knows the sizes when it runs.
    """
    return left.alias("l").join(
        right.alias("r"), key_condition("l", "r", keys), how
    ).drop(*[F.col(f"r.{b}") for b in keys.values()])


def exact(count: str) -> Column:
    """A count wide enough for products of counts."""
    return F.col(count).cast("decimal(18,0)")


def _distinct_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct keys, stored. Their size is then known, and if they are few they are broadcast
    and the other side stays where it is. If not, both sides of the join are plain shuffles, which
    adaptive execution can split where one key is hot; above an aggregation it would not."""
    return settle(df.select(*on).distinct(), "keys")


def semi(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left rows with a partner, each once."""
    return left.join(_distinct_keys(right, on), list(on), "left_semi")


def anti(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left rows without a partner; a null key has none."""
    return left.join(_distinct_keys(right, on), list(on), "left_anti")


def fanout(
    left: DataFrame, right: DataFrame, on: Sequence[str], labels: tuple[str, str, str]
) -> DataFrame:
    """Rows of both inputs and of their join, without building the join.

    Rows per key are counted on each side. A full outer join of the counts, in which null keys
    find no partner, gives all three figures: the products of the counts add up to the join.
    """
    n_left = left.groupBy(*on).agg(F.count("*").alias("nl"))
    n_right = right.groupBy(*on).agg(F.count("*").alias("nr"))
    zero = F.lit(0).cast("decimal(38,0)")
    sizes = n_left.join(n_right, list(on), "full_outer").agg(
        *[
            F.coalesce(F.sum(amount), zero).alias(name)
            for name, amount in {"l": exact("nl"), "r": exact("nr"), "j": exact("nl") * exact("nr")}.items()
        ]
    )
    return _long_form(sizes, dict(zip(labels, ("l", "r", "j"))))


def coverage(df: DataFrame, matched: Column, yes: str, no: str) -> DataFrame:
    """Rows in all, with and without a match, as label and total, in one pass."""
    counts = df.agg(
        F.count("*").alias("total"),
        F.count_if(matched).alias("yes"),
        F.count_if(~matched).alias("no"),
    )
    return _long_form(counts, {"total": "total", yes: "yes", no: "no"})


def _long_form(one_row: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """One row of figures as rows of label and total."""
    entries = [
        F.struct(F.lit(label).alias("label"), F.col(c).alias("total")) for label, c in labels.items()
    ]
    return one_row.select(F.inline(F.array(*entries)))


def pair_counts(df: DataFrame, by: Sequence[str], member: str, name: str = "n_pairs") -> DataFrame:
    """Ordered pairs of rows with different members in each group, as a self-join would give.

    With n rows in a group and c of them for one member, there are n*n minus the sum of c*c
    pairs, so two counts replace the quadratic join. Rows with a null key or member pair with
    nothing.
    """
    known = df.select(*by, member).dropna()
    per_member = known.groupBy(*by, member).agg(F.count("*").alias("c"))
    sums = per_member.groupBy(*by).agg(
        F.sum("c").alias("n"), F.sum(exact("c") * exact("c")).alias("same")
    )
    return sums.select(*by, (exact("n") * exact("n") - F.col("same")).alias(name))


def partners(df: DataFrame, by: Sequence[str], member: str, chosen: Column) -> DataFrame:
    """Pairs of each chosen row with the rows of other members in its group, as ``pl1, pl2``.

    For a choice of members only: listing the pairs of all of them grows with the square of the
    group, and :func:`pair_counts` tells their number without listing them.
    """
    picked = df.filter(chosen).select(*by, F.col(member).alias("pl1"))
    others = df.select(*by, F.col(member).alias("pl2"))
    return picked.join(others, list(by)).filter("pl1 != pl2").select("pl1", "pl2")


def tagged_lines(df: DataFrame, line: str = "value", separator: str = "[|]") -> dict[str, DataFrame]:
    """Tell two record shapes apart by their number of fields.

    Two fields are a name and a code, three or more a person with status and code. Lines with
    fewer fields are returned as rejects.
    """
    fields = df.select(F.col(line), F.split(line, separator).alias("f"))
    return {
        "dimension": fields.filter(F.size("f") == 2).select(
            F.col("f")[0].alias("name"), F.col("f")[1].alias("code")
        ),
        "fact": fields.filter(F.size("f") >= 3).select(
            F.col("f")[0].alias("person"), F.col("f")[1].alias("status"), F.col("f")[2].alias("code")
        ),
        "rejected": fields.filter(F.size("f") < 2).select(line),
    }


def _by_tag(df: DataFrame, line: str, separator: str = "[|]") -> DataFrame:
    """Both record shapes of a text as rows of one table, read once: code, is_dimension, fields."""
    fields = df.select(F.split(line, separator).alias("f")).filter(F.size("f") >= 2)
    is_dimension = F.size("f") == 2
    return fields.select(
        F.when(is_dimension, F.col("f")[1]).otherwise(F.get("f", F.lit(2))).alias("code"),
        is_dimension.alias("is_dimension"),
        F.when(is_dimension, F.col("f")[0]).alias("name"),
        F.when(~is_dimension, F.col("f")[0]).alias("person"),
        F.when(~is_dimension, F.col("f")[1]).alias("status"),
    )


def join_tagged(df: DataFrame, line: str = "value") -> DataFrame:
    """Join the two record shapes of one text on their code. The text is read and split once."""
    rows = settle(_by_tag(df, line), "tagged")
    names = rows.filter("is_dimension").select("code", "name")
    persons = rows.filter("NOT is_dimension").select("code", "person", "status")
    return names.join(persons, "code").select("code", "name", "person", "status")


def join_tagged_sorted(df: DataFrame, line: str = "value") -> DataFrame:
    """The rows of :func:`join_tagged`, by one sort of both record shapes together."""
    found = secondary_sort_join(
        _by_tag(df, line), "code", F.col("is_dimension"), ["name"], ["person", "status"]
    )
    return found.select("code", "name", "person", "status")


def secondary_sort_join(
    rows: DataFrame,
    key: str,
    is_dimension: Column,
    dimension: Sequence[str],
    fact: Sequence[str],
) -> DataFrame:
    """Inner join of the two kinds of rows that one table holds: ``key``, ``fact``, ``dimension``.

    One range shuffle by key and kind: a key's dimension rows come first and are carried forward to
    its facts, through the range where they lie and on into every range that the key goes on in. So
    the facts of a hot key spread over all ranges, and dimension rows alone are repeated: one row
    per range at most. All dimension rows of a key are held at once. Null keys match nothing.
    """
    tagged = rows.filter(F.col(key).isNotNull()).select(
        key, is_dimension.alias("__first"), *dimension, *fact
    )
    # facts of one key by a hash of their fields, as no order among them is asked for
    laid = lay_out(
        tagged, [F.col(key), F.col("__first").desc(), F.xxhash64(*[F.col(c) for c in fact])]
    )
    member = F.when(F.col("__first"), F.struct(*dimension))
    here = Window.partitionBy("__home", key).orderBy("__place")
    told = laid.withColumn(
        "__told", F.collect_list(member).over(here.rowsBetween(Window.unboundedPreceding, 0))
    )
    ranges = laid.groupBy(key, "__home", "__range").agg(F.collect_list(member).alias("__held"))
    before = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select(
        F.col(key).alias("__key"),
        F.col("__home").alias("__to"),
        F.flatten(F.collect_list("__held").over(before)).alias("__carried"),
    ).filter(F.size("__carried") > 0)  # a range goes on with one key of the range before
    matched = (
        told.filter(~F.col("__first"))
        .join(
            F.broadcast(carried),
            (F.col(key) == F.col("__key")) & (F.col("__home") == F.col("__to")),
            "left",
        )
        .withColumn("__all", F.concat(F.coalesce("__carried", F.array()), "__told"))
    )
    return matched.select(key, *fact, F.inline("__all"))


def left_salted(
    left: DataFrame, right: DataFrame, keys: Sequence[str], salts: int = 16
) -> DataFrame:
    """Left outer join in which one key of ``right`` may hold very many rows.

    Adaptive execution does not split the right side of a left outer join. Its rows are dealt out
    to ``salts`` salts, matched inside, and left rows without any match are added: each left row
    is sent ``salts`` times, so use it where the left side is the smaller one. Null keys match
    nothing. Every left row is matched by its own key, so ``left`` may repeat keys.

    ``left`` is stored, as it is read twice. Equal rows of ``right``, which would share a salt, are
    counted ahead of the shuffle and written out after the match. The salted sides meet by a sort:
    the optimizer takes ``left`` for as small after the salts as before, and would broadcast all its
    ``salts`` copies through the driver.
    """
    left = settle(left, "left")
    counted = right.groupBy(*right.columns).agg(F.count("*").alias("__ct"))
    salted = counted.withColumn("__salt", F.pmod(F.xxhash64(*right.columns), F.lit(salts)))
    spread = left.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = spread.withColumn("__salt", F.col("__salt").cast("bigint"))
    matched = spread.hint("merge").join(salted, [*keys, "__salt"]).drop("__salt")
    copies = F.sequence(F.lit(1).cast("bigint"), F.col("__ct"))
    matched = matched.withColumn("__copy", F.explode(copies)).drop("__ct", "__copy")
    unmatched = left.join(right.select(*keys).distinct(), list(keys), "left_anti")
    others = [c for c in right.columns if c not in keys]
    empty = unmatched.select(
        *[F.col(c) for c in matched.columns if c not in others],
        *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in others],
    )
    return matched.unionByName(empty)
