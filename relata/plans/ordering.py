"""Sorts, ranks and top rows. A sorted result carries its row number, so that order is visible."""

from __future__ import annotations

from pyspark.sql import functions as F

from relata.functions.hashing import siphash_long, siphash_sql
from relata.operators.nesting import delimited
from relata.operators.numbering import number_copies, number_rows, rank_rows
from relata.operators.ranking import holder_of_max, nest_top, shuffle_rows, top, top_per_group
from relata.plans import views
from relata.plans.registry import query
from relata.plans.rollups import EPOCHS_SQL, epochs
from relata.session import settle

_FIELDS = "player_id, PA_all, OPS_all, OPS_prime, OPS_older, beg_year, n_prime, n_older"


def _sorted_sql(order: str) -> str:
    return f"SELECT row_number() OVER (ORDER BY {order}) AS row_no, {_FIELDS} FROM ({EPOCHS_SQL})"


def _sorted(source, *order):
    rows = epochs(source).select(*_FIELDS.split(", "))
    return number_rows(rows, order)


@query("sort_multi", _sorted_sql("n_older DESC, n_prime DESC, player_id NULLS FIRST"), ("modern",))
def _(source):
    return _sorted(source, F.col("n_older").desc(), F.col("n_prime").desc(), F.col("player_id"))


@query("sort_expr", _sorted_sql("OPS_older - OPS_prime DESC NULLS LAST, player_id NULLS FIRST"), ("modern",))
def _(source):
    gain = F.col("OPS_older") - F.col("OPS_prime")
    return _sorted(source, gain.desc_nulls_last(), F.col("player_id"))


@query(
    "sort_nulls",
    f"""
    SELECT *, row_number() OVER (ORDER BY OPS_older IS NOT NULL, OPS_all DESC NULLS LAST,
      player_id NULLS FIRST) AS nulls_first_no,
           row_number() OVER (ORDER BY OPS_older IS NULL, OPS_all DESC NULLS LAST,
             player_id NULLS FIRST) AS nulls_last_no
    FROM (SELECT {_FIELDS} FROM ({EPOCHS_SQL}))
    """,
    ("modern",),
)
def _(source):
    rows = epochs(source).select(*_FIELDS.split(", "))
    then = [F.col("OPS_all").desc_nulls_last(), F.col("player_id")]
    first = number_rows(rows, [F.col("OPS_older").isNotNull(), *then], "nulls_first_no")
    return number_rows(first, [F.col("OPS_older").isNull(), *then], "nulls_last_no")


@query("sort_float_top", _sorted_sql("beg_year >= 1998 DESC NULLS LAST, n_older DESC, player_id NULLS FIRST"), ("modern",))
def _(source):
    recent = F.col("beg_year") >= 1998
    return _sorted(source, recent.desc(), F.col("n_older").desc(), F.col("player_id"))


@query(
    "sort_lines",
    "SELECT row_number() OVER (ORDER BY p_name NULLS FIRST) AS row_no, p_name AS value FROM part",
)
def _(source):
    lines = views.table(source, "part").select(F.col("p_name").alias("value"))
    return number_copies(lines, [F.col("value")])


@query(
    "topk_global",
    "SELECT player_id, year_id, team_id, H FROM seasons ORDER BY H DESC NULLS LAST, player_id NULLS FIRST, year_id NULLS FIRST, team_id NULLS FIRST LIMIT 20",
    ("seasons",),
)
def _(source):
    rows = views.seasons(source).select("player_id", "year_id", "team_id", "H")
    return top(rows, 20, [F.col("H").desc(), F.col("player_id"), F.col("year_id"), F.col("team_id")])


@query(
    "topk_per_group",
    """
    SELECT year_id, count(*) AS n, string_agg(coalesce(CAST(player_id AS VARCHAR), '') || '|'
      || coalesce(team_id, '') || '|'
             || coalesce(CAST(RBI AS VARCHAR), ''), '|' ORDER BY rn DESC) AS top_5
    FROM (SELECT *, row_number() OVER (PARTITION BY year_id
            ORDER BY RBI DESC NULLS LAST, player_id NULLS FIRST, team_id NULLS FIRST) AS rn
              FROM seasons)
    WHERE rn <= 5 GROUP BY year_id
    """,
    ("seasons",),
)
def _(source):
    rows = views.seasons(source).select("year_id", "player_id", "team_id", "RBI")
    order = [F.col("RBI").desc(), F.col("player_id"), F.col("team_id")]
    listed = nest_top(
        rows, ["year_id"], 5, order, ["player_id", "team_id", "RBI"], "top_5", ascending=True
    )
    return listed.select(
        "year_id",
        F.size("top_5").cast("bigint").alias("n"),
        delimited("top_5", "|", "player_id", "team_id", "RBI").alias("top_5"),
    )


@query(
    "topk_team_list",
    """
    SELECT team_id, year_id, rn AS place, player_id, PA FROM (
      SELECT *, row_number() OVER (PARTITION BY team_id, year_id ORDER BY PA DESC NULLS LAST,
        player_id NULLS FIRST) AS rn FROM seasons)
    WHERE rn <= 4
    """,
    ("seasons",),
)
def _(source):
    rows = views.seasons(source).select("team_id", "year_id", "player_id", "PA")
    best = top_per_group(rows, ["team_id", "year_id"], 4, [F.col("PA").desc(), F.col("player_id")])
    return best.withColumn("place", F.col("place").cast("bigint"))


@query(
    "argmax_per_group",
    """
    SELECT player_id, year_id, stints, team_id, RBI FROM (
      SELECT player_id, year_id, team_id, RBI, count(*) OVER (PARTITION BY player_id,
        year_id) AS stints,
             row_number() OVER (PARTITION BY player_id, year_id ORDER BY RBI DESC NULLS LAST,
               team_id NULLS FIRST) AS rn FROM seasons)
    WHERE rn = 1 AND stints > 1
    """,
    ("seasons",),
)
def _(source):
    main = holder_of_max(views.seasons(source), ["player_id", "year_id"], "RBI", "team_id")
    return main.filter("stints > 1").select("player_id", "year_id", "stints", "team_id", "RBI")


@query(
    "rank_running",
    """
    SELECT row_number() OVER (ORDER BY player_id NULLS FIRST, year_id NULLS FIRST,
      team_id NULLS FIRST) AS row_no, player_id, year_id, team_id, H
    FROM seasons
    """,
    ("seasons",),
)
def _(source):
    rows = views.seasons(source).select("player_id", "year_id", "team_id", "H")
    return number_rows(rows, [F.col("player_id"), F.col("year_id"), F.col("team_id")])


@query(
    "rank_any_order",
    "SELECT count(*) AS n_rows, CAST(count(*) AS BIGINT) AS n_numbers, 1 AS smallest, count(*) AS largest FROM orders",
)
def _(source):
    """Rows numbered in any order: each number from one to the number of rows, once."""
    numbered = number_rows(views.table(source, "orders").select("o_orderkey"))
    return numbered.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("row_no").alias("n_numbers"),
        F.min("row_no").cast("int").alias("smallest"),
        F.max("row_no").alias("largest"),
    )


@query(
    "rank_sparse",
    """
    SELECT rank() OVER (ORDER BY RBI DESC NULLS LAST, H DESC NULLS LAST,
      player_id NULLS FIRST) AS rank, player_id, year_id, team_id, RBI, H
    FROM seasons
    """,
    ("seasons",),
)
def _(source):
    rows = settle(views.seasons(source).select("player_id", "year_id", "team_id", "RBI", "H"), "seasons")
    return rank_rows(rows, [("RBI", True), ("H", True), ("player_id", False)])


@query(
    "rank_dense",
    "SELECT dense_rank() OVER (ORDER BY H DESC NULLS LAST) AS rank, player_id, year_id, team_id, H FROM seasons",
    ("seasons",),
)
def _(source):
    rows = settle(views.seasons(source).select("player_id", "year_id", "team_id", "H"), "seasons")
    return rank_rows(rows, [("H", True)], sparse=None, dense="rank")


@query(
    "shuffle_hash",
    """
    SELECT row_number() OVER (ORDER BY md5('7' || CAST(c_custkey AS VARCHAR)), c_custkey) AS row_no,
           c_custkey, c_name FROM customer
    """,
)
def _(source):
    return shuffle_rows(views.table(source, "customer").select("c_custkey", "c_name"), ["c_custkey"], "7")


# the key of a keyed shuffle: another key gives another order
SHUFFLE_KEY = bytes(range(16))


@query(
    "shuffle_siphash",
    f"""
    SELECT row_number() OVER (ORDER BY hash >= {1 << 63}::HUGEINT DESC, hash, c_custkey) AS row_no,
           c_custkey, c_name
    FROM ({siphash_sql("c_custkey", "(SELECT c_custkey, c_name FROM customer)", SHUFFLE_KEY)})
    """,
)
def _(source):
    """Customers in the order of a keyed hash, compared as a signed number."""
    rows = views.table(source, "customer").select("c_custkey", "c_name")
    return shuffle_rows(rows, ["c_custkey"], digest=siphash_long(F.col("c_custkey"), SHUFFLE_KEY))
