"""Joins, co-groups and set operations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from relata.functions.scalars import ratio
from relata.operators import sets, sketches
from relata.operators.aggregate import count_by
from relata.operators.joins import (
    anti,
    coverage,
    fanout,
    join_on,
    join_tagged,
    join_tagged_sorted,
    left_salted,
    pair_counts,
    semi,
)
from relata.operators.nesting import bags, delimited, flat_text
from relata.plans import views
from relata.plans.registry import query
from relata.session import fresh_path, settle
from relata.sources.text import read_lines, write_lines


@query(
    "join_inner",
    """
    SELECT p.player_id, name_first, name_last, SLG, height_in, weight_lb,
           CAST(703 * weight_lb AS DOUBLE) / (height_in * height_in) AS BMI
    FROM people p JOIN careers c ON p.player_id = c.player_id WHERE c.PA > 30
    """,
    ("people", "careers"),
)
def _(source):
    # both sides lie in the same buckets of players, and a player is one row of each
    fatness = views.people_by_player(source).select(
        "player_id", "name_first", "name_last", "height_in", "weight_lb"
    )
    hitters = views.careers(source).filter("PA > 30").select("player_id", "SLG")
    size = F.col("height_in") * F.col("height_in")
    return fatness.join(hitters, "player_id").select(
        "player_id", "name_first", "name_last", "SLG", "height_in", "weight_lb",
        ratio(703 * F.col("weight_lb"), size).alias("BMI"),
    )


@query(
    "join_left",
    """
    SELECT c.player_id, c.n_seasons, h.birth_year AS hof_year
    FROM careers c LEFT JOIN (SELECT * FROM people
      WHERE acctbal > 9000) h ON c.player_id = h.player_id
    """,
    ("careers", "people"),
)
def _(source):
    # the filter stands for a second, smaller table
    fame = views.people(source).filter("acctbal > 9000").select("player_id", F.col("birth_year").alias("hof_year"))
    return left_salted(views.careers(source).select("player_id", "n_seasons"), fame, ["player_id"])


_LOCATED = """
    SELECT player_id, birth_city, birth_state, latitude
    FROM people LEFT JOIN places ON birth_city = name AND birth_state = admin1_code
    WHERE birth_country <> 'NATION_3'
"""


def _located(source):
    players = views.people(source).filter("birth_country <> 'NATION_3'")
    return join_on(
        players.select("player_id", "birth_city", "birth_state"),
        views.places(source).select("name", "admin1_code", "latitude"),
        {"birth_city": "name", "birth_state": "admin1_code"},
        "left",
    )


@query("join_left_multi", _LOCATED, ("people", "places"))
def _(source):
    return _located(source)


@query(
    "join_coverage",
    f"""
    WITH located AS ({_LOCATED})
    SELECT 'total' AS label, count(*) AS total FROM located
    UNION ALL SELECT 'with_lat', count(*) FROM located WHERE latitude IS NOT NULL
    UNION ALL SELECT 'without_lat', count(*) FROM located WHERE latitude IS NULL
    """,
    ("people", "places"),
)
def _(source):
    return coverage(_located(source), F.col("latitude").isNotNull(), "with_lat", "without_lat")


@query(
    "join_many_many",
    """
    SELECT l_orderkey AS player_id, p.team_id, p.park_id, p.year_id
    FROM lineitem JOIN park_team_years p
      ON CAST(l_suppkey AS VARCHAR) = p.team_id AND lpad(CAST(l_partkey AS VARCHAR), 12,
        '0') = p.park_id
    """,
    ("park_team_years",),
)
def _(source):
    players = views.table(source, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("team_id"),
        F.lpad(F.col("l_partkey").cast("string"), 12, "0").alias("park_id"),
        F.col("l_orderkey").alias("player_id"),
    )
    parks = views.park_team_years(source).select("team_id", "park_id", "year_id")
    return players.join(parks, ["team_id", "park_id"]).select("player_id", "team_id", "park_id", "year_id")


@query(
    "join_fanout_report",
    """
    SELECT 'seasons' AS label, CAST(count(*) AS DECIMAL(38,0)) AS total FROM seasons
    UNION ALL SELECT 'all_stars', count(*) FROM all_stars
    UNION ALL SELECT 'both', count(*) FROM seasons JOIN all_stars USING (player_id, year_id)
    """,
    ("seasons", "all_stars"),
)
def _(source):
    report = fanout(
        views.seasons(source), views.all_stars(source), ["player_id", "year_id"],
        ("seasons", "all_stars", "both"),
    )
    return report.select("label", F.col("total").cast("decimal(38,0)").alias("total"))


@query(
    "join_semi",
    """
    SELECT player_id, year_id, team_id, H FROM seasons s
    WHERE EXISTS (SELECT 1 FROM all_stars a WHERE a.player_id = s.player_id
      AND a.year_id = s.year_id)
    """,
    ("seasons", "all_stars"),
)
def _(source):
    rows = views.seasons(source).select("player_id", "year_id", "team_id", "H")
    return semi(rows, views.all_stars(source), ["player_id", "year_id"])


@query(
    "join_anti",
    """
    SELECT player_id, year_id, team_id, H FROM seasons s
    WHERE NOT EXISTS (SELECT 1 FROM all_stars a WHERE a.player_id = s.player_id
      AND a.year_id = s.year_id)
    """,
    ("seasons", "all_stars"),
)
def _(source):
    rows = views.seasons(source).select("player_id", "year_id", "team_id", "H")
    return anti(rows, views.all_stars(source), ["player_id", "year_id"])


@query(
    "join_self_pairs",
    """
    SELECT p1.team_id, p1.year_id, CAST(count(*) AS DECIMAL(38,0)) AS n_pairs
    FROM seasons p1 JOIN seasons p2 ON p1.team_id = p2.team_id AND p1.year_id = p2.year_id
    WHERE p1.player_id <> p2.player_id GROUP BY p1.team_id, p1.year_id
    """,
    ("seasons",),
)
def _(source):
    counts = pair_counts(views.seasons(source), ["team_id", "year_id"], "player_id")
    return counts.select("team_id", "year_id", F.col("n_pairs").cast("decimal(38,0)").alias("n_pairs")).filter(
        "n_pairs > 0"
    )


def tagged_text(source):
    """Nations with two fields and customers with three, as lines of one text."""
    nations = views.table(source, "nation").select(flat_text("|", "n_name", "n_nationkey").alias("value"))
    persons = views.table(source, "customer").select(
        flat_text("|", "c_name", "c_mktsegment", "c_nationkey").alias("value")
    )
    return nations.unionByName(persons)


@query(
    "join_tagged_lines",
    """
    SELECT CAST(n_nationkey AS VARCHAR) AS code, coalesce(n_name, '') AS name, coalesce(c_name,
      '') AS person,
           coalesce(c_mktsegment, '') AS status
    FROM nation JOIN customer ON n_nationkey = c_nationkey
    """,
)
def _(source):
    return join_tagged(tagged_text(source))


@query(
    "join_secondary_sort",
    """
    SELECT CAST(n_nationkey AS VARCHAR) AS code, coalesce(n_name, '') AS name,
      coalesce(c_name, '') AS person, coalesce(c_mktsegment, '') AS status
    FROM nation JOIN customer ON n_nationkey = c_nationkey
    """,
)
def _(source):
    path = fresh_path(source[0], "tagged")
    write_lines(tagged_text(source), path)
    return join_tagged_sorted(read_lines(source[0], path))


@query(
    "cogroup_full",
    """
    SELECT coalesce(a.name, b.city) AS city, coalesce(n_cities, 0) AS n_cities, population,
           coalesce(n_parks, 0) AS n_parks, first_park
    FROM (SELECT name, count(*) AS n_cities, max(population) AS population
      FROM major_cities GROUP BY name) a
    FULL OUTER JOIN (SELECT city, count(*) AS n_parks, min(park_id) AS first_park
      FROM main_parks GROUP BY city) b
      ON a.name = b.city
    """,
    ("major_cities", "main_parks"),
)
def _(source):
    return sets.cogroup(
        views.major_cities(source),
        views.main_parks(source),
        {"city": (F.col("name"), F.col("city"))},
        {"population": F.col("population")},
        {"park_id": F.col("park_id")},
        [
            F.count_if("from_a").alias("n_cities"),
            F.max("population").alias("population"),
            F.count_if("from_b").alias("n_parks"),
            F.min("park_id").alias("first_park"),
        ],
    )


@query(
    "cogroup_shifted",
    """
    SELECT coalesce(a.team_id, b.team_id) AS team_id, coalesce(a.year_id, b.year_id) AS year_id,
           coalesce(a.n, 0) AS n_parks, coalesce(b.n, 0) AS n_parks_next
    FROM (SELECT team_id, year_id, count(*) AS n FROM park_team_years GROUP BY ALL) a
    FULL OUTER JOIN
         (SELECT team_id, year_id - 1 AS year_id, count(*) AS n FROM park_team_years GROUP BY ALL) b
      ON a.team_id = b.team_id AND a.year_id = b.year_id
    """,
    ("park_team_years",),
)
def _(source):
    stays = count_by(views.park_team_years(source), "team_id", "year_id", name="n")
    counts = settle(stays, "counts")
    year = F.col("year_id")
    return sets.cogroup(
        counts,
        counts,
        {"team_id": (F.col("team_id"), F.col("team_id")), "year_id": (year, year - 1)},
        {"now": F.col("n")},
        {"next": F.col("n")},
        [
            F.coalesce(F.sum("now"), F.lit(0)).alias("n_parks"),
            F.coalesce(F.sum("next"), F.lit(0)).alias("n_parks_next"),
        ],
    )


@query(
    "union_all3",
    """
    SELECT c_custkey AS id, c_name AS name FROM customer
    UNION ALL SELECT s_suppkey, s_name FROM supplier
    UNION ALL SELECT p_partkey, p_name FROM part
    """,
)
def _(source):
    named = {"customer": "c_cust", "supplier": "s_supp", "part": "p_part"}
    return sets.union_all(
        *[
            views.table(source, name).select(
                F.col(f"{start}key").alias("id"), F.col(f"{start[:2]}name").alias("name")
            )
            for name, start in named.items()
        ]
    )


@query(
    "union_symmetrize",
    """
    SELECT year_id, home_team_id AS team, home_runs_ct AS runs_for, away_runs_ct AS runs_against,
      1 AS is_home
    FROM games
    UNION ALL
    SELECT year_id, away_team_id, away_runs_ct, home_runs_ct, 0 FROM games
    """,
    ("games",),
)
def _(source):
    def side(own: str, other: str, is_home: int):
        return F.struct(
            F.col(f"{own}_team_id").alias("team"),
            F.col(f"{own}_runs_ct").alias("runs_for"),
            F.col(f"{other}_runs_ct").alias("runs_against"),
            F.lit(is_home).alias("is_home"),
        )

    # both sides of a game from one scan of the joined tables
    return views.games(source).select(
        "year_id", F.inline(F.array(side("home", "away", 1), side("away", "home", 0)))
    )


@query("set_distinct", "SELECT DISTINCT team_id, park_id FROM park_team_years", ("park_team_years",))
def _(source):
    return views.park_team_years(source).select("team_id", "park_id").distinct()


def _names(source):
    return (
        views.major_cities(source).select(F.col("name").alias("city")),
        views.main_parks(source).select("city"),
    )


_SETS = ("major_cities", "main_parks")


@query("set_union", "SELECT name AS city FROM major_cities UNION SELECT city FROM main_parks", _SETS)
def _(source):
    return sets.union(*_names(source))


@query(
    "set_intersect",
    """
    SELECT city, n_cities, n_parks FROM
      (SELECT name, count(*) AS n_cities FROM major_cities GROUP BY name)
      JOIN (SELECT city, count(*) AS n_parks FROM main_parks GROUP BY city) ON name = city
    """,
    _SETS,
)
def _(source):
    return _city_counts(source).filter("n_cities > 0 AND n_parks > 0")


def _city_counts(source):
    return sets.cogroup(
        views.major_cities(source),
        views.main_parks(source),
        {"city": (F.col("name"), F.col("city"))},
        {},
        {},
        [F.count_if("from_a").alias("n_cities"), F.count_if("from_b").alias("n_parks")],
    )


@query("set_minus_ab", "SELECT name AS city FROM major_cities EXCEPT SELECT city FROM main_parks", _SETS)
def _(source):
    return sets.minus(*_names(source))


@query("set_minus_ba", "SELECT city FROM main_parks EXCEPT SELECT name FROM major_cities", _SETS)
def _(source):
    cities, parks = _names(source)
    return sets.minus(parks, cities)


@query(
    "set_xor",
    """
    (SELECT name AS city FROM major_cities EXCEPT SELECT city FROM main_parks)
    UNION ALL (SELECT city FROM main_parks EXCEPT SELECT name FROM major_cities)
    """,
    _SETS,
)
def _(source):
    return sets.xor(*_names(source))


@query(
    "set_equality",
    """
    SELECT 'same' AS pair, 1 AS is_equal
    UNION ALL
    SELECT 'different', CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM (
      (SELECT name FROM major_cities EXCEPT SELECT city FROM main_parks)
      UNION ALL (SELECT city FROM main_parks EXCEPT SELECT name FROM major_cities))
    """,
    _SETS,
)
def _(source):
    cities, parks = _names(source)
    return sets.union_all(
        sets.equal(cities, cities).select(F.lit("same").alias("pair"), "is_equal"),
        sets.equal(cities, parks).select(F.lit("different").alias("pair"), "is_equal"),
    )


@query(
    "set_equality_digest",
    """
    SELECT pair, is_equal FROM (VALUES ('bag, itself', 1), ('bag, repeated', 0), ('set, repeated', 1),
      ('empty', 1), ('bag, one row less', CASE WHEN (SELECT count(*) FROM major_cities) > 0
        THEN 0 ELSE 1 END)) AS t(pair, is_equal)
    UNION ALL
    SELECT 'set, different', CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM (
      (SELECT name FROM major_cities EXCEPT SELECT city FROM main_parks)
      UNION ALL (SELECT city FROM main_parks EXCEPT SELECT name FROM major_cities))
    """,
    _SETS,
)
def _(source):
    cities, parks = (t.withColumnRenamed("city", "name") for t in _names(source))
    pairs = [
        ("bag, itself", cities, cities, False),
        ("bag, repeated", cities, cities.unionByName(cities), False),
        ("set, repeated", cities, cities.unionByName(cities), True),
        ("empty", cities.filter("false"), parks.filter("false"), False),
        ("bag, one row less", cities, cities.exceptAll(cities.limit(1)), False),
        ("set, different", cities, parks, True),
    ]
    return sets.union_all(
        *[
            sets.equal_by_digest(a, b, as_sets).select(F.lit(pair).alias("pair"), "is_equal")
            for pair, a, b, as_sets in pairs
        ]
    )


@query(
    "set_sizes_sketched",
    """
    WITH roster AS (SELECT DISTINCT team_id, year_id, player_id FROM seasons),
    both_years AS (
      SELECT a.team_id, a.year_id FROM (SELECT DISTINCT team_id, year_id FROM roster) a
      JOIN (SELECT DISTINCT team_id, year_id FROM roster) b
        ON a.team_id = b.team_id AND b.year_id = a.year_id + 1),
    sides AS (
      SELECT team_id, year_id, player_id, max(y1) AS y1, max(y2) AS y2 FROM (
        SELECT team_id, year_id, player_id, 1 AS y1, 0 AS y2 FROM roster
        UNION ALL SELECT team_id, year_id - 1, player_id, 0, 1 FROM roster)
      GROUP BY team_id, year_id, player_id)
    SELECT team_id, year_id, count(*) AS n_either, count(*) FILTER (WHERE y1 = 1 AND y2 = 1) AS n_both,
      TRUE AS either_near, TRUE AS both_near, TRUE AS left_near, TRUE AS joined_near
    FROM sides JOIN both_years USING (team_id, year_id) GROUP BY team_id, year_id
    """,
    ("seasons",),
)
def _(source):
    """Whether a team's players of two years, as sketches, give the sizes of the sets they stand for."""
    roster = views.seasons(source).select("team_id", "year_id", "player_id")
    stored = settle(sketches.set_sketches(roster, ["team_id", "year_id"], "player_id"), "rosters")
    later = stored.select("team_id", (F.col("year_id") - 1).alias("year_id"), F.col("sketch").alias("later"))
    sizes = sketches.set_sizes(F.col("sketch"), F.col("later"))
    found = stored.join(later, ["team_id", "year_id"]).select(
        "team_id", "year_id", *[size.alias(f"s_{name}") for name, size in sizes.items()]
    )
    shifted = roster.withColumn("year_id", F.col("year_id") - 1)
    sides = sets.membership(roster, shifted).groupBy("team_id", "year_id").agg(
        F.count("*").alias("n_either"),
        F.count_if(F.col("in_a") & F.col("in_b")).alias("n_both"),
        F.count_if(~F.col("in_b")).alias("n_only_a"),
        F.count_if(~F.col("in_a")).alias("n_only_b"),
    )

    def near(name: str) -> Column:
        away = F.abs(F.col(f"s_{name}") - F.col(f"n_{name}"))
        return away <= sketches.SET_ERROR * F.col("n_either")

    return found.join(sides, ["team_id", "year_id"]).select(
        "team_id", "year_id", "n_either", "n_both",
        near("either").alias("either_near"), near("both").alias("both_near"),
        near("only_a").alias("left_near"), near("only_b").alias("joined_near"),
    )


_KEYED_SQL = """
    WITH firsts AS (
      SELECT name, geonameid, population FROM (
        SELECT *, row_number() OVER (PARTITION BY name ORDER BY geonameid) AS rn
          FROM major_cities) WHERE rn = 1),
    lists AS (
      SELECT city, part, n_parks, string_agg(CAST(park_id AS VARCHAR), '|'
        ORDER BY park_id) AS park_ids
      FROM (SELECT *, (row_number() OVER (PARTITION BY city
        ORDER BY park_id) - 1) // 1000 AS part,
                   count(*) OVER (PARTITION BY city) AS n_parks FROM main_parks)
      GROUP BY city, part, n_parks)
    SELECT coalesce(name, city) AS city, geonameid, population, coalesce(part, 0) AS part,
           coalesce(n_parks, 0) AS n_parks, coalesce(park_ids, '') AS park_ids
    FROM firsts FULL OUTER JOIN lists ON name = city
"""


def _keyed(source):
    """Every city of either set with its first tuple on one side and its members on the other."""
    # the first tuple of each key: the city with the smallest id
    first = views.major_cities(source).groupBy(F.col("name").alias("city")).agg(
        F.min("geonameid").alias("geonameid"), F.min_by("population", "geonameid").alias("population")
    )
    parks = bags(
        settle(views.main_parks(source), "parks"),
        ["city"],
        ["park_id"],
        ["park_id"],
        part_size=1000,
        bag="park_ids",
    )
    return first.join(parks, "city", "full_outer").select(
        "city",
        "geonameid",
        "population",
        F.coalesce("part", F.lit(0)).alias("part"),
        F.coalesce("n_members", F.lit(0)).alias("n_parks"),
        F.coalesce(delimited("park_ids", "|", "park_id"), F.lit("")).alias("park_ids"),
    )


_IN_BOTH = "geonameid IS NOT NULL AND n_parks > 0"


@query("set_union_keyed", _KEYED_SQL, _SETS)
def _(source):
    return _keyed(source)


@query("set_intersect_keyed", f"SELECT * FROM ({_KEYED_SQL}) WHERE {_IN_BOTH}", _SETS)
def _(source):
    return _keyed(source).filter(_IN_BOTH)


@query(
    "set_minus_keyed",
    f"""
    SELECT *, 'cities' AS side FROM ({_KEYED_SQL}) WHERE n_parks = 0
    UNION ALL SELECT *, 'parks' FROM ({_KEYED_SQL}) WHERE geonameid IS NULL
    """,
    _SETS,
)
def _(source):
    """Both differences, put under one another, each row with the side that has its key."""
    side = F.when(F.col("n_parks") == 0, "cities").otherwise("parks")
    return _keyed(source).filter("n_parks = 0 OR geonameid IS NULL").withColumn("side", side)


@query("set_xor_keyed", f"SELECT * FROM ({_KEYED_SQL}) WHERE NOT ({_IN_BOTH})", _SETS)
def _(source):
    return _keyed(source).filter(f"NOT ({_IN_BOTH})")
