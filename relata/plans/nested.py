"""Nested collections, compared as text. Members are ordered, and bags come in parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from relata.functions.dates import date_of, date_of_text
from relata.functions.scalars import record, substring_range
from relata.operators.nesting import (
    bag_text,
    bags,
    delimited,
    flat_text,
    set_change_totals,
    set_changes,
    tasks_for,
    unnest,
)
from relata.operators.ranking import nest_top
from relata.plans import views
from relata.plans.registry import query
from relata.session import fresh_path, settle
from relata.sources.text import read_json, write_json

#: Members of a part in the queries below; small enough for the largest groups to be cut.
PART_SIZE = 1000

_STAYS = ("park_team_years",)


def _nulls_lowest(order: str) -> str:
    """An SQL order in which nulls sort lowest."""
    return ", ".join(
        f"{item} NULLS LAST" if item.endswith(" DESC") else f"{item} NULLS FIRST"
        for item in order.split(", ")
    )


def _part(by: str, order: str, size: int = PART_SIZE) -> str:
    """The part a member falls in, by its place in the group."""
    return f"(row_number() OVER (PARTITION BY {by} ORDER BY {_nulls_lowest(order)}) - 1) // {size} AS part"


def _flat(separator: str, *columns: str) -> str:
    """Columns as one text, nulls as empty text."""
    return f" || '{separator}' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in columns)


def _listed(text: str, separator: str, order: str, only: str = "") -> str:
    """Texts of a group in order."""
    where = f" FILTER (WHERE {only})" if only else ""
    return f"coalesce(string_agg({text}, '{separator}' ORDER BY {_nulls_lowest(order)}){where}, '')"


def _stays(source):
    """Stays, stored once, as a bag with totals reads them twice."""
    return settle(views.park_team_years(source), "stays")


_ROW = ("park_id", "team_id", "year_id", "beg_date", "end_date", "n_games")


@query(
    "nest_bag_rows",
    f"""
    SELECT team_id, part, n_members,
      {_listed(_flat('|', *_ROW), '|', 'park_id, year_id')} AS members
    FROM (SELECT *, {_part('team_id', 'park_id, year_id')}, count(*)
      OVER (PARTITION BY team_id) AS n_members
          FROM park_team_years) GROUP BY team_id, part, n_members
    """,
    _STAYS,
)
def _(source):
    nested = bags(_stays(source), ["team_id"], _ROW, ["park_id", "year_id"], part_size=PART_SIZE)
    return nested.select("team_id", "part", "n_members", delimited("bag", "|", *_ROW).alias("members"))


@query(
    "nest_bag_pairs",
    f"""
    SELECT team_id, part, {_listed(_flat('|', 'park_id', 'year_id'), '|', 'park_id, year_id')} AS pairs
    FROM (SELECT *, {_part('team_id', 'park_id, year_id')} FROM park_team_years) GROUP BY team_id,
      part
    """,
    _STAYS,
)
def _(source):
    nested = bags(_stays(source), ["team_id"], ["park_id", "year_id"], ["park_id", "year_id"], part_size=PART_SIZE)
    return nested.select("team_id", "part", delimited("bag", "|", "park_id", "year_id").alias("pairs"))


@query(
    "nest_bag_parts",
    f"""
    SELECT team_id, part, n_members,
      {_listed(_flat('|', 'park_id', 'year_id'), '|', 'year_id, park_id')} AS pairs
    FROM (SELECT *, {_part('team_id', 'year_id, park_id', 250)},
                 count(*) OVER (PARTITION BY team_id) AS n_members FROM park_team_years)
    GROUP BY team_id, part, n_members
    """,
    _STAYS,
)
def _(source):
    # parts small enough for every group to be cut
    nested = bags(_stays(source), ["team_id"], ["park_id", "year_id"], ["year_id", "park_id"], part_size=250)
    return nested.select("team_id", "part", "n_members", delimited("bag", "|", "park_id", "year_id").alias("pairs"))


@query(
    "nest_two_bags",
    f"""
    SELECT team_id, part, {_listed(_flat('', 'park_id'), '^', 'year_id, park_id')} AS park_ids,
           {_listed(_flat('', 'year_id'), '^', 'year_id, park_id')} AS park_years
    FROM (SELECT *, {_part('team_id', 'year_id, park_id')} FROM park_team_years) GROUP BY team_id,
      part
    """,
    _STAYS,
)
def _(source):
    nested = bags(_stays(source), ["team_id"], ["park_id", "year_id"], ["year_id", "park_id"], part_size=PART_SIZE)
    return nested.select(
        "team_id",
        "part",
        delimited("bag", "^", "park_id").alias("park_ids"),
        delimited("bag", "^", "year_id").alias("park_years"),
    )


@query("nest_explode", "SELECT team_id, park_id, year_id, n_games FROM park_team_years", _STAYS)
def _(source):
    fields = ["park_id", "year_id", "n_games"]
    nested = bags(_stays(source), ["team_id"], fields, ["park_id", "year_id"], part_size=PART_SIZE)
    return unnest(nested, "bag").select("team_id", *fields)


@query(
    "nest_inner_ops",
    f"""
    SELECT team_id, year_id, count(*) AS n_distinct,
           {_listed(_flat('', 'player_id'), '|', 'player_id')} AS alt_order,
           {_listed(_flat('', 'player_id'), '|', 'rn', 'PA > 20')} AS still_ordered,
           {_listed(_flat('', 'PA'), '|', 'rn')} AS pa_only,
           {_listed("name_first || ' ' || name_last || ':' || CAST(PA AS VARCHAR)", '|', 'rn')} AS pretty
    FROM (SELECT *, row_number() OVER (PARTITION BY team_id, year_id ORDER BY PA DESC NULLS LAST,
      player_id NULLS FIRST) AS rn
          FROM seasons)
    WHERE rn <= 4 GROUP BY team_id, year_id
    """,
    ("seasons",),
)
def _(source):
    fields = ["player_id", "name_first", "name_last", "PA"]
    rows = views.seasons(source).select("team_id", "year_id", *fields)
    order = [F.col("PA").desc(), F.col("player_id")]
    listed = nest_top(rows, ["team_id", "year_id"], 4, order, fields, "players")
    by_id = F.sort_array("players")  # structs are ordered by their first field

    def pretty(p):
        return F.concat(p.name_first, F.lit(" "), p.name_last, F.lit(":"), p.PA.cast("string"))

    return listed.select(
        "team_id",
        "year_id",
        F.size(F.array_distinct("players")).cast("bigint").alias("n_distinct"),
        delimited(by_id, "|", "player_id").alias("alt_order"),
        delimited(F.filter("players", lambda p: p.PA > 20), "|", "player_id").alias("still_ordered"),
        delimited("players", "|", "PA").alias("pa_only"),
        F.array_join(F.transform("players", pretty), "|").alias("pretty"),
    )


@query(
    "nest_delimited",
    f"""
    SELECT team_id, year_id, part, n_parks,
      {_listed(_flat('', 'park_id'), '^', 'park_id')} AS park_ids
    FROM (SELECT *, {_part('team_id, year_id', 'park_id')},
                 count(*) OVER (PARTITION BY team_id, year_id) AS n_parks FROM park_team_years)
    GROUP BY team_id, year_id, part, n_parks
    """,
    _STAYS,
)
def _(source):
    nested = bags(_stays(source), ["team_id", "year_id"], ["park_id"], ["park_id"], part_size=PART_SIZE)
    return nested.select(
        "team_id",
        "year_id",
        "part",
        F.col("n_members").alias("n_parks"),
        delimited("bag", "^", "park_id").alias("park_ids"),
    )


@query(
    "nest_kv_string",
    f"""
    SELECT team_id, year_id, part,
      {_listed("coalesce(park_id || ':' || CAST(n_games AS VARCHAR), '')", '|', 'n_games DESC, park_id')} AS pk_ngs
    FROM (SELECT *, {_part('team_id, year_id', 'n_games DESC, park_id')} FROM park_team_years)
    GROUP BY team_id, year_id, part
    """,
    _STAYS,
)
def _(source):
    pair = F.concat("park_id", F.lit(":"), F.col("n_games").cast("string"))
    return bag_text(
        _stays(source),
        ["team_id", "year_id"],
        pair,
        [-F.col("n_games"), F.col("park_id")],
        "|",
        part_size=PART_SIZE,
        name="pk_ngs",
    ).drop("n_members")


@query(
    "nest_distinct_string",
    f"""
    SELECT team_id, part, {_listed(_flat('', 'park_id'), '|', 'park_id')} AS parks
    FROM (SELECT *, {_part('team_id', 'park_id')} FROM (SELECT DISTINCT team_id, park_id
      FROM park_team_years))
    GROUP BY team_id, part
    """,
    _STAYS,
)
def _(source):
    pairs = settle(views.park_team_years(source).select("team_id", "park_id").distinct(), "pairs")
    return bag_text(
        pairs, ["team_id"], F.col("park_id"), [F.col("park_id")], "|", part_size=PART_SIZE, name="parks"
    ).drop("n_members")


@query(
    "nest_sequence",
    f"""
    SELECT player_id, part, {_listed(_flat('|', 'team_id', 'year_id'), '|', 'year_id')} AS teams
    FROM (SELECT *, {_part('player_id', 'year_id')} FROM
            (SELECT player_id, year_id, min(team_id) AS team_id FROM seasons GROUP BY player_id,
              year_id))
    GROUP BY player_id, part
    """,
    ("seasons",),
)
def _(source):
    # of several teams in a year, the first by name
    firsts = views.seasons(source).groupBy("player_id", "year_id").agg(F.min("team_id").alias("team_id"))
    yearly = settle(firsts, "yearly")
    step = flat_text("|", "team_id", "year_id")
    return bag_text(
        yearly, ["player_id"], step, [F.col("year_id")], "|", part_size=PART_SIZE, name="teams"
    ).drop("n_members")


@query(
    "nest_record",
    """
    SELECT player_id, CAST(to_json(struct_pack(name := 'birth', year := birth_year,
      month := coalesce(birth_month, 1),
                                          day := coalesce(birth_day, 1))) AS VARCHAR) AS birth,
           CAST(to_json(struct_pack(name := 'death', year := death_year,
             month := coalesce(death_month, 1),
                               day := coalesce(death_day, 1))) AS VARCHAR) AS death,
           CAST(to_json(struct_pack(name := 'debut', year := CAST(substr(beg_date, 1,
             4) AS INTEGER),
                               month := CAST(substr(beg_date, 6, 2) AS INTEGER),
                               day := CAST(substr(beg_date, 9,
                                 2) AS INTEGER))) AS VARCHAR) AS debut,
           CAST(to_json(struct_pack(name := 'lastg', year := CAST(substr(end_date, 1,
             4) AS INTEGER),
                               month := CAST(substr(end_date, 6, 2) AS INTEGER),
                               day := CAST(substr(end_date, 9,
                                 2) AS INTEGER))) AS VARCHAR) AS lastg,
           CAST(to_json(struct_pack(birth := struct_pack("date" := strftime(try_strptime(CAST(birth_year AS VARCHAR) || '-'
               || CAST(coalesce(birth_month, 1) AS VARCHAR) || '-' || CAST(birth_day AS VARCHAR),
                 '%Y-%m-%d'), '%Y-%m-%d'),
               city := birth_city, state := birth_state, country := birth_country),
             death := struct_pack("date" := strftime(try_strptime(CAST(death_year AS VARCHAR) || '-'
               || CAST(coalesce(death_month, 1) AS VARCHAR) || '-' || CAST(coalesce(death_day,
                 1) AS VARCHAR), '%Y-%m-%d'),
               '%Y-%m-%d'), city := death_city, state := death_state, country := death_country))) AS VARCHAR) AS places,
           CAST(4 AS BIGINT) AS n_occasions
    FROM people WHERE beg_date IS NOT NULL AND death_year IS NOT NULL
    """,
    ("people",),
)
def _(source):
    first = F.lit(1)

    def parts(when: str):
        return {
            "year": F.col(f"{when}_year"),
            "month": F.coalesce(F.col(f"{when}_month"), first),
            "day": F.coalesce(F.col(f"{when}_day"), first),
        }

    def place(when: str):
        day = date_of(F.col(f"{when}_year"), F.col(f"{when}_month"), F.col(f"{when}_day"))
        return record(
            date=day.cast("string"), city=F.col(f"{when}_city"),
            state=F.col(f"{when}_state"), country=F.col(f"{when}_country"),
        )

    def spelled(name: str, text: str):
        def digits(start: int, stop: int):
            return substring_range(F.col(text), start, stop).try_cast("int")

        return record(
            name=F.lit(name), year=digits(0, 4), month=digits(5, 7), day=digits(8, 10)
        )

    occasions = F.array(
        record(name=F.lit("birth"), **parts("birth")),
        record(name=F.lit("death"), **parts("death")),
        spelled("debut", "beg_date"),
        spelled("lastg", "end_date"),
    )
    built = views.people(source).filter("beg_date IS NOT NULL AND death_year IS NOT NULL").select(
        "player_id", occasions.alias("occasions"), record(birth=place("birth"), death=place("death")).alias("places")
    )
    whole = {"ignoreNullFields": "false"}
    return built.select(
        "player_id",
        *[
            F.to_json(F.get("occasions", F.lit(i)), whole).alias(name)
            for i, name in enumerate(["birth", "death", "debut", "lastg"])
        ],
        F.to_json("places", whole).alias("places"),
        F.size("occasions").cast("bigint").alias("n_occasions"),
    )


_PARK = "coalesce(park_id, '')"


@query(
    "nest_set_ops",
    f"""
    WITH stays AS (SELECT DISTINCT team_id, year_id, park_id FROM park_team_years),
    members AS (
      SELECT team_id, year_id, park_id, bool_or(f) AS f, bool_or(NOT f) AS s FROM (
        SELECT team_id, year_id, park_id, TRUE AS f FROM stays
        UNION ALL SELECT team_id, year_id - 1, park_id, FALSE FROM stays)
      GROUP BY team_id, year_id, park_id),
    sizes AS (
      SELECT team_id, year_id, count(*) FILTER (WHERE f) AS n_first, count(*)
        FILTER (WHERE s) AS n_second,
             count(*) FILTER (WHERE f AND s) AS n_stayed,
             CASE WHEN count(*) FILTER (WHERE f <> s) = 0 THEN 1 ELSE 0 END AS is_equal
      FROM members GROUP BY team_id, year_id)
    SELECT team_id, year_id, part, n_first, n_second, n_stayed, is_equal,
      {_listed(_PARK, '|', 'park_id')} AS either,
           {_listed(_PARK, '|', 'park_id', 'f AND s')} AS stayed,
           {_listed(_PARK, '|', 'park_id', 'f AND NOT s')} AS departed,
           {_listed(_PARK, '|', 'park_id', 'NOT f AND s')} AS arrived,
           {_listed(_PARK, '|', 'park_id', 'f <> s')} AS changed
    FROM (SELECT m.*, n_first, n_second, n_stayed, is_equal,
      {_part('m.team_id, m.year_id', 'm.park_id')}
          FROM members m JOIN sizes z
            ON m.team_id IS NOT DISTINCT FROM z.team_id AND m.year_id IS NOT DISTINCT
              FROM z.year_id)
    WHERE n_first > 0 AND n_second > 0 GROUP BY ALL
    """,
    _STAYS,
)
def _(source):
    by = ["team_id", "year_id"]
    # a stay is one row of its team, park and year, and counts for two years
    stays = settle(views.park_team_years(source).select(*by, "park_id"), "stays")
    tasks = tasks_for(2 * stays.count())
    members = settle(set_changes(stays, ["team_id"], "park_id", "year_id", tasks=tasks), "members")
    listed = bags(
        members,
        by,
        ["park_id", "in_first", "in_second"],
        ["park_id"],
        part_size=PART_SIZE,
        totals=set_change_totals(),
    )

    def those(keep):
        return delimited(F.filter("bag", keep), "|", "park_id")

    return listed.filter("n_first > 0 AND n_second > 0").select(
        *by, "part", "n_first", "n_second", "n_stayed", "is_equal",
        delimited("bag", "|", "park_id").alias("either"),
        those(lambda m: m.in_first & m.in_second).alias("stayed"),
        those(lambda m: m.in_first & ~m.in_second).alias("departed"),
        those(lambda m: ~m.in_first & m.in_second).alias("arrived"),
        those(lambda m: m.in_first != m.in_second).alias("changed"),
    )


_CITY_SQL = f"""
    WITH stats AS (
      SELECT team_id, year_id, city, count(*) AS n_parks,
        CAST(sum(n_games) AS BIGINT) AS n_city_games,
             max(n_games) AS max_in_city
      FROM park_cities GROUP BY team_id, year_id, city),
    lists AS (
      SELECT team_id, year_id, city, part,
             {_listed("coalesce(park_id || ':' || CAST(n_games AS VARCHAR), '')", '|', 'n_games DESC, park_id')} AS parks
      FROM (SELECT *, {_part('team_id, year_id, city', 'n_games DESC, park_id')} FROM park_cities)
      GROUP BY team_id, year_id, city, part)
    SELECT s.*, part, parks FROM stats s JOIN lists l
      ON s.team_id IS NOT DISTINCT FROM l.team_id AND s.year_id IS NOT DISTINCT FROM l.year_id
     AND s.city IS NOT DISTINCT FROM l.city
"""


def _city_stats(source):
    """Figures of each team, year and city, with its parks by games."""
    by = ["team_id", "year_id", "city"]
    stays = settle(views.park_cities(source).select(*by, "park_id", "n_games"), "stays")
    figures = {
        "n_parks": F.count("*"),
        "n_city_games": F.sum("n_games"),
        "max_in_city": F.max("n_games"),
    }
    pair = F.concat("park_id", F.lit(":"), F.col("n_games").cast("string"))
    order = [-F.col("n_games"), F.col("park_id")]
    return bag_text(
        stays, by, pair, order, "|", part_size=PART_SIZE, name="parks", totals=figures
    ).drop("n_members")


@query("park_city_stats", _CITY_SQL, ("park_cities",))
def _(source):
    return _city_stats(source)


@query(
    "park_farhome_json",
    f"""
    WITH stats AS (
      SELECT team_id, year_id, city, CAST(sum(n_games) AS BIGINT) AS n_city_games,
        max(n_games) AS max_in_city
      FROM park_cities GROUP BY team_id, year_id, city),
    totals AS (
      SELECT team_id, year_id, CAST(sum(n_city_games) AS BIGINT) AS n_home,
        max(n_city_games) AS main_city,
             max(max_in_city) AS main_park, count(*) AS n_cities
      FROM stats GROUP BY team_id, year_id),
    lists AS (
      SELECT team_id, year_id, part,
             {_listed("coalesce(city || ':' || CAST(n_city_games AS VARCHAR), '')", '|', 'n_city_games DESC, city')} AS cities
      FROM (SELECT *, {_part('team_id, year_id', 'n_city_games DESC, city')} FROM stats)
        GROUP BY team_id, year_id, part)
    SELECT t.team_id, t.year_id, part, CASE WHEN t.year_id >= 1998 THEN 'mod' END AS is_modern,
      n_home AS n_home_gms,
           n_home - main_city AS n_farhome_gms, n_home - main_park AS n_althome_games, n_cities,
             cities
    FROM totals t JOIN lists l
      ON t.team_id IS NOT DISTINCT FROM l.team_id AND t.year_id IS NOT DISTINCT FROM l.year_id
    """,
    ("park_cities",),
)
def _(source):
    by = ["team_id", "year_id"]
    # stored, so that no task holds its stays and its cities at once
    stays = settle(views.park_cities(source).select(*by, "city", "n_games"), "stays")
    cities = stays.groupBy(*by, "city").agg(
        F.sum("n_games").alias("n_city_games"), F.max("n_games").alias("max_in_city")
    )
    stats = settle(cities, "cities")
    totals = {
        "n_home_gms": F.sum("n_city_games"),
        "main_city": F.max("n_city_games"),
        "main_park": F.max("max_in_city"),
        "n_cities": F.count("*"),
    }
    pair = F.concat("city", F.lit(":"), F.col("n_city_games").cast("string"))
    order = [-F.col("n_city_games"), F.col("city")]
    report = bag_text(
        stats, by, pair, order, "|", part_size=PART_SIZE, name="cities", totals=totals
    ).select(
        *by,
        "part",
        F.when(F.col("year_id") >= 1998, "mod").alias("is_modern"),
        "n_home_gms",
        (F.col("n_home_gms") - F.col("main_city")).alias("n_farhome_gms"),
        (F.col("n_home_gms") - F.col("main_park")).alias("n_althome_games"),
        "n_cities",
        "cities",
    )
    path = fresh_path(report.sparkSession, "farhome")
    write_json(report, path)
    return read_json(report.sparkSession, path, report.schema)
