"""The relations the queries run on, built from the driver's tables.

Each view is given twice: as a DataFrame, and as a SQL common table expression for the check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.functions.scalars import ratio, substring_range
from relata.session import buckets, once, settle_bucketed

Source = tuple[SparkSession, str]


def table(source: Source, name: str) -> DataFrame:
    spark, folder = source
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _int(column: Column) -> Column:
    return column.cast("int")


def _by_player(source: Source, name: str, tables: list[str], build, sort: list[str]) -> DataFrame:
    """A relation stored once per application, in buckets of players and sorted inside."""
    spark, folder = source

    def store() -> DataFrame:
        number = buckets(spark)
        return settle_bucketed(
            build(source).repartition(number, "player_id"), ["player_id"], sort, name, number
        )

    return once(spark, name, [f"{folder}/{t}.parquet" for t in tables], store)


def seasons(source: Source) -> DataFrame:
    """The seasons of all players, which later queries share.

    Joins and roll-ups by player read them in place. A player has a row per year and team, so no
    bucket is large.
    """
    return _by_player(
        source, "seasons", ["lineitem", "orders"], _seasons, ["player_id", "year_id", "team_id"]
    )


def people_by_player(source: Source) -> DataFrame:
    """``people``, stored like ``seasons``, so that both meet without a shuffle."""
    return _by_player(source, "people", ["customer"], people, ["player_id"])


def _seasons(source: Source) -> DataFrame:
    """A customer's orders of one year and priority, as a player's season with a team.

    Lines are added up per order before the join, so one order sends one row.
    """
    line = F.col
    lines = (
        table(source, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count("*").alias("PA"),
            F.count_if(line("l_linestatus") == "O").alias("AB"),
            F.count_if(line("l_tax") == 0).alias("HBP"),
            F.count_if(line("l_discount") == 0).alias("SH"),
            F.count_if(line("l_returnflag") == "A").alias("BB"),
            F.count_if(line("l_returnflag") == "R").alias("H"),
            F.count_if((line("l_quantity") >= 10) & (line("l_quantity") < 30)).alias("h1B"),
            F.count_if((line("l_quantity") >= 30) & (line("l_quantity") < 40)).alias("h2B"),
            F.count_if((line("l_quantity") >= 40) & (line("l_quantity") < 45)).alias("h3B"),
            F.count_if(line("l_quantity") >= 45).alias("HR"),
            F.sum("l_linenumber").alias("R"),
            F.sum(line("l_quantity").cast("bigint")).alias("RBI"),
        )
    )
    orders = table(source, "orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("player_id"),
        F.year("o_orderdate").alias("year_id"),
        F.col("o_orderpriority").alias("team_id"),
        F.col("o_orderstatus").alias("lg_id"),
    )
    stats = ["PA", "AB", "HBP", "SH", "BB", "H", "h1B", "h2B", "h3B", "HR", "R", "RBI"]
    joined = orders.join(lines, orders.o_orderkey == lines.l_orderkey)
    totals = joined.groupBy("player_id", "year_id", "team_id").agg(
        F.max("lg_id").alias("lg_id"),
        F.count("*").alias("G"),
        *[F.sum(s).alias(s) for s in stats],
    )
    return totals.select(
        "player_id",
        F.concat(F.lit("N"), (F.col("player_id") % 100).cast("string")).alias("name_first"),
        F.concat(F.lit("Customer#"), F.col("player_id").cast("string")).alias("name_last"),
        "year_id",
        "team_id",
        "lg_id",
        _int(18 + F.col("player_id") % 15 + (F.col("year_id") - 1995)).alias("age"),
        "G",
        *stats,
    )


def careers(source: Source) -> DataFrame:
    """Seasons rolled up to one row per player."""
    return career_totals(seasons(source))


COUNTED = ["G", "PA", "AB", "HBP", "SH", "BB", "H", "h1B", "h2B", "h3B", "HR", "R", "RBI"]


def career_totals(rows: DataFrame) -> DataFrame:
    """Seasons are added up per player and team first, so that teams can be counted as rows."""
    per_team = rows.groupBy("player_id", "team_id").agg(
        F.count("*").alias("n"),
        F.min("year_id").alias("first"),
        F.max("year_id").alias("last"),
        *[F.sum(s).alias(s) for s in COUNTED],
    )
    totals = per_team.groupBy("player_id").agg(
        F.sum("n").alias("n_seasons"),
        F.count("*").alias("card_teams"),
        F.min("first").alias("beg_year"),
        F.max("last").alias("end_year"),
        *[F.sum(s).alias(s) for s in COUNTED],
    )
    return (
        totals.withColumns({"OBP": on_base(), "SLG": slugging()})
        .withColumn("OPS", F.col("OBP") + F.col("SLG"))
    )


def on_base_count() -> Column:
    return F.col("H") + F.col("BB") + F.col("HBP")


def total_bases() -> Column:
    return F.col("h1B") + 2 * F.col("h2B") + 3 * F.col("h3B") + 4 * F.col("HR")


def on_base() -> Column:
    return ratio(on_base_count(), F.col("PA"))


def slugging() -> Column:
    return ratio(total_bases(), F.col("AB"))


def modern(rows: DataFrame) -> DataFrame:
    """Seasons of the two main leagues, with a first year."""
    return rows.filter((F.col("year_id") >= 1996) & ((F.col("lg_id") == "O") | (F.col("lg_id") == "P")))


def people(source: Source) -> DataFrame:
    key = F.col("c_custkey")
    birth_month = F.nullif(_int(key % 13), F.lit(0))
    birth_year = _int(1950 + key % 50)
    birth_day = _int(1 + key % 28)
    month_text = F.lpad(F.coalesce(birth_month, F.lit(1)).cast("string"), 2, "0")
    day_text = F.lpad(birth_day.cast("string"), 2, "0")
    begun = F.concat((birth_year + 20).cast("string"), F.lit("-"), month_text, F.lit("-"), day_text)
    ended = F.concat((birth_year + 25).cast("string"), F.lit("-"), month_text, F.lit("-"), day_text)
    nation = F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))
    return table(source, "customer").select(
        key.alias("player_id"),
        birth_year.alias("birth_year"),
        birth_month.alias("birth_month"),
        birth_day.alias("birth_day"),
        F.when(
            key % 17 != 0, F.concat(F.lit("CITY_"), F.floor(key / 15).cast("string"))
        ).alias("birth_city"),
        F.concat(F.lit("S"), (key % 7).cast("string")).alias("birth_state"),
        nation.alias("birth_country"),
        F.when(key % 4 == 0, birth_year + 60).alias("death_year"),
        F.when(key % 8 == 0, _int(1 + key % 12)).alias("death_month"),
        F.when(key % 8 == 0, _int(1 + key % 30)).alias("death_day"),
        F.when(key % 4 == 0, F.concat(F.lit("CITY_"), (key % 10).cast("string"))).alias("death_city"),
        F.when(key % 4 == 0, F.concat(F.lit("S"), (key % 5).cast("string"))).alias("death_state"),
        F.when(key % 4 == 0, F.concat(F.lit("NATION_"), (key % 25).cast("string"))).alias("death_country"),
        F.col("c_mktsegment").alias("name_first"),
        F.col("c_name").alias("name_last"),
        _int(60 + key % 20).alias("height_in"),
        F.nullif(_int(key % 200), F.lit(0)).alias("weight_lb"),
        F.when(key % 11 != 0, begun).alias("beg_date"),
        F.when(key % 11 != 0, ended).alias("end_date"),
        F.col("c_acctbal").alias("acctbal"),
    )


def places(source: Source) -> DataFrame:
    """A supplier as a named place with a state and a latitude."""
    key = F.col("s_suppkey")
    return table(source, "supplier").select(
        key.alias("geonameid"),
        F.concat(F.lit("CITY_"), key.cast("string")).alias("name"),
        F.concat(F.lit("S"), (key % 7).cast("string")).alias("admin1_code"),
        F.col("s_acctbal").alias("latitude"),
    )


def all_stars(source: Source) -> DataFrame:
    """Honoured seasons; a season may occur more than once. The price stands for a smaller table."""
    return (
        table(source, "orders")
        .filter("o_totalprice > 400000")
        .select(
            F.col("o_custkey").alias("player_id"),
            F.year("o_orderdate").alias("year_id"),
            F.col("o_orderkey").alias("game_id"),
        )
    )


def park_team_years(source: Source) -> DataFrame:
    shipped = F.col("l_shipdate")
    counted = (
        table(source, "lineitem")
        .groupBy("l_partkey", "l_suppkey", F.year(shipped).alias("year_id"))
        .agg(
            F.min(shipped).alias("first"), F.max(shipped).alias("last"), F.count("*").alias("n_games")
        )
    )
    return counted.select(
        F.lpad(F.col("l_partkey").cast("string"), 12, "0").alias("park_id"),
        F.col("l_suppkey").cast("string").alias("team_id"),
        "year_id",
        F.date_format("first", "yyyy-MM-dd").alias("beg_date"),
        F.date_format("last", "yyyy-MM-dd").alias("end_date"),
        "n_games",
    )


def park_cities(source: Source) -> DataFrame:
    """Stays with the city, the leading characters of the park."""
    return park_team_years(source).withColumn("city", substring_range(F.col("park_id"), 0, 10))


def games(source: Source) -> DataFrame:
    """A line of an order as a game: the supplier's nation is at home to the customer's."""
    line = table(source, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_shipdate"
    )
    order = table(source, "orders").select("o_orderkey", "o_custkey")
    customer = table(source, "customer").select("c_custkey", "c_nationkey")
    supplier = table(source, "supplier").select("s_suppkey", "s_nationkey")
    return (
        line.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.concat(
                F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")
            ).alias("game_id"),
            F.year("l_shipdate").alias("year_id"),
            F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("away_team_id"),
            F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("home_team_id"),
            _int(F.col("l_linenumber") * 6).alias("away_runs_ct"),
            _int(F.col("l_quantity")).alias("home_runs_ct"),
        )
    )


def pageviews(source: Source) -> DataFrame:
    return table(source, "events").select(
        F.col("event_type").alias("project_name"),
        F.col("user_id").cast("string").alias("page_title"),
        F.floor("value").cast("bigint").alias("requests"),
        F.col("event_id").alias("bytes"),
    )


def major_cities(source: Source) -> DataFrame:
    """One key set with attributes: nations of wealthy customers."""
    rows = table(source, "customer").filter("c_acctbal > 9700")
    nation = table(source, "nation")
    return rows.join(nation, rows.c_nationkey == nation.n_nationkey).select(
        F.col("n_name").alias("name"),
        F.col("c_custkey").alias("geonameid"),
        F.col("c_acctbal").cast("bigint").alias("population"),
    )


def main_parks(source: Source) -> DataFrame:
    """The other key set with members: nations of wealthy suppliers."""
    rows = table(source, "supplier").filter("s_acctbal > 6000")
    nation = table(source, "nation")
    return rows.join(nation, rows.s_nationkey == nation.n_nationkey).select(
        F.col("n_name").alias("city"), F.col("s_suppkey").alias("park_id")
    )


# The same views in SQL, with the views each one reads.
SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "seasons": (
        (),
        """
        SELECT player_id, 'N' || CAST(player_id % 100 AS VARCHAR) AS name_first,
               'Customer#' || CAST(player_id AS VARCHAR) AS name_last, year_id, team_id,
               lg_id, CAST(18 + player_id % 15 + (year_id - 1995) AS INTEGER) AS age,
               G, PA, AB, HBP, SH, BB, H, h1B, h2B, h3B, HR, R, RBI
        FROM (
          SELECT o_custkey AS player_id, CAST(year(o_orderdate) AS INTEGER) AS year_id,
                 o_orderpriority AS team_id, max(o_orderstatus) AS lg_id,
                 CAST(count(DISTINCT o_orderkey) AS BIGINT) AS G,
                 CAST(count(*) AS BIGINT) AS PA,
                 CAST(count(*) FILTER (WHERE l_linestatus = 'O') AS BIGINT) AS AB,
                 CAST(count(*) FILTER (WHERE l_tax = 0) AS BIGINT) AS HBP,
                 CAST(count(*) FILTER (WHERE l_discount = 0) AS BIGINT) AS SH,
                 CAST(count(*) FILTER (WHERE l_returnflag = 'A') AS BIGINT) AS BB,
                 CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS H,
                 CAST(count(*) FILTER (WHERE l_quantity >= 10
                   AND l_quantity < 30) AS BIGINT) AS h1B,
                 CAST(count(*) FILTER (WHERE l_quantity >= 30
                   AND l_quantity < 40) AS BIGINT) AS h2B,
                 CAST(count(*) FILTER (WHERE l_quantity >= 40
                   AND l_quantity < 45) AS BIGINT) AS h3B,
                 CAST(count(*) FILTER (WHERE l_quantity >= 45) AS BIGINT) AS HR,
                 CAST(sum(l_linenumber) AS BIGINT) AS R,
                 CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS RBI
          FROM orders JOIN lineitem ON l_orderkey = o_orderkey
          GROUP BY o_custkey, year(o_orderdate), o_orderpriority
        )
        """,
    ),
    "careers": (
        ("seasons",),
        """
        SELECT *, OBP + SLG AS OPS FROM (
          SELECT *, CAST(H + BB + HBP AS DOUBLE) / nullif(PA, 0) AS OBP,
                 CAST(h1B + 2 * h2B + 3 * h3B + 4 * HR AS DOUBLE) / nullif(AB, 0) AS SLG
          FROM (
            SELECT player_id, count(*) AS n_seasons,
                   count(DISTINCT team_id) + CASE WHEN count(*) > count(team_id) THEN 1
                     ELSE 0 END AS card_teams,
                   min(year_id) AS beg_year, max(year_id) AS end_year,
        """
        + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in COUNTED)
        + " FROM seasons GROUP BY player_id))",
    ),
    "modern": (("seasons",), "SELECT * FROM seasons WHERE year_id >= 1996 AND lg_id IN ('O', 'P')"),
    "people": (
        (),
        """
        SELECT player_id, birth_year, birth_month, birth_day, birth_city, birth_state,
               birth_country, death_year, death_month, death_day, death_city, death_state,
               death_country, name_first,
               name_last, height_in, weight_lb,
               CASE WHEN player_id % 11 <> 0 THEN CAST(birth_year + 20 AS VARCHAR)
                 || tail END AS beg_date,
               CASE WHEN player_id % 11 <> 0 THEN CAST(birth_year + 25 AS VARCHAR)
                 || tail END AS end_date,
               acctbal
        FROM (
          SELECT *, '-' || lpad(CAST(coalesce(birth_month, 1) AS VARCHAR), 2, '0') || '-'
                    || lpad(CAST(birth_day AS VARCHAR), 2, '0') AS tail
          FROM (
            SELECT c_custkey AS player_id, CAST(1950 + c_custkey % 50 AS INTEGER) AS birth_year,
                   CAST(nullif(c_custkey % 13, 0) AS INTEGER) AS birth_month,
                   CAST(1 + c_custkey % 28 AS INTEGER) AS birth_day,
                   CASE WHEN c_custkey % 17 <> 0
                        THEN 'CITY_' || CAST(c_custkey // 15 AS VARCHAR) END AS birth_city,
                   'S' || CAST(c_custkey % 7 AS VARCHAR) AS birth_state,
                   'NATION_' || CAST(c_nationkey AS VARCHAR) AS birth_country,
                   CASE WHEN c_custkey % 4 = 0
                        THEN CAST(1950 + c_custkey % 50 + 60 AS INTEGER) END AS death_year,
                   CASE WHEN c_custkey % 8 = 0
                        THEN CAST(1 + c_custkey % 12 AS INTEGER) END AS death_month,
                   CASE WHEN c_custkey % 8 = 0
                        THEN CAST(1 + c_custkey % 30 AS INTEGER) END AS death_day,
                   CASE WHEN c_custkey % 4 = 0
                        THEN 'CITY_' || CAST(c_custkey % 10 AS VARCHAR) END AS death_city,
                   CASE WHEN c_custkey % 4 = 0
                        THEN 'S' || CAST(c_custkey % 5 AS VARCHAR) END AS death_state,
                   CASE WHEN c_custkey % 4 = 0
                        THEN 'NATION_' || CAST(c_custkey % 25 AS VARCHAR) END AS death_country,
                   c_mktsegment AS name_first, c_name AS name_last,
                   CAST(60 + c_custkey % 20 AS INTEGER) AS height_in,
                   CAST(nullif(c_custkey % 200, 0) AS INTEGER) AS weight_lb,
                   c_acctbal AS acctbal
            FROM customer))
        """,
    ),
    "places": (
        (),
        """
        SELECT s_suppkey AS geonameid, 'CITY_' || CAST(s_suppkey AS VARCHAR) AS name,
               'S' || CAST(s_suppkey % 7 AS VARCHAR) AS admin1_code, s_acctbal AS latitude
        FROM supplier
        """,
    ),
    "all_stars": (
        (),
        """
        SELECT o_custkey AS player_id, CAST(year(o_orderdate) AS INTEGER) AS year_id,
               o_orderkey AS game_id
        FROM orders WHERE o_totalprice > 400000
        """,
    ),
    "park_team_years": (
        (),
        """
        SELECT lpad(CAST(l_partkey AS VARCHAR), 12, '0') AS park_id,
               CAST(l_suppkey AS VARCHAR) AS team_id,
               CAST(year(l_shipdate) AS INTEGER) AS year_id,
               strftime(min(l_shipdate), '%Y-%m-%d') AS beg_date,
               strftime(max(l_shipdate), '%Y-%m-%d') AS end_date,
               count(*) AS n_games
        FROM lineitem GROUP BY l_partkey, l_suppkey, year(l_shipdate)
        """,
    ),
    "park_cities": (
        ("park_team_years",),
        "SELECT *, substr(park_id, 1, 10) AS city FROM park_team_years",
    ),
    "games": (
        (),
        """
        SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS game_id,
               CAST(year(l_shipdate) AS INTEGER) AS year_id,
               'NATION_' || CAST(c_nationkey AS VARCHAR) AS away_team_id,
               'NATION_' || CAST(s_nationkey AS VARCHAR) AS home_team_id,
               CAST(l_linenumber * 6 AS INTEGER) AS away_runs_ct,
               CAST(trunc(l_quantity) AS INTEGER) AS home_runs_ct
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
        """,
    ),
    "pageviews": (
        (),
        """
        SELECT event_type AS project_name, CAST(user_id AS VARCHAR) AS page_title,
               CAST(floor(value) AS BIGINT) AS requests, event_id AS bytes
        FROM events
        """,
    ),
    "major_cities": (
        (),
        """
        SELECT n_name AS name, c_custkey AS geonameid,
          CAST(trunc(c_acctbal) AS BIGINT) AS population
        FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9700
        """,
    ),
    "main_parks": (
        (),
        """
        SELECT n_name AS city, s_suppkey AS park_id
        FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 6000
        """,
    ),
}


def with_views(query: str, *names: str) -> str:
    """A SQL query preceded by the views it reads."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for inner in SQL[name][0]:
            need(inner)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        need(name)
    if not ordered:
        return query
    body = ",\n".join(f"{name} AS ({SQL[name][1]})" for name in ordered)
    joiner = ",\n" if query.lstrip().upper().startswith("WITH ") else "\n"
    rest = query.lstrip()[5:] if joiner.startswith(",") else query
    return f"WITH {body}{joiner}{rest}"
