"""Projection, scalar functions, filters, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from relata.functions.dates import date_of, date_of_text, instant
from relata.functions.hashing import bytes_in_hex, murmur3_long, murmur3_sql
from relata.functions.scalars import (
    ratio,
    round_half_up,
    shorten,
    substring_range,
    whole_ratio,
)
from relata.operators.aggregate import count_by, first_of_unique, never
from relata.operators.rows import (
    column_range,
    hash_sample,
    prefix_sample,
    random_sample,
    split_tagged,
    where_matches,
)
from relata.plans import views
from relata.plans.registry import query


@query(
    "proj_trim",
    "SELECT away_team_id, home_team_id, home_runs_ct, away_runs_ct FROM games",
    ("games",),
)
def _(source):
    return views.games(source).select("away_team_id", "home_team_id", "home_runs_ct", "away_runs_ct")


@query(
    "proj_range",
    "SELECT year_id, team_id, lg_id, age, G, PA, player_id AS keep_id FROM seasons",
    ("seasons",),
)
def _(source):
    rows = views.seasons(source)
    return rows.select(*column_range(rows, "year_id", "PA"), F.col("player_id").alias("keep_id"))


@query(
    "proj_core_stats",
    """
    SELECT player_id, year_id, team_id, TB, OBP, SLG, SLG + OBP AS OPS FROM (
      SELECT player_id, year_id, team_id, h1B + 2 * h2B + 3 * h3B + 4 * HR AS TB,
             CAST(H + BB + HBP AS DOUBLE) / PA AS OBP,
             CAST(h1B + 2 * h2B + 3 * h3B + 4 * HR AS DOUBLE) / AB AS SLG
      FROM seasons WHERE PA > 0 AND AB > 0)
    """,
    ("seasons",),
)
def _(source):
    played = views.seasons(source).filter("PA > 0 AND AB > 0")
    return (
        played.withColumns(
            {"TB": views.total_bases(), "OBP": views.on_base(), "SLG": views.slugging()}
        )
        .withColumn("OPS", F.col("SLG") + F.col("OBP"))
        .select("player_id", "year_id", "team_id", "TB", "OBP", "SLG", "OPS")
    )


@query(
    "proj_types",
    """
    SELECT player_id, team_id, CAST(year_id AS VARCHAR) AS year_text,
           CAST(CAST(ob AS DOUBLE) / PA AS FLOAT) AS obp_float,
           CAST(ob AS DOUBLE) / PA AS obp_double,
           CAST(CAST(ob AS FLOAT) / CAST(PA AS FLOAT) AS FLOAT) AS obp_cast,
           CAST(ob // PA AS FLOAT) AS obp_broken,
           CAST(substr(CAST(year_id AS VARCHAR), 3, 2) AS INTEGER) AS short_year,
           TRY_CAST(team_id AS INTEGER) AS not_a_number
    FROM (SELECT *, H + BB + HBP AS ob FROM seasons WHERE PA > 0 AND AB > 0)
    """,
    ("seasons",),
)
def _(source):
    played = views.seasons(source).filter("PA > 0 AND AB > 0")
    reached, chances = views.on_base_count(), F.col("PA")
    return played.select(
        "player_id",
        "team_id",
        F.col("year_id").cast("string").alias("year_text"),
        ratio(reached, chances).cast("float").alias("obp_float"),
        ratio(reached, chances).alias("obp_double"),
        (reached.cast("float") / chances.cast("float")).cast("float").alias("obp_cast"),
        whole_ratio(reached, chances).cast("float").alias("obp_broken"),
        substring_range(F.col("year_id").cast("string"), 2, 4).try_cast("int").alias("short_year"),
        F.col("team_id").try_cast("int").alias("not_a_number"),
    )


@query(
    "proj_rounding",
    """
    SELECT player_id, year_id, team_id, floor(1000 * v + 0.5) / 1000 AS rounded,
           trunc(1000 * v) / 1000 AS truncated, floor(1000 * v) / 1000 AS floored,
           ceil(1000 * v) / 1000 AS raised,
           printf('%5.3f', floor(1000 * v + 0.5) / 1000) AS as_text, v AS full_value
    FROM (SELECT *, CAST(H + BB + HBP AS DOUBLE) / PA AS v FROM seasons WHERE PA > 0)
    """,
    ("seasons",),
)
def _(source):
    value = views.on_base()
    milli = 1000 * value
    return views.seasons(source).filter("PA > 0").select(
        "player_id",
        "year_id",
        "team_id",
        (round_half_up(milli) / F.lit(1000.0)).alias("rounded"),
        (milli.cast("bigint") / F.lit(1000.0)).alias("truncated"),
        (F.floor(milli) / F.lit(1000.0)).alias("floored"),
        (F.ceil(milli) / F.lit(1000.0)).alias("raised"),
        F.format_string("%5.3f", value).alias("as_text"),
        value.alias("full_value"),
    )


@query(
    "str_report_line",
    """
    SELECT player_id, team_id,
           rpad(coalesce(name_last, 'null'), CAST(greatest(20, coalesce(length(name_last),
             4)) AS INTEGER), ' ') || '|' || coalesce(printf('%6d', year_id), '  null') || '|'
           || printf('%8.3f', floor(1000 * v + 0.5) / 1000) || '|'
           || printf('%.2e', CASE WHEN v = 0 THEN 0.0 ELSE floor(v * pow(10,
             2 - e) + 0.5) / pow(10, 2 - e) END)
           AS line
    FROM (SELECT *, CASE WHEN v = 0 THEN 0 ELSE floor(log10(v)) END AS e
          FROM (SELECT *, CAST(H + BB + HBP AS DOUBLE) / PA AS v FROM seasons WHERE PA > 0))
    """,
    ("seasons",),
)
def _(source):
    # left-aligned, with a width, and one argument written twice
    line = F.format_string(
        "%2$-20s|%1$6d|%3$8.3f|%3$.2e", F.col("year_id"), F.col("name_last"), views.on_base()
    )
    return views.seasons(source).filter("PA > 0").select("player_id", "team_id", line.alias("line"))


@query(
    "str_date_parts",
    """
    SELECT player_id, CAST(birth_year AS VARCHAR) || '-' || CAST(birth_month AS VARCHAR) || '-'
                      || CAST(birth_day AS VARCHAR) AS birth_date,
           CASE WHEN length(birth_country) > 8 THEN substr(birth_country, 1, 8) || '…'
                ELSE birth_country END AS short_country,
           length(name_last) AS name_size
    FROM people
    """,
    ("people",),
)
def _(source):
    parts = [F.col(f"birth_{p}").cast("string") for p in ("year", "month", "day")]
    return views.people(source).select(
        "player_id",
        F.concat(parts[0], F.lit("-"), parts[1], F.lit("-"), parts[2]).alias("birth_date"),
        shorten(F.col("birth_country"), 8).alias("short_country"),
        F.length("name_last").cast("bigint").alias("name_size"),
    )


@query(
    "date_convert",
    """
    SELECT player_id, strftime(try_strptime(CAST(birth_year AS VARCHAR) || '-'
             || CAST(coalesce(birth_month, 1) AS VARCHAR) || '-' || CAST(coalesce(birth_day,
               1) AS VARCHAR),
             '%Y-%m-%d'), '%Y-%m-%d') AS birth_dt,
           strftime(try_strptime(CAST(death_year AS VARCHAR) || '-'
             || CAST(coalesce(death_month, 1) AS VARCHAR) || '-' || CAST(coalesce(death_day,
               1) AS VARCHAR),
             '%Y-%m-%d'), '%Y-%m-%d') AS death_dt,
           CAST(epoch(try_strptime(beg_date, '%Y-%m-%d')) AS BIGINT) AS beg_second,
           strftime(try_strptime(end_date, '%Y-%m-%d'), '%Y-%m-%d') AS end_dt
    FROM people
    WHERE beg_date IS NOT NULL AND end_date IS NOT NULL AND birth_year IS NOT NULL
      AND death_year IS NOT NULL
    """,
    ("people",),
)
def _(source):
    known = views.people(source).filter(
        "beg_date IS NOT NULL AND end_date IS NOT NULL AND birth_year IS NOT NULL AND death_year IS NOT NULL"
    )
    birth = date_of(F.col("birth_year"), F.col("birth_month"), F.col("birth_day"))
    death = date_of(F.col("death_year"), F.col("death_month"), F.col("death_day"))
    begun = instant(F.concat(F.col("beg_date"), F.lit("T00:00:00.000Z")))
    return known.select(
        "player_id",
        birth.cast("string").alias("birth_dt"),
        death.cast("string").alias("death_dt"),
        F.unix_seconds(begun).alias("beg_second"),
        date_of_text(F.col("end_date")).cast("string").alias("end_dt"),
    )


@query(
    "agg_by_month",
    "SELECT substr(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ'), 6, 2) AS month, count(*) AS total "
    "FROM orders GROUP BY 1",
)
def _(source):
    sighted = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    months = views.table(source, "orders").select(substring_range(sighted, 5, 7).alias("month"))
    return count_by(months, "month", name="total")


@query("flt_compare", "SELECT * FROM games WHERE home_runs_ct > away_runs_ct", ("games",))
def _(source):
    return views.games(source).filter("home_runs_ct > away_runs_ct")


@query(
    "flt_compound",
    """
    SELECT player_id, year_id, team_id, lg_id, PA FROM seasons
    WHERE PA >= 3 AND year_id >= 1996 AND (lg_id = 'O' OR lg_id = 'F') AND NOT (age > 40)
    """,
    ("seasons",),
)
def _(source):
    league = (F.col("lg_id") == "O") | (F.col("lg_id") == "F")
    return (
        views.seasons(source)
        .filter((F.col("PA") >= 3) & (F.col("year_id") >= 1996) & league & ~(F.col("age") > 40))
        .select("player_id", "year_id", "team_id", "lg_id", "PA")
    )


@query(
    "flt_known",
    """
    SELECT * FROM (SELECT birth_city || ',' || birth_state || ',' || birth_country AS birth_place,
                          player_id, death_year FROM people)
    WHERE birth_place IS NOT NULL AND length(birth_place) > 2 AND death_year IS NULL
    """,
    ("people",),
)
def _(source):
    comma = F.lit(",")
    place = F.concat("birth_city", comma, "birth_state", comma, "birth_country")
    placed = views.people(source).select(place.alias("birth_place"), "player_id", "death_year")
    return placed.filter(
        (F.length("birth_place") > 2) & F.col("birth_place").isNotNull() & F.col("death_year").isNull()
    )


@query(
    "flt_regex",
    "SELECT p_partkey, p_name FROM part WHERE regexp_full_match(p_name, '(?i).*(RING|widg+et|LARGE b).*')",
)
def _(source):
    parts = views.table(source, "part").select("p_partkey", "p_name")
    return where_matches(parts, "p_name", "(?i).*(RING|widg+et|LARGE b).*")


@query(
    "flt_in",
    "SELECT * FROM park_team_years WHERE team_id IN ('1', '2', '3', '5', '8', '13', '21', '34', '55')",
    ("park_team_years",),
)
def _(source):
    return views.park_team_years(source).filter(
        F.col("team_id").isin("1", "2", "3", "5", "8", "13", "21", "34", "55")
    )


@query(
    "sample_prefix",
    "SELECT c_custkey, c_name FROM customer WHERE substr(CAST(c_custkey AS VARCHAR), 1, 1) = '7'",
)
def _(source):
    return prefix_sample(views.table(source, "customer").select("c_custkey", "c_name"), "c_custkey", "7")


@query(
    "sample_hash",
    """
    SELECT md5(CAST(player_id AS VARCHAR)) AS keep_hash, player_id, year_id, team_id, PA
    FROM seasons WHERE substr(md5(CAST(player_id AS VARCHAR)), 1, 1) = '0'
    """,
    ("seasons",),
)
def _(source):
    rows = views.seasons(source).select("player_id", "year_id", "team_id", "PA")
    return hash_sample(rows, "player_id")


def _murmur3_sample_sql() -> str:
    hashed = murmur3_sql("player_id", "(SELECT player_id, year_id, team_id, PA FROM seasons)")
    digits = "lpad(lower(hex(hash)), 8, '0')"
    swapped = " || ".join(f"substr({digits}, {at}, 2)" for at in (7, 5, 3, 1))
    return f"""
    SELECT * FROM (
      SELECT {swapped} AS keep_hash, player_id, year_id, team_id, PA FROM ({hashed})
    ) WHERE substr(keep_hash, 1, 1) = '0'
    """


@query("sample_murmur3", _murmur3_sample_sql(), ("seasons",))
def _(source):
    rows = views.seasons(source).select("player_id", "year_id", "team_id", "PA")
    digest = bytes_in_hex(murmur3_long(F.col("player_id")), 4)
    return hash_sample(rows, "player_id", digest=digest)


@query(
    "sample_random",
    "SELECT TRUE AS share_is_near, TRUE AS all_from_table, count(*) AS n_rows FROM customer",
)
def _(source):
    """Whether a tenth of the rows was drawn, within six deviations, each from the table."""
    customers = views.table(source, "customer").select("c_custkey")
    drawn = random_sample(customers, 0.10, seed=42).select("c_custkey", F.lit(1).alias("drawn"))
    rows = customers.withColumn("drawn", F.lit(0)).unionByName(drawn).groupBy("c_custkey").agg(
        F.sum("drawn").alias("times"), F.count_if(F.col("drawn") == 0).alias("there")
    )
    n, taken = F.sum("there"), F.sum("times")
    return rows.agg(
        (F.abs(taken - 0.10 * n) <= 6 * F.sqrt(0.09 * n) + 1).alias("share_is_near"),
        F.bool_and(F.col("times") <= F.col("there")).alias("all_from_table"),
        n.alias("n_rows"),
    )


@query(
    "limit_any",
    "SELECT least(count(*), 25) AS n_rows, TRUE AS all_from_table FROM orders",
)
def _(source):
    """How many rows a limit gives, and whether the table has them all."""
    orders = views.table(source, "orders").select("o_orderkey")
    some = orders.limit(25).withColumn("taken", F.lit(1))
    rows = orders.withColumn("taken", F.lit(0)).unionByName(some).groupBy("o_orderkey").agg(
        F.sum("taken").alias("taken"), F.count_if(F.col("taken") == 0).alias("there")
    )
    return rows.agg(
        F.sum("taken").alias("n_rows"),
        F.bool_and(F.col("taken") <= F.col("there")).alias("all_from_table"),
    )


@query(
    "split_ranges",
    """
    SELECT player_id, year_id, team_id, age, 'young' AS bucket FROM seasons WHERE age <= 30
    UNION ALL
    SELECT player_id, year_id, team_id, age, 'middle' FROM seasons WHERE age >= 30 AND age < 35
    UNION ALL
    SELECT player_id, year_id, team_id, age, 'old' FROM seasons
    WHERE NOT (age <= 30) AND NOT (age >= 30 AND age < 35)
    """,
    ("seasons",),
)
def _(source):
    age = F.col("age")
    return split_tagged(
        views.seasons(source).select("player_id", "year_id", "team_id", "age"),
        {"young": age <= 30, "middle": (age >= 30) & (age < 35)},
        otherwise="old",
    )


@query(
    "having_never",
    "SELECT player_id FROM seasons GROUP BY player_id HAVING max(CASE WHEN team_id = '1-URGENT' THEN 1 ELSE 0 END) = 0",
    ("seasons",),
)
def _(source):
    return never(views.seasons(source), "player_id", F.col("team_id") == "1-URGENT")


@query(
    "having_vagabonds",
    "SELECT team_id, year_id, count(*) AS n_parks FROM park_team_years GROUP BY team_id, year_id HAVING count(*) >= 90",
    ("park_team_years",),
)
def _(source):
    stays = count_by(views.park_team_years(source), "team_id", "year_id", name="n_parks")
    return stays.filter("n_parks >= 90")


@query(
    "having_unique",
    """
    SELECT sha256(text) AS text_key, min(doc_id) AS doc_id, min(n_chars) AS n_chars
    FROM documents GROUP BY sha256(text) HAVING count(*) = 1
    """,
)
def _(source):
    texts = views.table(source, "documents").select(
        F.sha2(F.col("text").cast("binary"), 256).alias("key"), "doc_id", "n_chars"
    )
    return first_of_unique(texts, F.col("key"), "text_key", ["doc_id", "n_chars"])
