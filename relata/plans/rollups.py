"""Aggregates, field summaries and histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from relata.functions.scalars import ratio
from relata.operators import histograms as hist
from relata.operators import sketches
from relata.operators.aggregate import (
    cardinality,
    count_by,
    count_flags,
    share_in_group,
    sums_by_subset,
    with_share,
)
from relata.operators.nesting import flat_text
from relata.operators.numbering import attach, number_rows
from relata.operators.selection import quantiles_by_selection
from relata.operators.summaries import (
    EDGES,
    describe_numeric,
    describe_numeric_sketched,
    describe_text,
    quantiles,
    quantiles_approx,
)
from relata.plans import views
from relata.plans.registry import query
from relata.operators.delays import bad_lines, delay_histogram
from relata.session import fresh_path, settle


@query("agg_count", "SELECT project_name, count(*) AS ct FROM pageviews GROUP BY project_name", ("pageviews",))
def _(source):
    return count_by(views.pageviews(source), "project_name")


@query(
    "agg_sum_sorted",
    """
    SELECT row_number() OVER (ORDER BY total_pageviews DESC, project_name) AS row_no, * FROM (
      SELECT project_name, CAST(sum(requests) AS BIGINT) AS total_pageviews,
        CAST(sum(bytes) AS BIGINT) AS total_bytes
      FROM pageviews GROUP BY project_name)
    """,
    ("pageviews",),
)
def _(source):
    totals = views.pageviews(source).groupBy("project_name").agg(
        F.sum("requests").alias("total_pageviews"), F.sum("bytes").alias("total_bytes")
    )
    return number_rows(totals, [F.col("total_pageviews").desc(), F.col("project_name")])


@query("agg_career", "SELECT * FROM careers", ("careers",))
def _(source):
    return views.careers(source)


@query(
    "agg_global",
    """
    SELECT count(*) AS n_players, count(OPS) AS n_known, min(beg_year) AS first_year,
      max(end_year) AS last_year,
           CAST(sum(HR) AS BIGINT) AS HR, CAST(sum(H) AS DOUBLE) / count(*) AS avg_H FROM careers
    """,
    ("careers",),
)
def _(source):
    return views.careers(source).agg(
        F.count("*").alias("n_players"),
        F.count("OPS").alias("n_known"),
        F.min("beg_year").alias("first_year"),
        F.max("end_year").alias("last_year"),
        F.sum("HR").alias("HR"),
        ratio(F.sum("H"), F.count("*")).alias("avg_H"),
    )


@query(
    "agg_composite",
    """
    SELECT year_id, team_id, count(*) AS n_parks, CAST(sum(n_games) AS BIGINT) AS n_games
    FROM park_team_years GROUP BY year_id, team_id
    """,
    ("park_team_years",),
)
def _(source):
    return views.park_team_years(source).groupBy("year_id", "team_id").agg(
        F.count("*").alias("n_parks"), F.sum("n_games").alias("n_games")
    )


@query(
    "agg_distinct",
    """
    SELECT birth_state, count(DISTINCT birth_city)
           + CASE WHEN count(*) > count(birth_city) THEN 1 ELSE 0 END AS n_cities
    FROM people GROUP BY birth_state
    """,
    ("people",),
)
def _(source):
    return cardinality(views.people(source), ["birth_state"], "birth_city", "n_cities")


@query(
    "agg_two_level",
    """
    SELECT CAST(sum(total_players) AS DOUBLE) / count(*) AS avg_players,
      max(total_players) AS max_players FROM (
      SELECT team_id, year_id, count(*) AS total_players FROM seasons GROUP BY team_id, year_id)
    """,
    ("seasons",),
)
def _(source):
    sizes = count_by(views.seasons(source), "team_id", "year_id", name="total_players")
    return sizes.agg(
        ratio(F.sum("total_players"), F.count("*")).alias("avg_players"),
        F.max("total_players").alias("max_players"),
    )


@query(
    "agg_rel_freq",
    """
    SELECT HR AS val, count(*) AS ct, CAST(count(*) AS DOUBLE) / (SELECT count(*)
      FROM careers) AS freq
    FROM careers GROUP BY HR
    """,
    ("careers",),
)
def _(source):
    return with_share(hist.histogram(views.careers(source), "HR"))


@query(
    "agg_indicators",
    """
    SELECT player_id, count(*) AS n_seasons,
           count(*) FILTER (WHERE H >= 3) AS hi_H, count(*) FILTER (WHERE HR >= 1) AS hi_HR,
           count(*) FILTER (WHERE RBI >= 100) AS hi_RBI,
           count(*) FILTER (WHERE CAST(H + BB + HBP AS DOUBLE) / nullif(PA, 0) >= 0.4) AS hi_OBP,
           count(*) FILTER (WHERE CAST(h1B + 2 * h2B + 3 * h3B + 4 * HR AS DOUBLE) / nullif(AB,
             0) >= 0.5) AS hi_SLG
    FROM modern GROUP BY player_id
    """,
    ("modern",),
)
def _(source):
    reached = {
        "hi_H": F.col("H") >= 3,
        "hi_HR": F.col("HR") >= 1,
        "hi_RBI": F.col("RBI") >= 100,
        "hi_OBP": views.on_base() >= 0.4,
        "hi_SLG": views.slugging() >= 0.5,
    }
    return views.modern(views.seasons(source)).groupBy("player_id").agg(
        F.count("*").alias("n_seasons"), *count_flags(reached)
    )


_BANDS = {"all": "TRUE", "young": "age <= 21", "prime": "age >= 22 AND age <= 29", "older": "age >= 30"}
_EPOCH_SUMS = ", ".join(
    f"CAST(coalesce(sum({amount}) FILTER (WHERE {cond}), 0) AS BIGINT) AS {name}_{band}"
    for band, cond in _BANDS.items()
    for name, amount in {
        "n": "1", "PA": "PA", "AB": "AB", "OB": "H + BB + HBP", "TB": "h1B + 2 * h2B + 3 * h3B + 4 * HR"
    }.items()
)
_EPOCH_OPS = ", ".join(
    f"CASE WHEN {'TRUE' if band == 'all' else f'PA_{band} >= 10'} THEN CAST(OB_{band} AS DOUBLE) / nullif(PA_{band}, 0)"
    f" + CAST(TB_{band} AS DOUBLE) / nullif(AB_{band}, 0) END AS OPS_{band}"
    for band in _BANDS
)
EPOCHS_SQL = f"""
    SELECT player_id, PA_all, PA_young, PA_prime, PA_older, beg_year, end_year, {_EPOCH_OPS},
           n_all AS n_seasons, n_young, n_prime, n_older
    FROM (SELECT player_id, min(year_id) AS beg_year, max(year_id) AS end_year, {_EPOCH_SUMS}
          FROM modern GROUP BY player_id)
"""


def epochs(source):
    """Career figures for all seasons and for three bands of age, in one pass."""
    age = F.col("age")
    bands = {
        "all": F.lit(True),
        "young": age <= 21,
        "prime": (age >= 22) & (age <= 29),
        "older": age >= 30,
    }
    amounts = {
        "n": F.lit(1),
        "PA": F.col("PA"),
        "AB": F.col("AB"),
        "OB": views.on_base_count(),
        "TB": views.total_bases(),
    }
    sums = views.modern(views.seasons(source)).groupBy("player_id").agg(
        F.min("year_id").alias("beg_year"),
        F.max("year_id").alias("end_year"),
        *sums_by_subset(bands, amounts),
    )

    def ops(band: str):
        value = ratio(F.col(f"OB_{band}"), F.col(f"PA_{band}")) + ratio(
            F.col(f"TB_{band}"), F.col(f"AB_{band}")
        )
        enough = F.lit(True) if band == "all" else F.col(f"PA_{band}") >= 10
        return F.when(enough, value).alias(f"OPS_{band}")

    return sums.select(
        "player_id",
        *[f"PA_{b}" for b in bands],
        "beg_year",
        "end_year",
        *[ops(b) for b in bands],
        F.col("n_all").alias("n_seasons"),
        "n_young",
        "n_prime",
        "n_older",
    )


@query("agg_epochs", EPOCHS_SQL, ("modern",))
def _(source):
    return epochs(source)


def _quantile_sql(column: str, edges: dict[str, float]) -> str:
    return ", ".join(f"quantile_disc({column}, {p}) AS {n}" for n, p in edges.items())


def _numeric_sql(relation: str, column: str, by: str = "") -> str:
    """The summary of one column; examples are the five smallest distinct values."""
    key = f"{by}, " if by else ""
    match = f"WHERE e.{by} IS NOT DISTINCT FROM s.{by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    over = f"PARTITION BY {by}" if by else ""
    edges = _quantile_sql(column, {"p01": 0.01, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99})
    return f"""
    SELECT s.*, (SELECT coalesce(string_agg(CAST(v AS VARCHAR), '^' ORDER BY v), '') FROM
                   (SELECT *, row_number() OVER ({over} ORDER BY v) AS rn FROM
                      (SELECT DISTINCT {key}{column} AS v FROM {relation}
                        WHERE {column} IS NOT NULL)) e
                 {match + ' AND' if match else 'WHERE'} e.rn <= 5) AS some_vals
    FROM (SELECT {key}CAST(sum({column}) AS DOUBLE) / count({column}) AS avg_val,
                 round(stddev_pop({column}), 6) AS stddev_val,
                   CAST(min({column}) AS BIGINT) AS min_val, {edges},
                 CAST(max({column}) AS BIGINT) AS max_val, count(*) AS n_recs,
                 count(*) - count({column}) AS n_nulls,
                 count(DISTINCT {column}) + CASE WHEN count(*) > count({column}) THEN 1
                   ELSE 0 END AS cardinality,
                 CAST(sum({column}) AS DECIMAL(38,0)) AS sum_val
          FROM {relation} {group}) s
    """


def _rounded(summary):
    name = "stddev_val" if "stddev_val" in summary.columns else "stdvlen"
    return summary.withColumn(name, F.round(name, 6))


@query("sum_numeric", _numeric_sql("(SELECT CAST(weight_lb AS BIGINT) AS weight_lb FROM people)", "weight_lb"), ("people",))
def _(source):
    return _rounded(describe_numeric(views.people(source), F.col("weight_lb").cast("bigint")))


@query("sum_numeric_by", _numeric_sql("documents", "n_chars", "lang"))
def _(source):
    return _rounded(describe_numeric(views.table(source, "documents"), F.col("n_chars"), ["lang"]))


@query(
    "sum_string",
    """
    SELECT 'birth_city' AS var, min(length(birth_city)) AS minlen, """
    + _quantile_sql(
        "CAST(length(birth_city) AS BIGINT)",
        {"p01": 0.01, "p05": 0.05, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99},
    )
    + """, max(length(birth_city)) AS maxlen,
           CAST(sum(length(birth_city)) AS DOUBLE) / count(birth_city) AS avglen,
           round(stddev_pop(length(birth_city)), 6) AS stdvlen,
             CAST(sum(length(birth_city)) AS BIGINT) AS sumlen,
           count(*) AS n_recs, count(*) - count(birth_city) AS n_nulls,
           count(DISTINCT birth_city) + CASE WHEN count(*) > count(birth_city) THEN 1
             ELSE 0 END AS cardinality,
           min(birth_city) AS minval, max(birth_city) AS maxval,
           (SELECT coalesce(string_agg(CASE WHEN length(v) > 15 THEN substr(v, 1, 15) || '…'
             ELSE v END, '^' ORDER BY v), '') FROM
              (SELECT DISTINCT birth_city AS v FROM people WHERE birth_city IS NOT NULL
                ORDER BY v LIMIT 5)) AS examples
    FROM people
    """,
    ("people",),
)
def _(source):
    summary = _rounded(describe_text(views.people(source), "birth_city"))
    lengths = ["minlen", "maxlen", "sumlen", "p01", "p05", "p10", "p50", "p90", "p95", "p99"]
    return summary.withColumns({c: F.col(c).cast("bigint") for c in lengths})


@query(
    "sum_quantiles",
    "SELECT l_returnflag, "
    + _quantile_sql("l_extendedprice", {"p01": 0.01, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99})
    + " FROM lineitem GROUP BY l_returnflag",
)
def _(source):
    lines = views.table(source, "lineitem")
    return quantiles(lines, F.col("l_extendedprice"), ["l_returnflag"])


@query(
    "sum_quantiles_selected",
    "SELECT "
    + _quantile_sql("o_totalprice", {"p01": 0.01, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99})
    + " FROM orders",
)
def _(source):
    return quantiles_by_selection(views.table(source, "orders"), F.col("o_totalprice"))


@query(
    "sum_quantiles_dates",
    "SELECT o_orderpriority, "
    + _quantile_sql("CAST(o_orderdate AS DATE)", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    + " FROM orders GROUP BY o_orderpriority",
)
def _(source):
    orders = views.table(source, "orders")
    edges = {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    return quantiles(orders, F.col("o_orderdate").cast("date"), ["o_orderpriority"], edges)


@query(
    "sum_quantiles_approx",
    """
    SELECT l_returnflag, TRUE AS p01, TRUE AS p05, TRUE AS p50, TRUE AS p95, TRUE AS p99
    FROM lineitem GROUP BY l_returnflag
    """,
)
def _(source):
    """Whether the sketched quantiles are within the promised rank error."""
    accuracy = 1000
    price = F.col("l_extendedprice")
    lines = views.table(source, "lineitem").select("l_returnflag", "l_extendedprice")
    found = quantiles_approx(lines, price, ["l_returnflag"], accuracy=accuracy)
    both = attach(lines, found, ["l_returnflag"])
    ranks = both.groupBy("l_returnflag").agg(
        F.count("l_extendedprice").alias("n"),
        *[F.count_if(price < F.col(name)).alias(f"below_{name}") for name in EDGES],
        *[F.count_if(price <= F.col(name)).alias(f"upto_{name}") for name in EDGES],
    )

    def near(name: str, share: float):
        error = F.col("n") / accuracy + 1
        low, high = F.col(f"below_{name}"), F.col(f"upto_{name}")
        return (low - error <= share * F.col("n")) & (share * F.col("n") <= high + error)

    return ranks.select("l_returnflag", *[near(n, p).alias(n) for n, p in EDGES.items()])


def _in_parts(source, make, label: str):
    """The figures that ``make`` gets from seasons, stored by year: first the early years, then the
    later ones beside them, of which alone rows are read."""
    spark = source[0]
    seasons = views.seasons(source)
    path = fresh_path(spark, label)
    for years in ("year_id < 1996 OR year_id IS NULL", "year_id >= 1996"):
        figures = make(seasons.filter(years))
        sketches.add_part(figures.withColumn("part", F.col("year_id")), path, "part")
    return sketches.read_parts(spark, path, figures)


@query(
    "sum_quantiles_merged",
    """
    SELECT team_id, count(RBI) AS n, TRUE AS p01, TRUE AS p05, TRUE AS p50, TRUE AS p95, TRUE AS p99
    FROM seasons GROUP BY team_id
    """,
    ("seasons",),
)
def _(source):
    """Whether quantiles of a team, merged from its years' sketches, are within the promised error."""
    stored = _in_parts(
        source,
        lambda rows: sketches.quantile_sketches(rows, ["team_id", "year_id"], F.col("RBI")),
        "quantile-sketches",
    )
    found = settle(sketches.merge_quantiles(stored, ["team_id"], EDGES), "merged-quantiles")
    both = attach(views.seasons(source).select("team_id", "RBI"), found, ["team_id"])
    ranks = both.groupBy("team_id").agg(
        F.max("n").alias("n"),
        *[F.count_if(F.col("RBI") < F.col(name)).alias(f"below_{name}") for name in EDGES],
        *[F.count_if(F.col("RBI") <= F.col(name)).alias(f"upto_{name}") for name in EDGES],
    )

    def near(name: str, share: float):
        error = sketches.RANK_ERROR * F.col("n") + 1
        low, high = F.col(f"below_{name}"), F.col(f"upto_{name}")
        return (low - error <= share * F.col("n")) & (share * F.col("n") <= high + error)

    return ranks.select("team_id", "n", *[near(n, p).alias(n) for n, p in EDGES.items()])


@query(
    "agg_distinct_bitmap",
    """
    SELECT 'team' AS level, team_id AS name, count(DISTINCT player_id) AS n_players
    FROM seasons GROUP BY team_id
    UNION ALL
    SELECT 'year', CAST(year_id AS VARCHAR), count(DISTINCT player_id) FROM seasons GROUP BY year_id
    """,
    ("seasons",),
)
def _(source):
    """Players of each team and of each year, from one store of bitmaps per team and year."""
    stored = _in_parts(
        source,
        lambda rows: sketches.distinct_bitmaps(rows, ["team_id", "year_id"], "player_id"),
        "bitmaps",
    )
    levels = [("team", "team_id"), ("year", "year_id")]
    counted = [
        sketches.count_bitmaps(stored, [column], "n_players").select(
            F.lit(level).alias("level"), F.col(column).cast("string").alias("name"), "n_players"
        )
        for level, column in levels
    ]
    return counted[0].unionByName(counted[1])


@query("hist_plain", "SELECT birth_month AS val, count(*) AS ct FROM people GROUP BY birth_month", ("people",))
def _(source):
    return hist.histogram(views.people(source), "birth_month")


@query(
    "hist_binned",
    "SELECT CAST(5 * floor(PA / 5.0) AS BIGINT) AS val, count(*) AS ct FROM careers GROUP BY 1",
    ("careers",),
)
def _(source):
    return hist.histogram(views.careers(source), hist.floor_bin(F.col("PA"), 5))


@query(
    "hist_round_bins",
    "SELECT CAST(100 * floor((c_acctbal - 5000) / 100.0 + 0.5) AS BIGINT) AS val, count(*) AS ct FROM customer GROUP BY 1",
)
def _(source):
    balance = F.col("c_acctbal") - 5000
    return hist.histogram(views.table(source, "customer"), hist.round_bin(balance, 100))


@query(
    "hist_ceil_bins",
    "SELECT CAST(10 * ceil(weight_lb / 10.0) AS BIGINT) AS val, count(*) AS ct FROM people GROUP BY 1",
    ("people",),
)
def _(source):
    return hist.histogram(views.people(source), hist.ceil_bin(F.col("weight_lb"), 10))


@query(
    "hist_log",
    """
    SELECT CAST(trunc(exp(floor(ln(CASE WHEN requests = 0 THEN 0.001
      ELSE CAST(requests AS DOUBLE) END) * 10) / 10.0))
                AS BIGINT) AS bin, count(*) AS ct
    FROM pageviews GROUP BY 1
    """,
    ("pageviews",),
)
def _(source):
    return hist.histogram(views.pageviews(source), hist.log_bin(F.col("requests")), "bin")


@query(
    "hist_binned_filled",
    """
    SELECT coalesce(b.bin, v.bin) AS bin, coalesce(n, 0) AS ct
    FROM (SELECT 3 * number AS bin FROM range(0, 10000) t(number) WHERE 3 * number <= 150) b
    FULL OUTER JOIN (SELECT CAST(floor(PA / 3.0) * 3 AS BIGINT) AS bin, count(*) AS n
      FROM careers GROUP BY 1) v
      ON b.bin = v.bin
    """,
    ("careers",),
)
def _(source):
    return hist.fill_to(views.careers(source), F.col("PA"), 3, 150)


@query(
    "hist_filled",
    """
    WITH binned AS (
      SELECT CAST(10 * floor(o_totalprice / 10.0 + 0.5) AS BIGINT) AS bin, count(*) AS n
      FROM orders GROUP BY 1)
    SELECT b.bin, coalesce(n, 0) AS total
    FROM (SELECT 10 * number AS bin FROM range(0, 1000000) t(number)
          WHERE 10 * number <= (SELECT max(bin) FROM binned)) b
    LEFT JOIN binned ON b.bin = binned.bin
    """,
)
def _(source):
    orders = views.table(source, "orders")
    return hist.fill_gaps(orders, hist.round_bin(F.col("o_totalprice"), 10), 10)


@query(
    "hist_examples",
    """
    WITH vals AS (SELECT player_id, name_first, name_last, count(*) AS bin FROM seasons
                  GROUP BY player_id, name_first, name_last)
    SELECT bin, count(*) AS ct,
           string_agg(coalesce(name_first, '') || '|' || coalesce(name_last, ''), '|' ORDER BY rn)
             FILTER (WHERE rn <= 3) AS examples
    FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY player_id NULLS FIRST) AS rn
      FROM vals) GROUP BY bin
    """,
    ("seasons",),
)
def _(source):
    vals = count_by(views.seasons(source), "player_id", "name_first", "name_last", name="bin")
    example = flat_text("|", "name_first", "name_last")
    return hist.with_examples(vals, "bin", example, [F.col("player_id")])


_IN_GROUP = """
    SELECT year_bin, H_bin, count(*) AS ct,
           CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY year_bin) AS freq
    FROM (SELECT CAST(2 * floor(year_id / 2.0 + 0.5) AS BIGINT) AS year_bin,
                 CAST(3 * floor(H / 3.0 + 0.5) AS BIGINT) AS H_bin FROM modern)
    GROUP BY year_bin, H_bin
"""


def _shares(source):
    binned = views.modern(views.seasons(source)).select(
        hist.round_bin(F.col("year_id"), 2).alias("year_bin"),
        hist.round_bin(F.col("H"), 3).alias("H_bin"),
    )
    return share_in_group(binned, ["year_bin"], "H_bin")


@query("hist_in_group", _IN_GROUP, ("modern",))
def _(source):
    return _shares(source)


@query(
    "hist_in_group_text",
    f"""
    SELECT year_bin, part, string_agg(txt, '  ' ORDER BY H_bin) AS line FROM (
      SELECT year_bin, H_bin, printf('%d=%.0f%%', H_bin, floor(100 * freq + 0.5)) AS txt,
             (row_number() OVER (PARTITION BY year_bin ORDER BY H_bin) - 1) // 1000 AS part
      FROM ({_IN_GROUP}) WHERE H_bin >= 3)
    GROUP BY year_bin, part
    """,
    ("modern",),
)
def _(source):
    visible = _shares(source).filter("H_bin >= 3")
    percent = F.floor(100 * F.col("freq") + 0.5).cast("double")
    text = F.format_string("%d=%.0f%%", F.col("H_bin"), percent)
    return hist.as_lines(visible, "year_bin", "H_bin", text, 1000).drop("n_members")


@query(
    "mr_delay_hist",
    """
    SELECT CAST(floor((epoch(l_shipdate) - epoch(o_orderdate)) / 86400.0) AS BIGINT) AS days,
      count(*) AS ct
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey
    WHERE o_orderdate IS NOT NULL AND l_shipdate IS NOT NULL GROUP BY 1
    """,
)
def _(source):
    return delay_histogram(_reports(source))


@query(
    "mr_bad_lines",
    r"""
    SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END
      || chr(9) || strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') || chr(9) || l_returnflag AS value
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey
    WHERE o_orderkey % 10 = 0
    """,
)
def _(source):
    reports = _reports(source, F.when(F.col("o_orderkey") % 10 == 0, "unknown"))
    return bad_lines(reports)


@query(
    "sum_sketched",
    """
    SELECT lang, count(*) AS n_recs, count(*) - count(n_chars) AS n_nulls,
      CAST(min(n_chars) AS BIGINT) AS min_val, CAST(max(n_chars) AS BIGINT) AS max_val,
      CAST(sum(n_chars) AS BIGINT) AS sum_val, round(avg(n_chars), 6) AS avg_val,
      TRUE AS close_cardinality, TRUE AS close_median
    FROM documents GROUP BY lang
    """,
)
def _(source):
    """The exact figures as they are, of the sketched ones whether they are near."""
    documents = views.table(source, "documents").select("lang", "n_chars")
    found = describe_numeric_sketched(documents, F.col("n_chars"), ["lang"], accuracy=1000)
    exact = documents.groupBy("lang").agg(
        (F.count_distinct("n_chars") + (F.count_if(F.col("n_chars").isNull()) > 0).cast("int"))
        .alias("exact")
    )
    below = attach(documents, found.select("lang", "p50"), ["lang"]).groupBy("lang").agg(
        (F.count_if(F.col("n_chars") <= F.col("p50")) / F.count("n_chars")).alias("share")
    )
    both = attach(attach(found, exact, ["lang"]), below, ["lang"])
    return both.select(
        "lang",
        "n_recs",
        "n_nulls",
        "min_val",
        "max_val",
        F.col("sum_val").cast("bigint").alias("sum_val"),
        F.round("avg_val", 6).alias("avg_val"),
        (F.abs(F.col("cardinality") - F.col("exact")) <= 0.2 * F.col("exact")).alias("close_cardinality"),
        (F.abs(F.col("share") - 0.5) <= 0.05).alias("close_median"),
    )


def _reports(source, begun=None):
    """Lines of order date, ship date and flag; ``begun`` takes the place of the date it is known for."""
    orders = views.table(source, "orders").select("o_orderkey", "o_orderdate")
    lines = views.table(source, "lineitem").select("l_orderkey", "l_shipdate", "l_returnflag")
    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    first = F.date_format("o_orderdate", iso)
    if begun is not None:
        first = F.coalesce(begun, first)
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey).select(
        flat_text("\t", first, F.date_format("l_shipdate", iso), "l_returnflag").alias("value")
    )
