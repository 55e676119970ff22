"""Sources and sinks: a table is written to the shared folder in some format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from relata.operators.joins import tagged_lines
from relata.operators.nesting import bags, unnest
from relata.operators.rows import split_tagged
from relata.plans import views
from relata.plans.matching import tagged_text
from relata.plans.registry import query
from relata.session import fresh_path, settle
from relata.sources import text
from relata.sources.bagtext import accepted, bags_to_lines, lines_to_bags, rejects


@query(
    "src_tsv",
    "SELECT player_id, birth_year, birth_month, birth_city, death_year, name_first, name_last, weight_lb, beg_date FROM people",
    ("people",),
)
def _(source):
    rows = views.people(source).select(
        "player_id", "birth_year", "birth_month", "birth_city", "death_year", "name_first", "name_last", "weight_lb",
        "beg_date",
    )
    path = fresh_path(source[0], "people")
    text.write_separated(rows, path)
    return text.read_separated(source[0], path, rows.schema)


@query("src_space_gz", "SELECT * FROM pageviews", ("pageviews",))
def _(source):
    rows = views.pageviews(source)
    path = fresh_path(source[0], "pagecounts")
    # a gzip file cannot be divided, so its rows are bounded
    text.write_separated(rows, path, separator=" ", compression="gzip", rows_per_file=1_000_000)
    return text.read_separated(source[0], path + "/*.gz", rows.schema, separator=" ")


@query("src_bz2", "SELECT * FROM games", ("games",))
def _(source):
    rows = views.games(source)
    path = fresh_path(source[0], "games")
    text.write_separated(rows, path, compression="bzip2")
    return text.read_separated(source[0], path, rows.schema)


@query("src_glob", "SELECT * FROM park_team_years", ("park_team_years",))
def _(source):
    rows = views.park_team_years(source)
    path = fresh_path(source[0], "park-parts")
    text.write_separated(rows, path)
    return text.read_separated(source[0], path + "/part-*", rows.schema)


@query(
    "src_tagged_lines",
    """
    SELECT 'dimension' AS shape, coalesce(n_name, '') AS name, NULL AS status,
           coalesce(CAST(n_nationkey AS VARCHAR), '') AS code FROM nation
    UNION ALL SELECT 'fact', coalesce(c_name, ''), coalesce(c_mktsegment, ''),
      coalesce(CAST(c_nationkey AS VARCHAR), '')
    FROM customer
    """,
)
def _(source):
    path = fresh_path(source[0], "tagged")
    text.write_lines(tagged_text(source), path)
    shapes = tagged_lines(text.read_lines(source[0], path))
    nations = shapes["dimension"].select(
        F.lit("dimension").alias("shape"), "name", F.lit(None).cast("string").alias("status"), "code"
    )
    persons = shapes["fact"].select(F.lit("fact").alias("shape"), F.col("person").alias("name"), "status", "code")
    return nations.unionByName(persons)


@query("sink_roundtrip", "SELECT * FROM careers", ("careers",))
def _(source):
    return text.through_store(views.careers(source), "careers")


@query("sink_nested_roundtrip", "SELECT team_id, park_id, year_id FROM park_team_years", ("park_team_years",))
def _(source):
    stays = settle(views.park_team_years(source).withColumn("year", F.col("year_id").cast("bigint")), "stays")
    nested = bags(stays, ["team_id"], ["year", "park_id"], ["year", "park_id"], part_size=1000, bag="park_years")
    path = fresh_path(source[0], "bag-of-park-years")
    text.write_table(nested, path)
    # the years come back as a smaller type than they were written in
    stored = text.read_table(
        source[0], path, "team_id string, park_years array<struct<year:int,park_id:string>>"
    )
    return unnest(stored, "park_years").select("team_id", "park_id", F.col("year").alias("year_id"))


@query(
    "sink_bag_text",
    """
    SELECT team_id, park_id, year_id, beg_date, 0 AS n_rejected FROM park_team_years
    UNION ALL SELECT NULL, NULL, NULL, NULL, 3
    """,
    ("park_team_years",),
)
def _(source):
    """Bags written as text and read back; of three more lines none is a bag."""
    spark = source[0]
    stays = settle(views.park_team_years(source).select("team_id", "park_id", "year_id", "beg_date"), "stays")
    nested = bags(
        stays, ["team_id"], ["year_id", "park_id", "beg_date"], ["year_id", "park_id"],
        part_size=1000, bag="park_years",
    )
    path = fresh_path(spark, "bag-of-park-years")
    text.write_lines(bags_to_lines(nested.select("team_id", "park_years")), path)
    broken = spark.sql("SELECT explode(array('t', 't\t{(1995,a,b)', 't\t{(1995,a)}')) AS value")
    lines = text.read_lines(spark, path).unionByName(broken)
    schema = "team_id string, park_years array<struct<year_id:int,park_id:string,beg_date:string>>"
    # stored, so that lines are checked once for the bags and for the rejects
    read = settle(lines_to_bags(lines, schema), "read")
    members = unnest(accepted(read), "park_years").withColumn("n_rejected", F.lit(0))
    count = rejects(read).agg(F.count("*").cast("int").alias("n_rejected"))
    return members.unionByName(count, allowMissingColumns=True)


@query(
    "sink_split",
    """
    SELECT player_id, year_id, age, 'young' AS bucket FROM seasons WHERE age <= 30
    UNION ALL SELECT player_id, year_id, age, 'middle' FROM seasons WHERE age >= 30 AND age < 35
    UNION ALL SELECT player_id, year_id, age, 'old' FROM seasons WHERE age >= 35
    """,
    ("seasons",),
)
def _(source):
    age = F.col("age")
    tagged = split_tagged(
        views.seasons(source).select("player_id", "year_id", "age"),
        {"young": age <= 30, "middle": (age >= 30) & (age < 35)},
        otherwise="old",
    )
    path = fresh_path(source[0], "seasons-by-age")
    text.write_table(tagged, path, by=["bucket"])
    return text.read_table(source[0], path, stored=tagged.schema)
