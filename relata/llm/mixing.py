"""Operator 2: mixing sources to target weights. Built-in functions only.

Token counts per cell (source, language, topic) are raked until their margins meet the targets
(iterative proportional fitting); a document is then drawn with its cell's calibrated probability.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relata.llm.arrow import settle
from relata.llm.registry import query, table

OTHER = "*"  # stands for nulls and for all values that the targets do not list
SWEEPS = 20
SWEEPS_PER_STEP = 5

Targets = Mapping[str, Mapping[str, float]]

#: Topic by the first pattern that a text holds, else prose.
TOPICS = (
    ("legal", r"(?i)licen[cs]e|rights reserved"),
    ("contact", r"@[A-Za-z0-9]|\+[0-9]"),
    ("tabular", r"\|"),
)

TARGETS: Targets = {
    "source": {f"src{k}": 1.0 for k in range(20)},
    "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15},
    "topic": {"prose": 0.92, "contact": 0.03, "legal": 0.03, "tabular": 0.02},
}


def topic(text: Column) -> Column:
    chosen = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        chosen = F.when(F.rlike(text, F.lit(pattern)), F.lit(name)).otherwise(chosen)
    return chosen


def _category(value: Column, weights: Mapping[str, float]) -> Column:
    listed = [name for name in weights if name != OTHER]
    return F.when(value.isin(*listed), value).otherwise(F.lit(OTHER)) if listed else F.lit(OTHER)


def _share(dimension: str, weights: Mapping[str, float]) -> tuple[Column, Column, Column]:
    """Of a cell: its part of the given weight, the share left to unlisted values, its target share.

    Listed categories without tokens give their share to the others. Unlisted values keep their
    natural share unless ``*`` has a weight.
    """
    alike, everything = Window.partitionBy(dimension), Window.partitionBy()
    given = F.lit(0.0)
    for name, weight in weights.items():
        given = F.when(F.col(dimension) == name, float(weight)).otherwise(given)
    # the cells of a category share its weight by their tokens, so that it counts once
    mine = given * F.col("tokens") / F.sum("tokens").over(alike)
    others = F.when(F.col(dimension) == OTHER, F.col("tokens")).otherwise(0.0)
    free = F.lit(0.0)
    if OTHER not in weights:
        free = F.sum(others).over(everything) / F.sum("tokens").over(everything)
    whole = F.col(f"whole_{dimension}")
    listed = F.when(whole > 0, given / whole).otherwise(0.0) * (1 - F.col(f"free_{dimension}"))
    unlisted = F.lit(OTHER not in weights) & (F.col(dimension) == OTHER)
    share = F.when(unlisted, F.col(f"free_{dimension}")).otherwise(listed)
    return mine, free, share


def calibrate(cells: DataFrame, targets: Targets, sweeps: int = SWEEPS) -> DataFrame:
    """Raked weights of ``cells`` (a column per dimension, tokens).

    Returns the dimensions, tokens, weight (raked over natural tokens) and probability: the weight
    over the largest one, so that the sample is as large as the targets allow. There are at most as
    many cells as the targets list combinations, so they stay in one partition, where the windows
    of the sweeps need no shuffle; every few sweeps the masses are stored.
    """
    everything = Window.partitionBy()
    table_ = cells.where("tokens > 0").withColumn("tokens", F.col("tokens").cast("double"))
    table_ = table_.coalesce(1)
    for d in targets:
        mine, free, share = _share(d, targets[d])
        table_ = table_.withColumns({f"mine_{d}": mine, f"free_{d}": free})
        table_ = table_.withColumn(f"whole_{d}", F.sum(f"mine_{d}").over(everything))
        table_ = table_.withColumn(f"share_{d}", share)
    table_ = table_.withColumn("mass", F.col("tokens") / F.sum("tokens").over(everything))
    kept = [*targets, "tokens", *[f"share_{d}" for d in targets], "mass"]
    table_ = settle(table_.select(*kept), "masses").coalesce(1)
    for done in range(1, sweeps + 1):
        for d in targets:
            margin = F.sum("mass").over(Window.partitionBy(d))
            scaled = F.col("mass") * F.col(f"share_{d}") / margin
            table_ = table_.withColumn("mass", F.when(margin > 0, scaled).otherwise(0.0))
        if done % SWEEPS_PER_STEP == 0:
            table_ = settle(table_, "masses").coalesce(1)
    weight = F.col("mass") * F.sum("tokens").over(everything) / F.col("tokens")
    weighed = table_.withColumn("weight", weight)
    chance = F.col("weight") / F.max("weight").over(everything)
    return weighed.select(*targets, "tokens", "weight", chance.alias("probability"))


def draw(doc_id: Column, seed: int) -> Column:
    """A number below 1 that only the document and the seed decide."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)


def mix(
    documents: DataFrame, targets: Targets = TARGETS, seed: int = 17, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Each row of ``documents`` (doc_id, text, source, lang) with its chance and its draw.

    Returns doc_id, source, lang, topic, n_tokens, weight, probability, sampled and the columns
    named in ``carry``. In expectation the tokens of the sampled rows meet the targets of every
    dimension.

    Nulls and values that the targets do not list form the category ``*``. A null or empty text
    has no tokens; a row of a cell without tokens gets weight and probability 0. Rows without
    doc_id share one draw, as do repeated rows. Other columns are left out. No rows give no rows.
    """
    rows = documents.select(
        "doc_id",
        "source",
        "lang",
        topic(F.coalesce("text", F.lit(""))).alias("topic"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
        .cast("long")
        .alias("n_tokens"),
        *[F.col(c).alias(f"carried_{c}") for c in carry],
    )
    rows = rows.select(
        "*",
        *[_category(F.col(d), targets[d]).alias(f"cell_{d}") for d in targets],
    )
    counted = (
        rows.groupBy(*[F.col(f"cell_{d}").alias(d) for d in targets])
        .agg(F.sum("n_tokens").alias("tokens"))
    )
    cells = settle(calibrate(settle(counted, "cells"), targets), "calibrated")
    cells = cells.select(*[F.col(d).alias(f"cell_{d}") for d in targets], "weight", "probability")
    joined = rows.join(F.broadcast(cells), [f"cell_{d}" for d in targets], "left")
    chance = F.coalesce("probability", F.lit(0.0))
    return joined.select(
        "doc_id",
        "source",
        "lang",
        "topic",
        "n_tokens",
        F.coalesce("weight", F.lit(0.0)).alias("weight"),
        chance.alias("probability"),
        (draw(F.col("doc_id"), seed) < chance).alias("sampled"),
        *[F.col(f"carried_{c}").alias(c) for c in carry],
    )


def _sql(targets: Targets = TARGETS, seed: int = 17, sweeps: int = SWEEPS) -> str:
    def listed(names) -> str:
        return ", ".join(f"'{n}'" for n in names)

    topics = " ".join(
        f"WHEN regexp_matches(coalesce(text, ''), '{pattern}') THEN '{name}'"
        for name, pattern in TOPICS
    )
    parts = [
        f"docs AS (SELECT doc_id, source, lang, CASE {topics} ELSE 'prose' END AS topic,"
        r" len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens"
        " FROM documents)",
        "named AS (SELECT *, "
        + ", ".join(
            f"CASE WHEN {d} IN ({listed(targets[d])}) THEN {d} ELSE '*' END AS cell_{d}"
            for d in targets
        )
        + " FROM docs)",
        "cells AS (SELECT "
        + ", ".join(f"cell_{d}" for d in targets)
        + ", sum(n_tokens)::DOUBLE AS tokens FROM named GROUP BY ALL HAVING sum(n_tokens) > 0)",
        "step0 AS MATERIALIZED (SELECT *, tokens / sum(tokens) OVER () AS mass FROM cells)",
    ]
    for d in targets:
        values = ", ".join(f"('{n}', {w!r})" for n, w in targets[d].items())
        parts += [
            f"present_{d} AS (SELECT cell_{d}, sum(tokens) AS tokens, any_value(w) AS w FROM cells"
            f" LEFT JOIN (VALUES {values}) AS t(name, w) ON cell_{d} = name GROUP BY cell_{d})",
            f"free_{d} AS (SELECT coalesce(sum(tokens) FILTER (WHERE cell_{d} = '*'), 0)"
            f" / sum(tokens) AS free, sum(w) AS whole FROM present_{d})",
            f"share_{d} AS MATERIALIZED (SELECT cell_{d},"
            f" CASE WHEN cell_{d} = '*' THEN free ELSE w / whole * (1 - free) END AS share"
            f" FROM present_{d}, free_{d})",
        ]
    step = 0
    for _ in range(sweeps):
        for d in targets:
            parts.append(
                f"step{step + 1} AS MATERIALIZED (SELECT * EXCLUDE (share) REPLACE (mass * share"
                f" / sum(mass) OVER (PARTITION BY cell_{d}) AS mass)"
                f" FROM step{step} JOIN share_{d} USING (cell_{d}))"
            )
            step += 1
    parts.append(
        f"raked AS (SELECT *, mass * (SELECT sum(tokens) FROM cells) / tokens AS weight"
        f" FROM step{step})"
    )
    keys = " AND ".join(f"n.cell_{d} = r.cell_{d}" for d in targets)
    return (
        "WITH "
        + ",\n".join(parts)
        + "\nSELECT doc_id, source, lang, topic, n_tokens, round(coalesce(weight, 0), 6) AS weight,"
        " round(coalesce(weight / (SELECT max(weight) FROM raked), 0), 6) AS probability,"
        f" ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT"
        " / 4503599627370496.0 < coalesce(weight / (SELECT max(weight) FROM raked), 0) AS sampled"
        f" FROM named n LEFT JOIN raked r ON {keys}"
    )


@query("op2_source_mixing", _sql())
def op2(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix(table(spark, folder, "documents"))
    return mixed.withColumns(
        {"weight": F.round("weight", 6), "probability": F.round("probability", 6)}
    )
