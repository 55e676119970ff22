"""Exact quantiles by selection against those by a sort, and what is sorted."""

from __future__ import annotations

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from relata.operators import selection
from relata.operators.selection import quantiles_by_selection
from relata.operators.summaries import quantiles

EDGES = {"least": 0.0, "p01": 0.01, "p50": 0.5, "p95": 0.95, "p999": 0.999, "most": 1.0}
DRAW = random.Random(5)
DAY = datetime.date(2020, 1, 1)
COLUMNS = {
    "near unique doubles": ("double", [DRAW.gauss(0, 1) * 10 ** DRAW.randrange(12) for _ in range(30_000)]),
    "a hot value": ("double", [0.5 if i % 3 else DRAW.random() for i in range(9_000)]),
    "one outlier": ("double", [*[DRAW.random() for _ in range(5_000)], 1e300, -1e300, math.inf]),
    "not numbers": ("double", [*[DRAW.random() for _ in range(500)], *[math.nan] * 100, None]),
    "big whole numbers": ("bigint", [2**63 - 1 - DRAW.randrange(10_000) for _ in range(3_000)]),
    "dates": ("date", [DAY + datetime.timedelta(DRAW.randrange(4_000)) for _ in range(2_000)] + [None] * 50),
    "one value": ("int", [7]),
    "equal values": ("int", [7] * 500),
    "nulls alone": ("int", [None] * 5),
    "nothing": ("double", []),
}


@pytest.mark.parametrize("name", COLUMNS)
@pytest.mark.parametrize("accuracy", [50, 1000])
def test_selection_equals_the_sort(spark, name, accuracy):
    kind, values = COLUMNS[name]
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}").repartition(5)
    got = quantiles_by_selection(df, F.col("v"), EDGES, accuracy)
    want = quantiles(df, F.col("v"), (), EDGES)
    assert got.columns == want.columns and [t for _, t in got.dtypes] == [t for _, t in want.dtypes]
    assert [str(tuple(r)) for r in got.collect()] == [str(tuple(r or [])) for r in want.collect()] or (
        not [v for v in values if v is not None] and tuple(got.head()) == (None,) * len(EDGES)
    )


def test_only_values_inside_the_brackets_are_ranked(spark):
    values = [DRAW.random() for _ in range(50_000)]
    known = spark.createDataFrame([(v,) for v in values], "value double")
    found = selection.brackets(known, {"p50": 0.5, "p95": 0.95}, 1_000)
    ordered = sorted(values)
    for (_, each), share in zip(found.items(), (0.5, 0.95)):
        assert each.low <= ordered[math.ceil(share * 50_000) - 1] <= each.high
        assert known.filter(each.holds(F.col("value"))).count() < 50_000 * 8 / 1_000
        assert each.below == sum(v < each.low for v in values)


def test_a_wrong_bracket_is_widened(spark, monkeypatch):
    values = [float(v) for v in range(1_000)]
    known = spark.createDataFrame([(v,) for v in values], "value double")
    wrong = lambda column, shares, accuracy: F.array(*[F.lit(v) for v in (900.0, 901.0, 3.0, 4.0)])
    monkeypatch.setattr(selection.F, "percentile_approx", wrong)
    got = quantiles_by_selection(known, F.col("value"), {"p50": 0.5, "p95": 0.95}).head()
    assert tuple(got) == (499.0, 949.0)
