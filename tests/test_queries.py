"""Every registered query against its SQL, and the plans of some."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as contract
from relata.plans.registry import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
# rows through a Python worker, or pairs of all rows of two tables
SLOW = (
    "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin",
)


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return connection


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def comparable(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(value):
        return "~" if value is None else repr(float(value)) if isinstance(value, float) else str(value)

    return sorted([text(row[i]) for i in order] for row in data)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    for operator in SLOW:
        assert operator not in plan(df)
    found = duck.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert comparable(df.columns, df.collect()) == comparable(columns, found.fetchall())


def test_entry(spark):
    df = contract.entry(spark)
    assert "OPS" in df.columns and df.count() > 0


def test_filters_and_columns_reach_the_scan(spark, data):
    text = plan(QUERIES["set_minus_ab"](spark, data))
    assert "PushedFilters: [IsNotNull(c_acctbal), GreaterThan(c_acctbal,9700.0)" in text
    assert "c_mktsegment" not in text


def test_top_rows_are_limited_before_the_shuffle(spark, data):
    text = plan(QUERIES["topk_team_list"](spark, data))
    above, below = text.split("row_number(), 4, Final", 1)
    assert "Exchange hashpartitioning(team_id" in below.split("row_number(), 4, Partial", 1)[0]
    assert "TakeOrderedAndProject" in plan(QUERIES["topk_global"](spark, data))


def test_sums_are_combined_before_the_shuffle(spark, data):
    text = plan(QUERIES["agg_composite"](spark, data))
    assert text.index("functions=[count(1), sum(") < text.index("Exchange") < text.index("partial_count(1)")
