"""No side of a join that grows unseen by the optimizer is broadcast."""

from __future__ import annotations

from pyspark.sql import functions as F

from relata.operators.joins import left_salted
from tests.conftest import rows


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_salted_left_side_is_not_broadcast(spark):
    """Its copies come after its size is known: sixteen times what the optimizer takes it for."""
    left = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("l"))
    right = spark.range(0, 5000, 3).select(F.col("id").alias("k"), F.col("id").cast("string").alias("r"))
    joined = left_salted(left, right, ["k"])
    on_salt = [x for x in executed(joined).splitlines() if "Join" in x and "__salt" in x]
    assert on_salt and all("SortMergeJoin" in x for x in on_salt)
    assert rows(joined) == rows(left.join(right, "k", "left"))
