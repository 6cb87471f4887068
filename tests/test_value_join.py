"""Pairs within a tolerance where many rows share a value."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import resolve as R


@pytest.mark.parametrize("per_task", [7, 1_000_000])
def test_value_join(spark, per_task):
    rows = [(i, None if i % 17 == 0 else 5.0 if i % 3 == 0 else (i % 40) / 10) for i in range(120)]
    left = spark.createDataFrame(rows, "a int, x double")
    right = spark.createDataFrame(rows[::2], "b int, y double")
    got = Counter((r.a, r.b) for r in R.value_join(left, "x", right, "y", 0.25, per_task).collect())
    assert got == Counter((a, b) for a, x in rows for b, y in rows[::2] if None not in (x, y) and abs(x - y) <= 0.25)
    assert R.value_join(left.filter("x > 99"), "x", right, "y", 0.25).count() == 0


def test_one_value_is_divided_over_tasks(spark):
    left = spark.range(1000).select(F.col("id").alias("a"), F.lit(1.0).alias("x"))
    right = spark.range(1000).select(F.col("id").alias("b"), F.lit(1.1).alias("y"))
    out = R.value_join(left, "x", right, "y", 0.25, 50_000).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in out) == 1_000_000 and len(out) >= 4 and max(r["count"] for r in out) <= 500_000
