"""Boosted trees and measures on rows that stand for many."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from lodegraph.operators import metrics as M
from lodegraph.operators import ml


def test_equal_training_rows_are_one_row_of_their_weight(spark, monkeypatch):
    rows = spark.range(600).select(
        F.pmod("id", F.lit(5)).cast("double").alias("a"), F.when(F.pmod("id", F.lit(3)) == 0, "x").otherwise("y").alias("c"), F.lit(1.0).alias("w")
    )
    rows = rows.withColumn("y", F.when(F.col("a") > 2, F.when(F.col("c") == "x", 1.0).otherwise(0.6)).otherwise(0.1))
    other = rows.select("a", "c").distinct()
    gbt = GBTRegressor(featuresCol="features", labelCol="y", weightCol="w", maxIter=5, maxDepth=3, stepSize=0.05, seed=0)
    whole = Pipeline(stages=[*ml.feature_pipeline(["a"], ["c"]), gbt]).fit(rows).transform(other)
    want = {(r.a, r.c): r.prediction for r in whole.collect()}
    seen, fit = [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, df: (seen.append(df.count()), fit(self, df))[1])
    got = {(r.a, r.c): r.model_score for r in ml.boosted_scores(rows, other, ["a"], ["c"], "y", "w", 5, 3).collect()}
    assert seen == [10]
    assert got == pytest.approx(want) and len(set(want.values())) > 2


def test_measures_of_counted_rows(spark):
    counted = spark.createDataFrame([(0.9, 1, 3), (0.9, 0, 2), (0.4, 1, 1), (0.2, 0, 5)], "s double, y int, n long")
    rows = counted.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n"))))
    assert M.roc_auc(counted, "s", "y", "n").head() == M.roc_auc(rows, "s", "y").head()
    assert M.average_precision(counted, "s", "y", "n").head() == M.average_precision(rows, "s", "y").head()
