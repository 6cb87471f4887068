"""A learning run: labels, splits, model scores, capped and calibrated rankings and their measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators import learning as L
from lodegraph.operators import metrics as M
from lodegraph.operators import ml
from lodegraph.runtime import Scratch


def run_learning(spark: SparkSession, candidates: DataFrame, numbers: Sequence[str], categories: Sequence[str], out_dir: str, rounds: int = 30) -> dict[str, float]:
    """Write `ranking` and `measures`; returns the measures on the test split.

    candidates: uid, group, support_class, p, articles, sentences, is_known and the feature columns.
    """
    scratch = Scratch(spark, "learning")
    label = L.weak_label(F.col("support_class"), F.col("p"), F.col("articles"), F.col("sentences"), F.col("is_known").cast("int"))
    c = candidates.select("*", label.alias("_l")).select("*", F.col("_l.weak_label"), F.col("_l.label_score").alias("target")).drop("_l")
    c = c.withColumn("split", L.split_of(F.col("group")))
    c = scratch.save(L.sample_weights(c, ["split", "weak_label"], F.col("weak_label") == "strong_positive"))
    used = c.filter("weak_label <> 'abstain'")
    scored = scratch.save(ml.boosted_scores(used.filter("split = 'train'"), c, numbers, categories, "target", "weight", rounds, 4))
    scored = scored.withColumn("positive", (F.col("target") > 0.7).cast("int"))
    calibrated = ml.isotonic(scored.filter("split = 'validation' and weak_label <> 'abstain'"), scored, "model_score", "positive")
    ranking = scratch.save(calibrated.withColumn("score", L.capped(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("calibrated"))), F.col("weak_label"))))
    ranking.select("uid", "weak_label", "split", "model_score", "score").write.mode("overwrite").parquet(f"{out_dir}/ranking")
    test = ranking.filter("split = 'test' and weak_label <> 'abstain'").select("uid", "score", "positive", (2 * F.col("positive")).alias("label"))
    parts = (M.roc_auc(test, "score", "positive"), M.average_precision(test, "score", "positive"), M.calibration(test, "score", "label"))
    measures = {k: v for df in parts for k, v in df.head().asDict().items()}
    rows = [(k, float(v) if v is not None else None) for k, v in measures.items()]
    spark.createDataFrame(rows, "metric string, value double").write.mode("overwrite").parquet(f"{out_dir}/measures")
    return dict(rows)
