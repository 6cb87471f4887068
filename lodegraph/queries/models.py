"""Models over the embeddings, documents and candidate relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators import learning as L
from lodegraph.operators import metrics as M
from lodegraph.operators import ml
from lodegraph.queries.learning import _candidates, _rounded, _with_labels
from lodegraph.runtime import Scratch, table

C = F.col


def nearest_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors of every twentieth one, among all."""
    e = table(spark, d, "embeddings")
    out = ml.nearest_neighbours(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", 5)
    return out.withColumn("cosine", F.round("cosine", 6))


def vector_clusters(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    c = ml.clusters(e, "vec_id", "embedding", 8, seed=7)
    out = ml.cluster_summary(c, e, "vec_id", "label", 5)
    return out.select("cluster", "n", F.round("mean_similarity", 4).alias("mean_similarity"), F.array_join("kinds", ";").alias("kinds"), F.array_join("examples", ",").alias("examples"))


def term_vectors(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", "text")
    return ml.term_vectors(t, "doc_id", "text", 8, 512)


def boosted_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Model scores of candidates, at most the cap of their weak label, with the measures on the held-out year."""
    scratch = Scratch(spark, "ranking")
    # candidates that are alike to the labels, the model and the measures are counted, so that the relations are worked out once
    alike = ("support_class", "p", "articles", "sentences", "known", "best", "year")
    c = scratch.save(_candidates(spark, d).groupBy(*alike).agg(F.count("*").alias("n")))
    c = _with_labels(c).filter("weak_label <> 'abstain'")
    c = c.withColumn("y", C("label_score")).withColumn("w", C("n").cast("double")).withColumn("log_n", F.log1p("sentences"))
    out = ml.boosted_scores(c.filter("year < 1998"), c.filter("year >= 1998"), ["log_n", "best"], ["support_class"], "y", "w")
    s = scratch.save(out.select("n", L.capped(C("model_score"), C("weak_label")).alias("score"), (C("y") > 0.7).cast("int").alias("y")))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return _rounded(one(M.roc_auc(s, "score", "y", "n")).join(one(M.average_precision(s, "score", "y", "n")), "_one").drop("_one"))


def isotonic_calibration(spark: SparkSession, d: str) -> DataFrame:
    from lodegraph.queries.learning import _scored

    s = _scored(spark, d)
    out = ml.isotonic(s.filter("o_orderkey % 2 = 0"), s.filter("o_orderkey % 2 = 1"), "score", "y")
    return _rounded(M.calibration(out.withColumn("calibrated", F.greatest(F.lit(0.0), F.least(F.lit(1.0), C("calibrated")))), "calibrated", "label"))


QUERIES = {f.__name__: f for f in (nearest_neighbours, vector_clusters, term_vectors, boosted_ranking, isotonic_calibration)}

ORACLES = {
    "nearest_neighbours": """
        with p as (select a.vec_id as query, b.vec_id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as c from embeddings a join embeddings b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id),
        r as (select *, (row_number() over (partition by query order by c desc, vec_id))::int as rank from p)
        select query, vec_id, round(c, 6) as cosine, rank from r where rank <= 5""",
}
