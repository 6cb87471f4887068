"""Models on candidate features and documents: boosted trees, isotonic calibration, term vectors, neighbours, clusters."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, PCA, CountVectorizer, NGram, Normalizer, OneHotEncoder, RegexTokenizer, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.ordering import top_in_group
from lodegraph.runtime import Scratch, fresh

#: Training rows of a task of the trees; a round is some jobs over all of them.
ROWS_PER_TASK = 50_000


def feature_pipeline(numbers: Sequence[str], categories: Sequence[str]) -> list:
    """Stages that turn numbers and one-hot categories into `features`; values unseen in training get a slot of their own."""
    stages: list = [StringIndexer(inputCol=c, outputCol=f"_{c}_i", handleInvalid="keep", stringOrderType="alphabetAsc") for c in categories]
    stages += [OneHotEncoder(inputCol=f"_{c}_i", outputCol=f"_{c}_v", handleInvalid="keep") for c in categories]
    return [*stages, VectorAssembler(inputCols=[*numbers, *[f"_{c}_v" for c in categories]], outputCol="features", handleInvalid="keep")]


def boosted_scores(train: DataFrame, other: DataFrame, numbers: Sequence[str], categories: Sequence[str], label: str, weight: str, rounds: int = 40, depth: int = 5, seed: int = 0) -> DataFrame:
    """`other` with model_score in [0, 1] of gradient-boosted trees; nulls in numbers count as 0.

    Training rows that are equal in inputs, label and weight are one row of their
    joint weight, which gives the same trees: the cost of the rounds grows with
    the distinct rows.
    """
    filled = lambda df: df.na.fill(0.0, list(numbers)).na.fill("", list(categories))
    many = fresh(train, "_many")[0]
    alike = filled(train).groupBy(*numbers, *categories, label, weight).agg(F.count("*").alias(many))
    alike = Scratch(train.sparkSession, "boosted").save(alike.withColumn(weight, F.col(weight) * F.col(many)).drop(many))
    alike = alike.repartition(math.ceil(max(1, alike.count()) / ROWS_PER_TASK))
    gbt = GBTRegressor(featuresCol="features", labelCol=label, weightCol=weight, maxIter=rounds, maxDepth=depth, stepSize=0.05, seed=seed, predictionCol="_p")
    model = Pipeline(stages=[*feature_pipeline(numbers, categories), gbt]).fit(alike)
    return model.transform(filled(other)).select(*other.columns, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_p"))).alias("model_score"))


def isotonic(train: DataFrame, other: DataFrame, score: str, label: str) -> DataFrame:
    """`other` with calibrated, a non-decreasing function of the score fitted to the labels.

    Training rows are reduced to one for each distinct score first.
    """
    points = train.groupBy(F.col(score).alias("_s")).agg(F.avg(F.col(label).cast("double")).alias("_y"), F.count("*").cast("double").alias("_w"))
    model = IsotonicRegression(featuresCol="_s", labelCol="_y", weightCol="_w", predictionCol="calibrated").fit(points)
    return model.transform(other.withColumn("_s", F.col(score).cast("double"))).drop("_s")


def term_vectors(docs: DataFrame, key: str, text: str, components: int = 16, features: int = 4096, min_df: float = 2.0, max_df: float = 0.98) -> DataFrame:
    """key, vector (array<double> of unit length): sublinear TF-IDF of 1- and 2-grams, reduced by principal components.

    Documents without a known term have a zero vector.
    """
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_w", pattern="[^a-z0-9]+", toLowercase=True), NGram(n=2, inputCol="_w", outputCol="_b"),
        SQLTransformer(statement="SELECT *, concat(_w, _b) AS _t FROM __THIS__"),
        CountVectorizer(inputCol="_t", outputCol="_c", vocabSize=features, minDF=min_df, maxDF=max_df),
    ]
    used = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias(text))
    counted = Pipeline(stages=stages).fit(used).transform(used)
    log = counted.select(key, array_to_vector(F.transform(vector_to_array("_c"), lambda x: F.when(x > 0, 1 + F.log(x)).otherwise(0.0))).alias("_l"))
    k = min(components, len(log.head()["_l"])) if not log.isEmpty() else components
    reduce_ = Pipeline(stages=[IDF(inputCol="_l", outputCol="_i"), PCA(k=k, inputCol="_i", outputCol="_p"), Normalizer(inputCol="_p", outputCol="_n")])
    return reduce_.fit(log).transform(log).select(key, vector_to_array("_n").alias("vector"))


def nearest_neighbours(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """query, key, cosine, rank of the k nearest vectors of each query, exactly; a query isn't its own neighbour.

    The queries are a bounded set; blocks of them meet blocks of all vectors, and
    each block pair keeps its k best before the shuffle.
    """
    unit = lambda df, n: df.select(F.col(key).alias(n), F.transform(F.col(vector), lambda x: x.cast("double")).alias(f"{n}_v")).withColumn(
        f"{n}_l", F.sqrt(F.aggregate(f"{n}_v", F.lit(0.0), lambda a, x: a + x * x))
    )
    # blocks by the counted rows: a pair of blocks is a task's work, and every vector is copied once for each block of queries
    n_q, n_v = queries.count(), vectors.count()
    q_blocks = max(1, -(-n_q // 4_000))
    v_blocks = max(-(-n_v // 20_000), -(-queries.sparkSession.sparkContext.defaultParallelism // q_blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = unit(queries, "query").withColumn("qb", F.pmod(F.hash("query"), F.lit(q_blocks))).withColumn("vb", every(v_blocks))
    v = unit(vectors, key).withColumn("vb", F.pmod(F.hash(key), F.lit(v_blocks))).withColumn("qb", every(q_blocks))
    dot = F.aggregate(F.zip_with("query_v", f"{key}_v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    scale = F.col("query_l") * F.col(f"{key}_l")
    pairs = q.join(v, ["qb", "vb"]).filter(F.col("query") != F.col(key)).select("query", key, F.when(scale > 0, dot / scale).otherwise(0.0).alias("cosine"))
    return top_in_group(pairs, ["query"], [F.desc("cosine"), F.asc(key)], k, "rank")


def clusters(vectors: DataFrame, key: str, vector: str, k: int, seed: int = 0) -> DataFrame:
    """key, cluster, similarity (cosine to the cluster's centre) by k-means on unit vectors."""
    v = vectors.select(key, array_to_vector(F.transform(F.col(vector), lambda x: x.cast("double"))).alias("_v"))
    v = Normalizer(inputCol="_v", outputCol="_n").transform(v)
    model = KMeans(k=k, seed=seed, featuresCol="_n", predictionCol="cluster", distanceMeasure="cosine").fit(v)
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    c = F.broadcast(vectors.sparkSession.createDataFrame(centres, "cluster int, centre array<double>"))
    u = model.transform(v).select(key, "cluster", vector_to_array("_n").alias("u")).join(c, "cluster")
    sum_ = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    dot = sum_(F.zip_with("u", "centre", lambda a, b: a * b)) / F.sqrt(sum_(F.transform("centre", lambda x: x * x)))
    return u.select(key, "cluster", dot.alias("similarity"))


def cluster_summary(clustered: DataFrame, entities: DataFrame, key: str, kind: str, examples: int = 12) -> DataFrame:
    """cluster, n, mean_similarity, kinds (`kind:n`, by number), examples (the most central keys)."""
    j = clustered.join(entities.select(key, kind), key, "left")
    kinds = j.groupBy("cluster", kind).agg(F.count("*").alias("n")).groupBy("cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(kind).cast("string").alias("k")))), lambda s: F.concat_ws(":", s["k"], (-s["m"]).cast("string"))).alias("kinds")
    )
    top = top_in_group(j, ["cluster"], [F.desc("similarity"), F.asc(key)], examples, "r").groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.col(key).cast("string").alias("k")))), lambda s: s["k"]).alias("examples"))
    base = j.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("similarity").alias("mean_similarity"))
    return base.join(kinds, "cluster").join(top, "cluster")
