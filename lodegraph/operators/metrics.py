"""Measures of scores against labels, by aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.operators.ordering import top_in_group


def _by_score(df: DataFrame, score: str, label: str, n: str | None = None) -> DataFrame:
    """score, pos, neg of each distinct score; all that curves need, smaller than the rows. n: how many rows a row stands for."""
    y, many = F.col(label).cast("long"), F.lit(1) if n is None else F.col(n)
    return df.groupBy(F.col(score).alias("score")).agg(F.sum(y * many).alias("pos"), F.sum((1 - y) * many).alias("neg"))


def _cumulative(counts: DataFrame, parts: int = 64) -> DataFrame:
    """counts with tp, fp: positives and negatives at or above each score.

    Sums run within score ranges in parallel and are lifted by the totals of the
    ranges above; no task sees all scores.
    """
    bounds = counts.stat.approxQuantile("score", [i / parts for i in range(1, parts)], 1 / (4 * parts))
    where = F.lit(0)
    for b in sorted(set(bounds)):
        where = where + F.when(F.col("score") > b, 1).otherwise(0)
    c = counts.withColumn("part", where)
    totals = c.groupBy("part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    above = totals.alias("a").join(totals.alias("b"), F.col("b.part") > F.col("a.part"), "left")  # at most `parts` rows a side
    lift = above.groupBy(F.col("a.part").alias("part")).agg(F.coalesce(F.sum("b.p"), F.lit(0)).alias("p0"), F.coalesce(F.sum("b.n"), F.lit(0)).alias("n0"))
    w = Window.partitionBy("part").orderBy(F.desc("score"))
    c = c.withColumn("tp", F.sum("pos").over(w)).withColumn("fp", F.sum("neg").over(w))
    return c.join(F.broadcast(lift), "part").withColumn("tp", F.col("tp") + F.col("p0")).withColumn("fp", F.col("fp") + F.col("n0")).drop("part", "p0", "n0")


def roc_auc(df: DataFrame, score: str, label: str, n: str | None = None) -> DataFrame:
    """auc, positives, negatives; tied scores count half; null without both labels. n: how many rows a row stands for."""
    c = _cumulative(_by_score(df, score, label, n))
    # a positive beats the negatives below its score and half of those at it
    parts = c.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("pos") * (F.col("fp") - F.col("neg") / 2)).alias("lost"))
    return parts.select(F.when((F.col("p") > 0) & (F.col("n") > 0), 1 - F.col("lost") / (F.col("p") * F.col("n"))).alias("auc"), F.col("p").alias("positives"), F.col("n").alias("negatives"))


def average_precision(df: DataFrame, score: str, label: str, n: str | None = None) -> DataFrame:
    """average_precision with equal scores as one step. n: how many rows a row stands for."""
    c = _cumulative(_by_score(df, score, label, n))
    gain = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return c.agg((gain / F.sum("pos")).alias("average_precision"))


def best_f1(df: DataFrame, score: str, label: str) -> DataFrame:
    """threshold, f1: the score from which predicting positive has the best F1; ties to the higher threshold."""
    c = _cumulative(_by_score(df, score, label))
    total = c.agg(F.sum("pos")).head()[0] or 0
    f1 = 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.lit(total))
    return c.agg(F.max(F.struct(F.round(f1, 9).alias("f1"), F.col("score"))).alias("b")).select(F.col("b.score").alias("threshold"), F.col("b.f1").alias("f1"))


def precision_at(df: DataFrame, score: str, label: str, key: str, ks: Sequence[int]) -> DataFrame:
    """k, precision, lift (precision over the base rate) of the k best rows; ties by key."""
    base = df.agg(F.avg(F.col(label).cast("double"))).head()[0]
    top = df.orderBy(F.desc(score), F.asc(key)).limit(max(ks)).select(F.col(label).cast("double").alias("y"), score, key)
    ranked = top.withColumn("r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(score), F.asc(key))))  # max(ks) rows
    each = ranked.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter("r <= k")
    return each.groupBy("k").agg(F.avg("y").alias("precision"), (F.avg("y") / F.lit(base)).alias("lift"))


def ranking_metrics(df: DataFrame, group: str, score: str, label: str, key: str, p_at: int = 5, ndcg_at: int = 10) -> DataFrame:
    """group, precision, ndcg, reciprocal_rank of each ranked list; ties by key.

    label: 0, 1 or 2.  A row is relevant from 2 on; precision is over the first
    p_at rows, or all of a shorter list; the gain of a row is 2^label - 1; the
    first relevant row counts wherever it is.  A null label is 0.
    """
    rows = df.select(F.col(group), F.col(score), F.col(key), F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("y"))
    top = top_in_group(rows, [group], [F.desc(score), F.asc(key)], max(p_at, ndcg_at), "r")
    gain = lambda r: F.when(F.col(r) <= ndcg_at, (F.pow(F.lit(2.0), F.col("y")) - 1) / F.log2(F.col(r) + 1)).otherwise(0.0)
    got = top.groupBy(group).agg(F.avg(F.when(F.col("r") <= p_at, (F.col("y") >= 2).cast("double"))).alias("precision"), F.sum(gain("r")).alias("dcg"))
    best = top_in_group(rows, [group], [F.desc("y"), F.asc(key)], ndcg_at, "i").groupBy(group).agg(F.sum(gain("i")).alias("ideal"))
    # the place of the best relevant row: how many rows come before it
    first = rows.filter("y >= 2").groupBy(group).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(key))).alias("f"))
    ahead = rows.join(first, group).filter((-F.col(score) < F.col("f.s")) | ((-F.col(score) == F.col("f.s")) & (F.col(key) < F.col(f"f.{key}"))))
    place = first.select(group).join(ahead.groupBy(group).agg(F.count("*").alias("n")), group, "left").select(group, (F.coalesce("n", F.lit(0)) + 1).alias("place"))
    return got.join(best, group).join(place, group, "left").select(
        group, "precision", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"), F.coalesce(1 / F.col("place"), F.lit(0.0)).alias("reciprocal_rank")
    )


# Tiers of a calibrated confidence, each from its threshold on.
TIERS = (("high", 0.75), ("medium", 0.45), ("exploratory", 0.18), ("low", 0.0))


def confidence_tier(p: Column) -> Column:
    """high, medium, exploratory or low."""
    out = None
    for tier, least in TIERS[:-1]:
        out = F.when(p >= least, tier) if out is None else out.when(p >= least, tier)
    return out.otherwise(TIERS[-1][0])


def calibration(df: DataFrame, p: str, label: str, tier: str | None = None, bins: int = 10) -> DataFrame:
    """ece, brier, mae, overclaim_rate over equal bins, the last one closed.

    label: 0, 1 or 2; ECE and Brier take 2 as positive, MAE is against label / 2,
    and an overclaim is a row of tier high or medium with label 0.  Without a
    column tier it is :func:`confidence_tier` of p.
    """
    y, half, x = (F.col(label) >= 2).cast("double"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(label) / 2)), F.col(p)
    claimed = (F.col(tier) if tier else confidence_tier(x)).isin("high", "medium") & (F.col(label) <= 0)
    b = df.withColumn("_b", F.least(F.lit(bins - 1), F.floor(x * bins)))
    per = b.groupBy("_b").agg(F.count("*").alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y"), F.sum((x - y) * (x - y)).alias("sq"), F.sum(F.abs(x - half)).alias("ab"), F.sum(claimed.cast("int")).alias("over"))
    n = F.sum("n")
    return per.agg((F.sum(F.col("n") * F.abs(F.col("x") - F.col("y"))) / n).alias("ece"), (F.sum("sq") / n).alias("brier"), (F.sum("ab") / n).alias("mae"), (F.sum("over") / n).alias("overclaim_rate"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """spearman: the correlation of average ranks; ranks come from the counts of distinct values."""
    def ranks(c: str, name: str) -> DataFrame:
        counts = df.groupBy(F.col(c).alias("score")).agg(F.count("*").alias("pos")).withColumn("neg", F.lit(0))
        up = _cumulative(counts)  # rows at or above a value
        return up.select(F.col("score").alias(c), (F.col("tp") - (F.col("pos") - 1) / 2).alias(name))

    return df.join(ranks(a, "_ra"), a).join(ranks(b, "_rb"), b).agg(F.corr("_ra", "_rb").alias("spearman"))


def top_overlap(df: DataFrame, key: str, a: str, b: str, k: int) -> DataFrame:
    """overlap: the share of the k best keys by a that are among the k best by b."""
    best = lambda s: df.orderBy(F.desc(s), F.asc(key)).limit(k).select(key)
    return best(a).intersect(best(b)).agg((F.count("*") / k).alias("overlap"))


def pairwise_accuracy(positives: DataFrame, negatives: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """pairs, accuracy: how often a positive scores above a negative of the same keys; ties count half.

    Pairs are counted from each group's counts of distinct scores and not formed.
    """
    p = positives.groupBy(*keys, F.col(score).alias("s")).agg(F.count("*").alias("pos"), F.lit(0).cast("long").alias("neg"))
    n = negatives.groupBy(*keys, F.col(score).alias("s")).agg(F.lit(0).cast("long").alias("pos"), F.count("*").alias("neg"))
    c = p.unionByName(n).groupBy(*keys, "s").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    w = Window.partitionBy(*keys).orderBy("s")
    c = c.withColumn("below", F.sum("neg").over(w) - F.col("neg")).withColumn("all_neg", F.sum("neg").over(Window.partitionBy(*keys)))
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    pairs = F.sum(F.col("pos") * F.col("all_neg"))
    return c.agg(pairs.alias("pairs"), (wins / pairs).alias("accuracy"))


def distribution_audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, value, n, share of every value of some columns."""
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    counts = df.select(cells).groupBy("column", "value").agg(F.count("*").alias("n"))
    whole = counts.groupBy("column").agg(F.sum("n").alias("_t"))
    return counts.join(F.broadcast(whole), "column").select("column", "value", "n", (F.col("n") / F.col("_t")).alias("share"))
