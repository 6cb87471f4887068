"""Rows worked out by hand: labels, splits, caps, terms and measures."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import learning as L
from lodegraph.operators import metrics as M

LABELS = [
    # class, p, articles, sentences, known edges -> label, score, reason
    ("refute", 0.99, 9, 9, 1, "negative_refute", 0.0, "literature_refute"),
    ("Opposite_Direction", None, None, None, None, "negative_refute", 0.0, "literature_refute"),
    ("confirm", 0.85, 2, 1, 1, "strong_positive", 1.0, "curated_and_literature"),
    ("confirm", 0.85, 2, 2, 0, "medium_positive", 0.78, "literature_support"),
    ("support", 0.84, 2, 1, 1, "abstain", 0.0, "insufficient_or_context_only"),
    ("novel_candidate", 0.99, 2, 9, 1, "weak_positive", 0.58, "novel_literature_candidate"),
    ("confirm", 0.75, 2, 1, 0, "abstain", 0.0, "insufficient_or_context_only"),
    ("unresolved", 0.9, 3, 1, 0, "weak_positive", 0.55, "high_literature_probability"),
    ("conflict_candidate", 0.89, 3, 9, 1, "abstain", 0.0, "insufficient_or_context_only"),
    (None, None, None, None, None, "abstain", 0.0, "insufficient_or_context_only"),
]


def test_weak_label(spark):
    df = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(LABELS)], "i int, c string, p double, a int, s int, k int")
    got = df.select("i", L.weak_label(F.col("c"), F.col("p"), F.col("a"), F.col("s"), F.col("k")).alias("l")).orderBy("i").collect()
    assert [tuple(r.l) for r in got] == [r[5:] for r in LABELS]


def test_other_labels(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.5), (2, 2.0)], "i int, prior double")
    edge = [tuple(r.e)[:2] for r in df.select(L.graph_edge_label(F.col("i") > 0, F.col("prior")).alias("e")).collect()]
    assert edge == [("weak_positive", 0.5), ("medium_positive", 0.74), ("medium_positive", 0.86)]
    over = spark.createDataFrame([(0.75,), (0.45,), (0.44,)], "c double").select(L.overlay_label(F.col("c")).alias("o")).collect()
    assert [tuple(r.o)[:2] for r in over] == [("medium_positive", 0.72), ("weak_positive", 0.52), ("abstain", 0.0)]
    five = spark.createDataFrame([("wrong_context", ""), ("x", "has_context_mismatch"), ("negative_shuffled", ""), ("abstain", "literature_refute"), ("weak_positive", ""), (None, None)], "l string, r string")
    assert [r[0] for r in five.select(L.five_class(F.col("l"), F.col("r"))).collect()] == ["context_mismatch", "context_mismatch", "contradicted", "contradicted", "supported", "insufficient_evidence"]


def test_splits(spark):
    groups = [f"paper_id:{i}" for i in range(300)]
    bucket = lambda g, n=100: int(hashlib.sha256(g.encode()).hexdigest()[:12], 16) % n
    want = {g: "test" if bucket(g) < 15 else "validation" if bucket(g) < 30 else "train" for g in groups}
    df = spark.createDataFrame([(g,) for g in groups], "g string")
    assert {r.g: r.s for r in df.select("g", L.split_of(F.col("g")).alias("s")).collect()} == want
    context = next(f"c{i}" for i in range(99) if bucket(f"c{i}", 20) == 0)
    rows = spark.createDataFrame([("a", 2024, context), ("a", 2023, context), ("a", None, ""), ("", None, ""), (None, None, None)], "g string, y int, c string")
    got = [r[0] for r in rows.select(L.split_of(F.col("g"), F.col("y"), F.col("c"))).collect()]
    name = lambda g: "test" if bucket(g) < 15 else "validation" if bucket(g) < 30 else "train"
    assert got == ["temporal_holdout", "context_holdout", name("a"), name("ungrouped"), name("ungrouped")]


def test_caps(spark):
    df = spark.createDataFrame([("strong_positive",), ("medium_positive",), ("weak_positive",), ("abstain",), ("negative_refute",), ("negative_shuffled",), ("new",), (None,)], "l string")
    assert [r[0] for r in df.select(L.capped(F.lit(1.0), F.col("l"))).collect()] == [1.0, 0.82, 0.62, 0.25, 0.05, 0.05, 0.25, 0.25]


def test_terms(spark):
    rows = [("e", t) for t, n in (("a", 1), ("b", 2), ("c", 7), ("d", 30)) for _ in range(n)] + [("e", None)]
    assert L.top_terms(spark.createDataFrame(rows, "e string, t string"), "e", "t").head().document == "d d d c c c b b a"


def test_ranking(spark):
    rows = [("g", 0.9, 1, 1), ("g", 0.8, 2, 2), ("g", 0.7, 0, 3), ("h", 0.5, None, 1), ("h", 0.4, 1, 2), *[("k", 1 - i / 100, 2 if i == 14 else 0, i) for i in range(20)]]
    got = {r.g: r for r in M.ranking_metrics(spark.createDataFrame(rows, "g string, s double, y int, k int"), "g", "s", "y", "k").collect()}
    assert got["g"].precision == pytest.approx(1 / 3) and got["g"].reciprocal_rank == 0.5
    assert got["g"].ndcg == pytest.approx((1 + 3 / math.log2(3)) / (3 + 1 / math.log2(3)))
    assert got["h"].precision == 0 and got["h"].reciprocal_rank == 0 and got["h"].ndcg == pytest.approx(1 / math.log2(3))
    assert got["k"].precision == 0 and got["k"].ndcg == 0 and got["k"].reciprocal_rank == pytest.approx(1 / 15)


def test_calibration(spark):
    df = spark.createDataFrame([(0.8, 2, "low"), (0.8, 0, "high"), (0.2, 1, "medium"), (0.5, 0, "low")], "p double, y int, t string")
    got = M.calibration(df, "p", "y", "t").head()
    assert got.overclaim_rate == 0.25 and got.mae == pytest.approx((0.2 + 0.8 + 0.3 + 0.5) / 4)
    assert got.brier == pytest.approx((0.04 + 0.64 + 0.04 + 0.25) / 4) and got.ece == pytest.approx((2 * 0.3 + 0.2 + 0.5) / 4)
    assert M.calibration(df, "p", "y").head().overclaim_rate == 0.5
