"""Feature matching, and the plans of queries that should scale."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lodegraph.operators import matching as M

SF = "/root/testdata/sf0.001"


def test_neutral_mass(spark):
    df = spark.createDataFrame([(181.070665, "[M+H]+"), (361.134054, "[2M+H]+"), (91.039, "[M+2H]2+"), (179.056, "[M-H]-"), (1.0, "[M+Xx]+"), (None, "[M+H]+")], "mz double, a string")
    got = [r.m for r in df.select(M.neutral_mass(F.col("mz"), F.col("a")).alias("m")).collect()]
    assert got[:4] == pytest.approx([180.063389, 180.063389, 180.063448, 180.063276]) and got[4:] == [None, None]


def test_candidates(spark):
    f = spark.createDataFrame([("f1", 181.070665, "[M+H]+", 10.0), ("f2", 181.070665, "[M+H]+", 10.0), ("f3", 50.0, "bad", 10.0)], "feature string, mz double, adduct string, ppm_tolerance double")
    c = spark.createDataFrame([("a", 180.0634), ("b", 180.0641), ("c", 180.08), ("d", None)], "compound string, mass double")
    got = {(r.feature, r.compound) for r in M.mass_candidates(f, c).collect()}
    assert got == {("f1", "a"), ("f1", "b"), ("f2", "a"), ("f2", "b")}
    score = lambda *v: M.candidate_score(*[F.lit(x) for x in v])
    row = spark.range(1).select(score(0.0, 10.0, True, 0.0, 1.0, 1.0).alias("best"), score(10.0, 10.0, False, 9.0, 1.0, None).alias("edge"), score(10.0, 10.0, False, 1.0, 1.0, None).alias("rt")).head()
    assert row.best == pytest.approx(100.0) and row.edge == pytest.approx(49.0) and row.rt - row.edge > 10


def test_context_and_themes(spark):
    df = spark.createDataFrame([(1, "Late x", 1.0), (2, "other", 1.0), (3, None, 1.0)], "id int, t string, s double")
    assert [(r.context_fit, r.s) for r in M.context_filter(df, "t", ["late"], "s").orderBy("id").collect()] == [("match", 1.0), ("mismatch", 0.5), ("unknown", 1.0)]
    assert M.context_filter(df, "t", ["late"], "s", hard=True).count() == 2
    got = {r.theme: (r.n_rows, r.n_terms, r.passed) for r in M.theme_coverage(df, "t", {"a": ["late", "x"], "b": ["zzz"]}).collect()}
    assert got == {"a": (1, 2, True), "b": (0, 0, False)}


def plan(spark, name):
    return __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["graph_edges", "relations", "edge_support", "mass_tolerance", "feature_candidates", "resolve_ranked", "any_key_join", "pair_features", "price_window", "nearest_neighbours"])
def test_no_nested_loops(spark, name):
    text = plan(spark, name)
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", text)


def test_scans_are_narrow(spark):
    text = plan(spark, "weak_labels")
    assert "l_comment" not in text and "l_tax" not in text
    text = plan(spark, "publication_years")
    assert re.search(r"ReadSchema: struct<pub_date:string>", text)
    text = plan(spark, "merged_genes")
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(source_name", text)
    # a window over all orders keeps only the first rows of a group before the shuffle
    assert "WindowGroupLimit" in plan(spark, "hash_sample")
