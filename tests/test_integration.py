"""Joins of several sources and identity decisions on edge cases."""

from pyspark.sql import functions as F

from lodegraph.operators import identity as D
from lodegraph.operators import integration as I
from lodegraph.operators import literature as L
from lodegraph.operators import release as R
from lodegraph.runtime import fresh, shared_dir, widen


def test_merge_and_links(spark):
    a = spark.createDataFrame([("k1", None, "x"), ("k2", "b", "y")], "k string, s string, t string")
    b = spark.createDataFrame([("k1", "B", None), ("k3", "c", "z")], "k string, s string, t string")
    got = {tuple(r) for r in I.merge_sources(a, b, "k", ["s", "t"]).collect()}
    assert got == {("k1", "B", "x", "both"), ("k2", "b", "y", "first"), ("k3", "c", "z", "second")}
    links = spark.createDataFrame([("l1", "r1"), ("l2", "r2"), ("l3", "r3"), ("l4", "r4"), ("l1", "r1")], "left string, right string")
    anchors = spark.createDataFrame([("l1", "u1"), ("r2", "u2"), ("l3", "u3"), ("r3", "u9")], "key string, uid string")
    got = {tuple(r) for r in I.propagate_links(links, anchors).collect()}
    assert got == {("l1", "r1", "u1", "propagated"), ("l2", "r2", "u2", "propagated"), ("l3", "r3", None, "conflict"), ("l4", "r4", None, "open")}


def test_components_and_lookup(spark):
    df = spark.createDataFrame([(1, "a.b>>c"), (2, "a"), (3, None), (4, ">>d")], "k int, s string")
    got = {tuple(r) for r in I.reaction_components(df, "k", "s").collect()}
    assert got == {(1, "substrate", 0, "a"), (1, "substrate", 1, "b"), (1, "product", 0, "c"), (4, "product", 0, "d")}
    rows = spark.createDataFrame([("r1", "p1", None), ("r2", None, None), ("r3", "p9", "c3")], "k string, p string, c string")
    index = spark.createDataFrame([("p1", 2001), ("c3", 1999), ("p1", 2000)], "token string, year int")
    assert {tuple(r) for r in I.lookup_by_any(rows, "k", ["p", "c"], index, "year").collect()} == {("r1", 2000), ("r2", None), ("r3", 1999)}
    lists = spark.createDataFrame([("a", ["x", "y"]), ("b", []), ("c", None)], "k string, items array<string>")
    feats = spark.createDataFrame([("x", 0.5)], "item string, score double")
    got = {r.k: (r.n_items, r.n_scored, r.best) for r in I.regroup_features(lists, "k", "items", feats, "item", "score").collect()}
    assert got == {"a": (2, 1, 0.5), "b": (0, 0, None), "c": (0, 0, None)}


def test_bridge_and_inherit(spark):
    rows = spark.createDataFrame([("1", "K", "n"), ("2", None, "n"), ("3", "Z", "z")], "k string, ik string, name string")
    index = spark.createDataFrame([("I", "K", "u2"), ("I", "K", "u1"), ("N", "n", "u0")], "namespace string, id string, uid string")
    got = {tuple(r) for r in I.bridge_identities(rows, "k", index, [("ik", "I"), ("name", "N")]).collect()}
    assert got == {("1", "u1", "I"), ("2", "u0", "N")}
    same = spark.createDataFrame([("a", "b"), ("a", "a")], "uid string, other string")
    edges = spark.createDataFrame([("b", "p"), ("b", "q"), ("a", "q")], "s string, o string")
    assert {tuple(r) for r in I.inherit_edges(same, edges, "s").collect()} == {("a", "p")}


def test_identity(spark):
    names = ["A/B ratio", "total acids", "tagezamide 18:1", "some species", "plainol"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(D.trait_kind(F.col("n")).alias("k"))
    assert [r.k for r in df.collect()] == ["ratio", "sum", "lipid_species", "class", "compound"]
    rows = [("ratio", "t", ""), ("ratio", "", "c"), ("lipid_class", "k", ""), ("lipid_class", None, "c"), ("trait_score", "t", "c"), ("trait_score", None, "c"), ("unknown_peak", None, "c"), (None, "t", None)]
    c = spark.createDataFrame(rows, "f string, t string, c string")
    got = [tuple(r.d) for r in c.select(D.decide(F.col("f"), F.col("t"), F.col("t"), F.col("c")).alias("d")).collect()]
    assert [(r[0], r[1], r[4], r[5]) for r in got] == [
        ("accepted_trait", "t", 0.8, "needs_review"), ("ambiguous", "", 0.0, "needs_review"), ("accepted_class", "k", 0.65, "needs_review"), ("ambiguous", "", 0.0, "needs_review"),
        ("accepted_trait", "t", 0.7, "needs_review"), ("ambiguous", "", 0.0, "needs_review"), ("accepted_exact", "c", 0.9, "auto"), ("unmatched", "", 0.0, "needs_review"),
    ]
    v = spark.createDataFrame([("D-x ate",), ("kolic acid",), ("m 18:0",)], "n string").select(D.name_variants(F.col("n")).alias("v"))
    assert [r.v for r in v.collect()] == [["d-x ate", "d-x ic acid", "x ate"], ["kolate", "kolic acid"], ["m 18:0", "m(18:0)"]]


def test_evidence(spark):
    cols = "subject_uid string, predicate string, object_uid string, polarity string, status string, article string, p double"
    rows = [
        ("a", "r", "b", "activation", "support", "1", 0.5), ("a", "r", "b", "activation", "support", "1", 0.3), ("a", "r", "b", "association", "support", "2", 0.5),
        ("c", "r", "d", "activation", "support", "1", 0.9), ("c", "r", "d", "inhibition", "support", "2", 0.9), ("e", "r", "f", "association", "background", "1", 0.9),
        ("g", "r", "h", "association", "uncertain", "1", 0.9), ("i", "r", "j", "association", "support", "1", 0.1), ("k", "r", "l", "association", "support", None, None),
    ]
    known = spark.createDataFrame([("a", "r", "b"), ("k", "r", "l")], "subject_uid string, predicate string, object_uid string")
    got = {r.subject_uid: (r.support_class, round(r.probability, 6)) for r in L.edge_support(spark.createDataFrame(rows, cols), known).collect()}
    assert got == {"a": ("support_direction", 0.75), "c": ("conflict_candidate", 0.99), "e": ("background_candidate", 0.9), "g": ("unresolved", 0.9), "i": ("unresolved", 0.1), "k": ("confirm", 0.0)}
    s = spark.createDataFrame([("k1", "gene", "alias"), ("k2", "x", "y")], "surface_key string, entity_type string, matched_field string")
    rules = spark.createDataFrame([("*", "gene", "*", 0.5), ("k1", "*", "*", 0.0), ("*", "gene", "alias", 0.5)], "surface_key string, entity_type string, matched_field string, multiplier double")
    assert {(r.surface_key, r.blocked, r.multiplier) for r in L.precision_rules(s, rules, ["surface_key"]).collect()} == {("k1", True, 0.0), ("k2", False, 1.0)}


def test_release_checks(spark):
    found = spark.createDataFrame([("c1", "a", 1), ("c1", "b", 2), ("c1", "z", 9)], "case string, e string, r int")
    gold = spark.createDataFrame([("c1", "a"), ("c1", "q"), ("c2", "x")], "case string, e string")
    got = {r["case"]: (r.n_found, r.precision, r.recall) for r in R.gold_recall(found, gold, "case", "e", "r", 2).collect()}
    assert got == {"c1": (1, 0.5, 0.5), "c2": (0, 0.0, 0.0)}
    before = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("gone", 1.0)], "metric string, value double")
    after = spark.createDataFrame([("a", 2.0), ("b", 3.0), ("new", 1.0)], "metric string, value double")
    assert {r.metric: r.verdict for r in R.compare_runs(before, after, 0.1, ["b"]).collect()} == {"a": "improved", "b": "regressed", "gone": "removed", "new": "added"}


def test_runtime(spark, monkeypatch):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == named.rstrip("/") if named else shared_dir(spark).startswith("file://")
    df = spark.range(10).coalesce(1)
    assert widen(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert fresh(df, "id", "other") == ["_id", "other"]

    class Conf:
        def get(self, key, default=None):
            return default

    class Cluster:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    try:
        shared_dir(Cluster())
    except ValueError as e:
        assert "spark.checkpoint.dir" in str(e)
    else:
        raise AssertionError("a cluster needs a shared folder")
    Conf.get = lambda self, key, default=None: "hdfs://x/y/" if key == "spark.checkpoint.dir" else default
    assert shared_dir(Cluster()) == "hdfs://x/y"
