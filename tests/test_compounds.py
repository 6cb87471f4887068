"""Compound indexes and attached features, by hand."""

from pyspark.sql import functions as F

from lodegraph.operators import compounds as X


def test_indexes(spark):
    rows = [("u1", " abcdefghijklmn-abcdefghij-n", "O H2", 18.015), ("u1", "ABCDEFGHIJKLMN-ABCDEFGHIJ-N ", "H2O", 18.015), ("u2", "short", None, 2.0005), (None, None, "C", 12.0), ("u3", None, "C", 0.0), ("", "", "", 1.0)]
    df = spark.createDataFrame(rows, "id string, k string, f string, m double")
    keys = X.inchikey_index(df, "id", "k", "inchikey", 95).collect()
    assert [(r.uid, r.inchikey, r.connectivity_key) for r in keys] == [("u1", "ABCDEFGHIJKLMN-ABCDEFGHIJ-N", "ABCDEFGHIJKLMN")]
    mass = {(r.uid, r.formula_key, r.mass_mda_bucket) for r in X.formula_mass_index(df, "id", "f", "m", "mass", 90).collect()}
    assert mass == {("u1", "H2O", 18015), ("u2", "", round(2.0005 * 1000))}
    assert X.formula_mass_index(df.limit(0), "id", "f", "m", "mass", 90).count() == 0


def test_features(spark):
    resolver = spark.createDataFrame([("CHX", "5", "m1"), ("HM", "7", "m1"), ("HM", "8", "m2"), ("HM", "8", "m2")], "namespace string, lookup_key string, uid string")
    rows = [(1, "5", "7", "1.50", "a", "100:5 200|0", "x"), (2, "5", "8", "2", None, "50:1", "x"), (3, None, " ", "3", None, "", "x"), (4, None, "8", None, "B (Pos)", "70.5:2;70.5:2", "x"), (5, "9", None, "1", "", "1:1", "x")]
    df = spark.createDataFrame(rows, "id int, chx string, hm string, rt string, m string, peaks string, status string").drop("status")
    a = X.attached(df, "id", {"chx": "CHX", "hm": "HM"}, resolver)
    assert {r.id: (r.uid, r.status) for r in a.collect()} == {1: ("m1", "resolved"), 2: (None, "ambiguous"), 3: (None, "unresolved"), 4: ("m2", "resolved"), 5: (None, "unresolved")}
    assert [(r.uid, r.rt, r.rt_unit, r.method_key) for r in X.rt_index(a, "rt", None, "m").collect()] == [("m1", 1.5, "min", "a")]
    peaks = {(r.uid, r.record, r.fragment_mz, r.fragment_intensity) for r in X.ms2_index(a.withColumn("pm", F.lit(300.5)), "id", "pm", "peaks").collect()}
    assert peaks == {("m1", "1", 100.0, 5.0), ("m1", "1", 200.0, 1.0), ("m2", "4", 70.5, 2.0)}
    clash = X.attached(df.withColumn("uid", F.lit("mine")), "id", {"hm": "HM"}, resolver)
    assert "_uid" in clash.columns and clash.filter("uid = 'mine'").count() == 5
