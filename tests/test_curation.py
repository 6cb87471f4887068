"""Curation operators and text folds against plain Python."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodegraph.functions import text as X
from lodegraph.operators import curation as U


def column(spark, texts, f):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.x for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def test_offsets(spark):
    texts = ["ab ab-c, ab", "", "--", "x", None, "a1 b2 a1"]
    got = column(spark, texts, X.tokens_with_offsets)
    want = [None if t is None else [(m.group(), m.start(), m.end()) for m in re.finditer("[A-Za-z0-9]+", t)] for t in texts]
    assert [None if g is None else [(x.token, x.start, x.end) for x in g] for g in got] == want
    spans = column(spark, ["One. One. Two!\nhead\nThree?"], X.sentence_offsets)[0]
    text = "One. One. Two!\nhead\nThree?"
    assert [(s.start, text[s.start : s.end].strip()) for s in spans] == [(0, "One."), (4, "One."), (9, "Two!"), (20, "Three?")]


@pytest.mark.parametrize(
    ("text", "want"), [("a, b (c, d); e", ["a", "b (c, d)", "e"]), ("(a,b", ["(a,b"]), ("a),b", ["a)", "b"]), (",;", []), ("", []), ("x[1,2],y", ["x[1,2]", "y"])]
)
def test_split(spark, text, want):
    assert column(spark, [text], X.split_outside_parentheses)[0] == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ab (),;", max_size=12), min_size=20, max_size=40))
def test_split_keeps_letters(spark, texts):
    for t, parts in zip(texts, column(spark, texts, X.split_outside_parentheses), strict=True):
        assert re.sub("[ ,;]", "", "".join(parts)) == re.sub("[ ,;]", "", t)


def test_verdicts(spark):
    rows = [
        ("x" * 97, "a", "", "too_long"), ("a b c d e f g h i j k", "a", "", "many_tokens"), ("abc", "a", "", "short"), ("abc", "gene", "", "keep"), ("ab", "gene", "", "short"),
        ("\uff23ell ", "a", "", "generic"), ("12-34", "a", "", "no_letters"), ("cat", "target", "", "blocked_symbol"), ("good name", "disease", "kinase disease", "low_precision"),
        ("kinase disease", "gene", "kinase disease", "keep"), ("good name", "disease", "good name", "keep"), ("Tumor_Microenvironment", "disease", "", "low_precision"), (None, "a", "", "empty"),
        (" - ", "a", "", "empty"),
    ]
    df = spark.createDataFrame(rows, "s string, k string, l string, want string")
    assert [r.v for r in df.select(U.surface_verdict(F.col("s"), F.col("k"), F.col("l")).alias("v")).collect()] == [r[3] for r in rows]


def test_samples(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(90)], "id int, g int")
    a, b = ({r.id for r in U.hash_sample(x, "g", "id", 7).collect()} for x in (df, df.orderBy(F.desc("id")).repartition(5)))
    assert a == b and len(a) == 21
    assert U.hash_sample(df.limit(0), "g", "id", 7).count() == 0
    ranks = {r.id: (r.rank, r.fraction) for r in U.rank_fractions(spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 9.0)], "id int, s double"), "id", "s").collect()}
    assert ranks == {3: (1, 1.0), 1: (2, 0.5), 2: (3, 0.0)}


def test_holdouts_and_ratios(spark):
    df = spark.createDataFrame([("k", "a"), ("k", "b"), ("k", "a"), ("m", "c"), ("m", None)], "kind string, source string")
    assert {r.spec for r in U.holdout_specs(df, "kind", "source").collect()} == {"k:a", "k:b", "m:c:0", "m:c:1", "m:c:2"}
    r = spark.createDataFrame([(1, "A / B ratio", 2.0), (2, "plain", 1.0), (3, "x/y/z", 1.0), (4, None, 1.0)], "k int, n string, e double")
    assert {tuple(x) for x in U.ratio_components(r, "k", "n", "e").collect()} == {(1, 0, "a", 2.0), (1, 1, "b", -2.0)}


def test_overlay_and_guard(spark):
    base = spark.createDataFrame([("k", 5), ("k", 4), ("m", 1)], "k string, v int")
    over = spark.createDataFrame([("k", 0), ("n", 2), ("n", 1)], "k string, v int")
    assert {tuple(r) for r in U.merge_overlay(base, over, ["k"], ["v"]).collect()} == {("k", 4), ("m", 1), ("n", 1)}
    t = spark.createDataFrame([(1, "This Proves it."), (2, "improves"), (3, None)], "k int, t string")
    assert {tuple(r) for r in U.forbidden_text(t, "k", "t", ["proves", "cures"]).collect()} == {(1, "proves")}
