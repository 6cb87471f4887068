import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lodegraph.llm.term_counts import frequency_mark, term_frequencies

SCHEMA = "m string, t string, p long"


def brute(rows):
    rows = set(rows)
    n, p = Counter(), defaultdict(set)
    for m, t, q in rows:
        if t and t.strip():
            n[t] += 1
            p[t] |= {q} - {None}
    return {(t, n[t], len(p[t])) for t in n}


def run(spark, rows, parts):
    df = spark.createDataFrame(rows, SCHEMA)
    return {tuple(r) for r in term_frequencies(df, F.col("t"), F.col("p"), F.col("m"), parts).collect()}


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        t = "hot" if rng.random() < 0.4 else rng.choice(["a", "b b", "ç", "", " ", None, f"t{rng.randrange(200)}"])
        rows.append((f"m{i}", t, None if rng.random() < 0.2 else rng.randrange(60)))
    rows += rows[::40]
    for parts in (1, 7, 40):
        assert run(spark, rows, parts) == brute(rows)


def test_hot_record_over_borders(spark):
    rows = [(f"m{i}", "hot", 1) for i in range(500)] + [(f"n{i}", "hot", None) for i in range(500)]
    assert run(spark, rows, 16) == {("hot", 1000, 1)}


def test_empty_and_null(spark):
    assert run(spark, [("m", None, 1), ("m2", "", 2)], 3) == set()
    assert run(spark, [(None, "x", 1), (None, "x", 1), (None, "x", None)], 3) == {("x", 2, 1)}


def test_mark(spark):
    df = spark.createDataFrame([(2,), (3,), (5,), (6,)], "r long").select(frequency_mark(F.col("r"), 100).alias("m"))
    assert [r.m for r in df.collect()] == ["rare", None, None, "common"]
