import random
from collections import Counter

import pytest

from lodegraph import runtime
from lodegraph.runtime import hot_keys, split_join


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_join_is_the_join(spark, monkeypatch, how):
    monkeypatch.setattr(runtime, "HOT_LEAST", 10)
    monkeypatch.setattr(runtime, "HOT_PARTS", 5)
    rng = random.Random(3)
    rows = [(rng.choice(["a"] * 5 + ["b"] * 3 + ["c", "d", "e", None]), i, i % 3 == 0) for i in range(300)]
    left = spark.createDataFrame(rows, "k string, i int, _hot boolean")
    right = spark.createDataFrame([("a", 1), ("c", 2), ("x", 3)], "k string, v int")
    hot = hot_keys(left.filter("k is not null").groupBy("k").count().withColumnRenamed("count", "n"), "k")
    assert {r.k for r in hot.collect()} == {"a", "b"}
    got, want = split_join(left, right, "k", hot, how), left.join(right, "k", how)
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_no_hot_keys(spark):
    none = spark.createDataFrame([], "k string, n long")
    assert hot_keys(none, "k") is None
    assert hot_keys(spark.createDataFrame([("a", 5)], "k string, n long"), "k") is None
