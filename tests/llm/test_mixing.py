import random
from collections import Counter

import numpy as np
import pytest

from lodegraph.llm import mixing
from lodegraph.llm.mixing import fight, mix, pivot, plan


def test_fight_keeps_mass_and_expectation():
    rng = random.Random(0)
    for _ in range(200):
        p, q, w, v = rng.uniform(0.01, 0.99), rng.uniform(0.01, 0.99), rng.randrange(1, 99), rng.randrange(1, 99)
        mean, steps = 0.0, 400
        for i in range(steps):
            a, b = fight(p, w, q, v, (i + 0.5) / steps)
            assert abs(a * w + b * v - p * w - q * v) < 1e-9
            assert a in (0, 1) or b in (0, 1)
            assert -1e-9 <= a <= 1 + 1e-9 and -1e-9 <= b <= 1 + 1e-9
            mean += a / steps
        assert abs(mean - p) < 0.02


def test_plan():
    assert plan({}, {"a": (1.0, 1)}) == {}
    assert plan({"a": 100, "b": 100}, {"a": (0.5, 1), "b": (0.5, 3), "c": (0.5, 9)}) == {"a": 1.0, "b": 1.0}
    got = plan({"a": 100, "b": 1000}, {"a": (0.5, 2), "b": (0.5, 1)}, total=800)
    assert got["a"] == 2.0 and got["b"] == pytest.approx(0.6)


def test_mix(spark):
    rng = random.Random(8)
    rows = [(i, "big" if i % 3 else rng.choice(["small", "odd", None]), rng.randrange(1, 60)) for i in range(3000)]
    rows += [(4001, "big", None), (4002, "big", 0), (None, "big", 5), (1, "big", rows[1][2])]
    targets = [("big", 0.6, 1), ("small", 0.4, 2), ("gone", 0.1, 4)]
    df = spark.createDataFrame(rows, "id long, source string, size int")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    copies, shares = mix(df, "id", "source", "size", t, rows_per_task=300, fan_in=2)
    got = {r.id: r for r in copies.collect()}
    assert {r.source for r in got.values()} == {"big", "small"}
    assert all(1 <= r.copies <= {"big": 1, "small": 2}[r.source] for r in got.values())
    by = {r.source: r for r in shares.collect()}
    assert set(by) == {"big", "small", "odd", None, "gone"}
    total = sum(r.used for r in by.values())
    assert by["big"].used == sum(r.size * r.copies for r in got.values() if r.source == "big")
    assert abs(by["big"].used - 0.6 * total) <= 120 and by["gone"].used == 0 and by["odd"].used == 0
    again, _ = mix(df, "id", "source", "size", t, rows_per_task=300, fan_in=2)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, copies.collect()))
    none, _ = mix(df.limit(0), "id", "source", "size", t)
    assert none.count() == 0


def test_pivot_keeps_the_expectation_of_every_record():
    """Two levels of meetings, many times: every record is taken as often as its probability says."""
    many = 20_000
    p0 = np.tile([0.3, 0.3, 0.3, 0.3, 0.3, 0.3, 0.6, 0.6, 0.6, 0.6, 0.75, 0.1], many)
    size = np.tile([9.0, 8, 8, 7, 5, 1, 9, 6, 6, 2, 4, 4], many)
    part, source = np.array([0, 0, 0, 1, 1, 1, 2, 2, 3, 3, 4, 5]), np.array([0] * 6 + [1] * 4 + [2] * 2)
    number = np.repeat(np.arange(many), 12)
    rng = np.random.default_rng(4)
    h = rng.integers(-(2**63), 2**63, (2, len(p0)), dtype=np.int64)
    # first level: two partitions for each source; second: what is left open of both
    runs = np.tile(source, many) + 3 * number
    p = pivot(pivot(p0, size, np.tile(part, many) + 6 * number, h[0]), size, runs, h[1])
    assert np.allclose(np.bincount(runs, p * size), np.bincount(runs, p0 * size))
    assert np.bincount(runs, (p > 0) & (p < 1)).max() <= 1
    taken = np.where((p > 0) & (p < 1), rng.random(len(p0)) < p, p).reshape(many, 12).mean(axis=0)
    assert (np.abs(taken - p0[:12]) <= 3.5 * np.sqrt(p0[:12] * (1 - p0[:12]) / many)).all()


def test_marginals_of_the_operator(spark):
    """One run over many sources of the same sizes, in several partitions and levels: each size is taken as its probability says."""
    sizes, many, x = [1, 2, 3, 5, 8, 13, 21, 34], 300, 0.3
    rows = [(k * len(sizes) + i, f"s{k}", s) for k in range(many) for i, s in enumerate(sizes)] + [(10**6, "cap", int(sum(sizes) * x))]
    df = spark.createDataFrame(rows, "id long, source string, size int")
    t = spark.createDataFrame([(f"s{k}", 1.0, 1) for k in range(many)] + [("cap", 1.0, 1)], "source string, target_share double, max_repeats int")
    copies, _ = mix(df, "id", "source", "size", t, rows_per_task=700, fan_in=3)
    taken = Counter(r.id % len(sizes) for r in copies.filter("source <> 'cap'").collect())
    x = int(sum(sizes) * x) / sum(sizes)
    for i in range(len(sizes)):
        assert abs(taken[i] / many - x) <= 3.5 * (x * (1 - x) / many) ** 0.5


@pytest.mark.parametrize("total", [None, 60_000])
def test_many_target_sources(spark, monkeypatch, total):
    rng = random.Random(3)
    rows = [(i, f"s{rng.randrange(7)}", rng.randrange(1, 60)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, source string, size int")
    t = spark.createDataFrame([(f"s{i}", (i + 1) / 36, 1 + i % 3) for i in range(8)], "source string, target_share double, max_repeats int")
    few = sorted(map(tuple, mix(df, "id", "source", "size", t, total)[0].collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 3)
    assert sorted(map(tuple, mix(df, "id", "source", "size", t, total)[0].collect())) == few
