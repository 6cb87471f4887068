import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lodegraph.llm.packing import pack, place


def sequential(sizes, capacity):
    """Containers of sequential best fit decreasing."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= s]
        if fits:
            i = min(fits, key=lambda i: gaps[i])
            gaps[i] -= s
        else:
            gaps.append(capacity - s)
    return gaps


@given(st.lists(st.integers(1, 30), max_size=80))
def test_place_is_best_fit_decreasing(sizes):
    rules, n = place([(s, sizes.count(s)) for s in set(sizes)], 30)
    used, order = {}, sorted(sizes, reverse=True)
    ends = ([r.first_rank for r in rules[1:]] + [len(order)]) if rules else []
    for r, end in zip(rules, ends, strict=True):
        for rank in range(r.first_rank, end):
            assert order[rank] == r.size
            c = r.container + (rank - r.first_rank) // r.each
            used[c] = used.get(c, 0) + r.size
    assert sorted(30 - u for u in used.values()) == sorted(sequential(sizes, 30))
    assert n == len(used)


def test_frame(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([1, 1, 5, 40, 64, 100, 130, 250])) for i in range(700)]
    rows += [(701, None), (702, 0), (None, 5), (5, 1), (5, 1)]
    df = spark.createDataFrame(rows, "id long, piece int")
    out = pack(df, "id", "piece", 100, rows_per_task=100).collect()
    sizes = {}
    for i, s in rows:
        if i is not None and s:
            sizes[i] = max(sizes.get(i, 0), s)
    for i, s in sizes.items():
        pieces = sorted((r.piece, r.first_unit, r.n_units) for r in out if r.id == i)
        assert [p for p, _, _ in pieces] == list(range(-(-s // 100)))
        assert sum(n for _, _, n in pieces) == s
        assert [f for _, f, _ in pieces] == [100 * p for p, _, _ in pieces]
    assert {r.id for r in out} == set(sizes)
    held = {}
    for r in out:
        held.setdefault(r.container_id, []).append((r.container_offset, r.container_offset + r.n_units))
    for spans in held.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 100
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    units = [n for s in sizes.values() for n in [100] * (s // 100) + ([s % 100] if s % 100 else [])]
    assert len(held) == len(sequential(units, 100))


def test_edges(spark):
    df = spark.createDataFrame([], "id long, n int")
    assert pack(df, "id", "n", 10).count() == 0
    with pytest.raises(ValueError, match="capacity"):
        pack(df, "id", "n", 0)
