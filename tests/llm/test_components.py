import random

import pytest

from lodegraph import runtime
from lodegraph.llm import components
from lodegraph.llm.components import connected_components, group_by_identifier


def union_find(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    groups = {}
    for x in list(up):
        groups.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


def groups_of(df):
    groups = {}
    for v, label in df.collect():
        groups.setdefault(label, set()).add(v)
    return {frozenset(g) for g in groups.values()}


def graphs():
    rng = random.Random(4)
    star = [("hub", f"s{i:03d}") for i in range(200)]
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(150)]
    noise = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(160)]
    lollipop = [("hub", "t000")] + [(f"t{i:03d}", f"t{i + 1:03d}") for i in range(40)]
    return {"all": star + chain + noise + lollipop, "chain": chain, "loops": [("a", "a"), ("b", "b"), ("b", "c")] * 3, "pair": [("x", "y")]}


@pytest.mark.parametrize("least", [0, 100_000])
@pytest.mark.parametrize("name", list(graphs()))
def test_components(spark, name, least, monkeypatch):
    monkeypatch.setattr(runtime, "HOT_LEAST", least)
    pairs = graphs()[name]
    df = spark.createDataFrame(pairs, "l string, label string")
    assert groups_of(connected_components(df, "l", "label")) == union_find(pairs)


def test_second_hub_is_split(spark, monkeypatch):
    """Three hubs with a third of the links each, far from each other: the second and third are hot in the joins after the first."""
    monkeypatch.setattr(runtime, "HOT_LEAST", 50)
    monkeypatch.setattr(runtime, "HOT_PARTS", 10)
    found = []
    old = components.split_join
    monkeypatch.setattr(components, "split_join", lambda a, b, key, hot, how="inner": (found.extend(hot.collect() if hot else []), old(a, b, key, hot, how))[1])
    pairs = [(f"h{k}", f"{k}-{i}") for k in range(3) for i in range(100 - 10 * k)] + [("0-1", "b1"), ("b1", "b2"), ("b2", "1-1")]
    pairs += [(f"{k}-{i}", f"{k}-{i + 1}") for k in range(3) for i in range(50, 60)]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert groups_of(connected_components(df, "a", "b", peel_rounds=2)) == union_find(pairs)
    assert {"h0", "h1", "h2"} <= {r[0] for r in found}


def test_null_and_empty(spark):
    df = spark.createDataFrame([("a", None), (None, "b")], "x string, y string")
    assert connected_components(df, "x", "y").count() == 0
    assert connected_components(df.limit(0), "x", "y").count() == 0


def test_identifiers(spark):
    rows = [("r2", "A"), ("r1", "A"), ("r1", "A"), ("r1", "B"), ("r3", "B"), ("r4", "C"), ("r5", None), (None, "C")]
    df = spark.createDataFrame(rows, "v string, i string")
    got = {tuple(r) for r in group_by_identifier(df, "v", "i").collect()}
    assert got == {("r1", "r1", 3), ("r2", "r1", 3), ("r3", "r1", 3), ("r4", "r4", 1)}


def test_identifier_spellings(spark):
    from pyspark.sql import functions as F

    from lodegraph.llm.queries import _with_identifier

    same = [
        [("MDB", "MDB0000048"), ("mdb ", " mdb00048"), ("Mdb", "MDB:MDB0000048"), ("MDB", "MDB:0000048"), ("MDB", "MDB-48")],
        [("CHX", "CHX:265"), (" CHX", "265"), ("chx", "CHX_265"), ("CHX", "CHX: 265")],
        [("PCID", "9999"), ("pcid", "9999.0"), ("PCID", "PCID 9999"), ("PCID", "PCID9999")],
        [("KGC", "C00184"), ("KGC", "c00184"), ("KGC", "KGC:C00184")],
        [("INK", "AANTDCWAZXXASU-RKAAAAAASA-N"), ("ink", "INK:aantdcwazxxasu-rkaaaaaasa-n")],
        [("MDB", "0"), ("KGC", "n/a"), ("KGC", " "), (None, "5"), ("MDB", None), ("", "5"), ("LMD", "pending"), ("LMD", "Not Assigned"), ("MDB", "MDB0000")],
    ]
    rows = [(g, s, x) for g, members in enumerate(same) for s, x in members] + [(90, "[(", "[(5"), (91, "\\\\", "7"), (92, "$1", "$1:8")]
    df = _with_identifier(spark.createDataFrame(rows, "g int, s string, x string"), "s", "x").select("g", F.col("identifier").alias("i"))
    got = {}
    for g, i in df.collect():
        got.setdefault(g, set()).add(i)
    assert all(len(got[g]) == 1 for g in range(6)) and got[5] == {None}
    assert len({next(iter(got[g])) for g in got}) == 9
    assert got[90] == {"[(:5"}
