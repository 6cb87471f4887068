import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from lodegraph import runtime
from lodegraph.llm.bktree import FAR, BKTree, distance, distances, encode
from lodegraph.llm.canonical import match_names
from lodegraph.llm.names import read

WORD = st.text("abcd", max_size=7)


def dl(a, b):
    """Unrestricted Damerau-Levenshtein distance of two texts, by the definition on all alignments."""
    far = len(a) + len(b)
    d = {(-1, -1): far}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    row = dict.fromkeys(a + b, 0)
    for i in range(1, len(a) + 1):
        col = 0
        for j in range(1, len(b) + 1):
            k, m = row[b[j - 1]], col
            cost = a[i - 1] != b[j - 1]
            col = j if not cost else col
            d[i, j] = min(d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k) + (j - m) - 1)
        row[a[i - 1]] = i
    return d[len(a), len(b)]


def one(a, b):
    (ca, la), (cb, lb) = encode([a]), encode([b])
    return int(distances(ca, la, cb, lb)[0])


@given(WORD, WORD)
def test_distance(a, b):
    assert one(a, b) == dl(a, b) == distance(a, b)


@given(st.text("abc", max_size=14), st.text("abc", max_size=14), st.integers(1, 8))
def test_distance_up_to_far(a, b, far):
    (ca, la), (cb, lb) = encode([a]), encode([b])
    assert int(distances(ca, la, cb, lb, far)[0]) == min(dl(a, b), far)


def test_distances_of_long_texts():
    texts = ["x" * 1000, "x" * 999 + "y", "y" * 1000, "x" * 3000, "a"]
    (ca, la), (cb, lb) = encode(texts[:1] * 5), encode(texts)
    assert distances(ca, la, cb, lb).tolist() == [0, 1, FAR, FAR, FAR]


@given(WORD, WORD, WORD)
def test_metric(a, b, c):
    assert one(a, c) <= one(a, b) + one(b, c)
    assert one(a, b) == one(b, a)
    assert (one(a, b) == 0) == (a == b)


def test_tree_finds_all():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(0, 9)))
    texts = [word() for _ in range(400)]
    tree, queries = BKTree(texts), [word() for _ in range(60)]
    for r in (0, 1, 2, 3):
        for q, hits in zip(queries, tree.within(queries, r), strict=True):
            assert sorted((tree.texts[i], d) for i, d in hits) == sorted((t, dl(q, t)) for t in set(texts) if dl(q, t) <= r)
    assert tree.visited <= len(set(texts)) * 61


def test_tree_of_nothing():
    assert BKTree([]).nearest(["x"], 2) == [[]]
    assert np.array_equal(encode([])[1], np.array([], np.int32))


@pytest.mark.parametrize(
    ("text", "kind", "marker", "chain", "stem"),
    [
        ("L-lisapugenine", "plain", "l", "", "lisapugenine"),
        ("lisapugenine, L-", "plain", "l", "", "lisapugenine"),
        ("lisapugenine (L-form) [lot 24]", "plain", "l", "", "lisapugenine"),
        ("(D)-kizatelunine", "plain", "d", "", "kizatelunine"),
        ("α-ridosofurose", "plain", "alpha", "", "ridosofurose"),
        ("bets-ridosofurose", "plain", "beta", "", "ridosofurose"),
        ("siguzopilic acid", "acid", "", "", "siguzopilic"),
        ("acid, siguzopilic sodium salt", "acid", "", "", "siguzopilic"),
        ("siguzopilicacid", "acid", "", "", "siguzopilic"),
        ("siguzopilic acd stock 12", "acid", "", "", "siguzopilic"),
        ("C18:1 tufalamide", "chain", "", "18:1", "tufalamide"),
        ("tufalamide(18:1) - 336 uM", "chain", "", "18:1", "tufalamide"),
        ('"bipi- gagasone" 99% pure', "plain", "", "", "bipigagasone"),
        ("methyl seminudilate", "plain", "", "", "methylseminudilate"),
        ("dadalukelate (CMGA)", "plain", "", "", "dadalukelate"),
        ("?", "plain", "", "", ""),
    ],
)
def test_read(text, kind, marker, chain, stem):
    assert read(text)[:4] == (kind, marker, chain, stem)


CASES = [
    (1, "siguzopilate"), (1, "siguzopilate"), (2, " SIGUZOPLIC ACID, >98% "), (3, "kizatelunine"), (4, "D-kizatelunine"), (5, "methyl siguzopilate"),
    (6, "gha-7"), (7, None), (8, "  "), (9, "tufalamide 18:1"), (10, "tufalamides"), (11, "tufalamide 20:0"), (12, "something else"), (None, "siguzopilate"),
    (13, "x" * 5000), (14, "standard " * 50_000), (15, "(" * 3000),
]
LABELS = [(1, "siguzopilic acid", None), (2, "D-kizatelunine", None), (3, "L-kizatelunine", None), (4, "bodusamin", "GHA7"), (5, "tufalamide 18:1", None), (6, "tufalamide 18:2", None), (7, None, None)]
WANT = {1: 1, 2: 1, 3: -1, 4: 2, 5: -1, 6: 4, 9: 5, 10: -1, 11: -1, 12: -1, 13: -1, 14: -1, 15: -1}


@pytest.mark.parametrize("limit", [50_000, 2])
def test_match(spark, limit):
    cases = spark.createDataFrame([(*c, 0) for c in CASES], "case_id long, input_name string, entry int")
    labels = spark.createDataFrame(LABELS, "label_id long, label string, code string")
    got = match_names(cases, "case_id", "input_name", labels, "label_id", "label", "code", broadcast_entries=limit)
    assert {r.case_id: r.entry for r in got.collect()} == WANT
    assert match_names(cases.limit(0), "case_id", "input_name", labels, "label_id", "label", broadcast_entries=limit).count() == 0
    none = match_names(cases, "case_id", "input_name", labels.limit(0), "label_id", "label")
    assert {r.entry for r in none.collect()} == {-1}


HARD_LABELS = [
    (1, "L-foobarine", None), (2, "D-foobarin", None), (3, "zerumbone", "LALAN"), (4, "quassinol", "ALAN"), (5, "quassinal", None), (6, "quassinel", "Q7"), (7, "quassinil", "Q7"),
    (8, "tarimol", None), (9, "tarimel", None), (10, "x" * 1500, None), (11, "x" * 1499 + "y", None),
]
HARD_CASES = [(1, "L-foobarin"), (2, "L-ALAN"), (3, "alan"), (4, "q7"), (5, "quassinol"), (6, "quassinul"), (7, "tarimal"), (8, "x" * 1500), (9, "x" * 1501), *[(k, "tarimol") for k in range(20, 60)]]
HARD_WANT = {1: 1, 2: 3, 3: 4, 4: -1, 5: 4, 6: -1, 7: -1, 8: 10, 9: 10} | dict.fromkeys(range(20, 60), 8)


@pytest.mark.parametrize("limit", [50_000, 4, 1])
def test_every_way_of_sharding_gives_the_same(spark, limit, monkeypatch):
    monkeypatch.setattr(runtime, "HOT_LEAST", 10)
    monkeypatch.setattr(runtime, "HOT_PARTS", 5)
    cases = spark.createDataFrame(HARD_CASES, "case_id long, input_name string")
    labels = spark.createDataFrame(HARD_LABELS, "label_id long, label string, code string")
    got = match_names(cases, "case_id", "input_name", labels, "label_id", "label", "code", broadcast_entries=limit)
    assert {r.case_id: r.entry for r in got.collect()} == HARD_WANT
