"""Operators against brute force and on edge cases: nulls, ties, repeats, empty tables, clashing names."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from lodegraph.functions import keys as K
from lodegraph.functions import text as X
from lodegraph.functions import values as V
from lodegraph.operators import enrichment as E
from lodegraph.operators import graph as G
from lodegraph.operators import learning as L
from lodegraph.operators import literature as Lit
from lodegraph.operators import metrics as M
from lodegraph.operators import ml
from lodegraph.operators import ordering as O
from lodegraph.operators import overlays as Ov
from lodegraph.operators import release as R
from lodegraph.operators import resolve as Res


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'array<string>' if isinstance(v, list) else 'long'}" for k, v in values.items()))
    return df.select(column.alias("x")).head()["x"]


def test_uids(spark):
    want = "g_" + hashlib.sha1(b"A|b").hexdigest()[:20]
    assert one(spark, K.stable_uid_sha1("g", F.col("a"), F.col("b"), F.col("c")), a=" A ", b="b", c=None) == want
    assert one(spark, K.stable_uid_sha256("g", F.col("a")), a="x") == "g_" + hashlib.sha256(b"x").hexdigest()[:20]
    assert one(spark, K.hash_bucket(F.col("a"), 12, 100), a="abc") == int(hashlib.sha256(b"abc").hexdigest()[:12], 16) % 100


@pytest.mark.parametrize(
    ("raw", "want"),
    [("H2O", "H2O"), ("O2C6H12", "C6H12O2"), ("C6H12O6C", "C7H12O6"), ("NaCl", "ClNa"), ("C1H4", "CH4"), ("x?", "x?"), ("", "")],
)
def test_hill(spark, raw, want):
    assert one(spark, K.hill_formula(F.col("a")), a=raw) == want


def test_keys(spark):
    assert one(spark, K.folded_key(F.col("a")), a=" Ｓtraße  X ") == "strasse x"
    assert one(spark, K.folded_key(F.col("a")), a=None) is None
    assert one(spark, K.id_token(F.col("a")), a="Mondo_ 001") == "mondo:001"
    assert one(spark, K.prefixed_id(F.col("a")), a="efo_12") == "EFO:12"
    assert one(spark, K.prefixed_id(F.col("a")), a="R-HSA-5") == "REACTOME:R-HSA-5"
    assert one(spark, K.parse_xref(F.col("a"))["key"], a='UMLS_CUI:C1 {x="y"}') == "UMLS:C1"
    assert one(spark, K.distinct_nonblank(F.col("a")), a=["b", " a", "-", "", "b ", None]) == ["b", "a"]
    assert one(spark, K.to_float(F.col("a")), a="nan") is None
    assert one(spark, K.to_int(F.col("a")), a="7.0") == 7
    assert one(spark, K.publication_year(F.col("a")), a="May 2019, 3") == 2019
    assert one(spark, K.canonical_json({"b": F.col("a"), "a": F.lit("x"), "c": F.lit(None)}), a='"q"') == '{"a":"x","b":"\\"q\\""}'


def test_values(spark):
    good = lambda v: one(spark, V.usable(F.col("a")), a=v)
    assert all(good(v) for v in ("SEPT7", "kinase 5.", "x [Source: y]", "MARCH1", "lys", "A-1"))
    assert not any(good(v) for v in (None, "", " - ", "N/A", "Sep-04", "1-MAR", "3/3/2021", "2.31E+13", "cut o…", "cut..", "cut [truncated]", "cut (cont.", "cut <more>"))
    assert [one(spark, V.bare_number(F.col("a")), a=v) for v in ("PMID:0030", " 30\t", "30.0", "x30y", "0", None)] == [30, 30, 30, None, None, None]


@pytest.mark.parametrize(
    ("text", "status"),
    [
        ("Compound A increased in tumour tissue.", "support"),
        ("There was no significant difference between groups.", "contradict"),
        ("Results were conflicting across cohorts.", "uncertain"),
        ("A is not required for growth.", "uncertain"),
        ("A did not rescue growth.", "contradict"),
        ("Not only A but also B was measured.", "support"),
        ("A may drive growth.", "uncertain"),
        ("However A increased.", "uncertain"),
        ("A has been reported in canonical work.", "background"),
    ],
)
def test_assertions(spark, text, status):
    assert one(spark, X.assertion_status(X.cues(F.col("a"))), a=text) == status


def test_sentences(spark):
    assert one(spark, X.sentences(F.col("a")), a="One two three. Short. And   then\nmore of it here!") == ["One two three.", "more of it here!"]
    assert one(spark, X.cues(F.col("a"), F.col("b")), a="plain words", b="Review") == ["background"]


def test_longest_matches(spark):
    rng = random.Random(3)
    rows = [(s, rng.choice("AB"), rng.randrange(12), rng.randrange(1, 5), f"e{i}", round(rng.random(), 3)) for s in range(30) for i in range(9)]
    df = spark.createDataFrame(rows, "s int, entity_type string, token_from int, w int, entity_uid string, confidence double").withColumn("token_to", F.col("token_from") + F.col("w")).withColumn("surface_key", F.lit("k")).drop("w")
    got = {(r.s, r.entity_type, r.token_from, r.token_to, r.entity_uid) for r in Lit.longest_matches(df, ["s"], 100).collect()}
    want = set()
    for s in range(30):
        for kind in "AB":
            kept = []
            for r in sorted((f, -(f + w), e, c, f + w) for s2, k, f, w, e, c in rows if s2 == s and k == kind):
                if all(r[4] <= f or r[0] >= t for f, t in kept):
                    kept.append((r[0], r[4]))
                    want.add((s, kind, r[0], r[4], r[2]))
    assert got == want
    assert Lit.longest_matches(df.limit(0), ["s"]).count() == 0


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("x", "x"), (None, "a")], "c string, p string")
    got = {tuple(r) for r in G.closure(e, "c", "p").collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("b", "a", 2), ("c", "a", 1), ("c", "b", 2), ("d", "a", 1), ("d", "b", 2), ("d", "c", 3)}
    pairs = spark.createDataFrame([("r3", "i"), ("r1", "i"), ("r2", None), ("r3", "j"), ("r9", "j"), (None, "j")], "r string, i string")
    assert {tuple(r) for r in G.identity_clusters(pairs, "r", "i").collect()} == {("r1", "r1"), ("r3", "r1"), ("r9", "r1"), ("r2", "r2")}
    edges = spark.createDataFrame([("s", "m", 0.5), ("m", "t", 0.5), ("s", "t", 0.2), ("t", "s", 1.0)], "subject string, object string, p double")
    ends = spark.createDataFrame([("t",)], "node string")
    got = G.cheapest_paths(edges, spark.createDataFrame([("s",)], "node string"), ends, 3, 2).orderBy("rank").collect()
    assert [(r.path, round(r.cost, 6)) for r in got] == [(["s", "m", "t"], round(-2 * math.log(0.5), 6)), (["s", "t"], round(-math.log(0.2), 6))]
    pr = {r.node: r.score for r in G.personalised_pagerank(edges.withColumnRenamed("p", "weight"), ends.withColumn("mass", F.lit(2.0)), 1).collect()}
    assert pr["t"] == pytest.approx(0.15) and pr["s"] == pytest.approx(0.85)


def test_ordering(spark):
    df = spark.createDataFrame([(i * 7 % 101, f"n{i}") for i in range(500)], "k int, n string")
    out = O.dense_index(df, ["k", "n"], "at", 60).collect()
    want = sorted((r.k, r.n) for r in out)
    assert [(r.k, r.n) for r in sorted(out, key=lambda r: r["at"])] == want and sorted(r["at"] for r in out) == list(range(500))
    assert O.dense_index(df.limit(0), ["k"], "at").count() == 0
    first = {r.k: r.n for r in O.first_in_group(df, ["k"], ["n"]).collect()}
    assert all(first[k] == min(r.n for r in out if r.k == k) for k in first)
    q = O.staged_queue(df, "n", [("a", F.col("k") < 5, [F.asc("k"), F.asc("n")], 3), ("b", F.lit(True), [F.asc("k"), F.asc("n")], 4)]).collect()
    assert len(q) == 7 and len({r.n for r in q}) == 7


def test_resolution(spark):
    c = spark.createDataFrame([(1, "u", 0.9), (1, "v", 0.85), (2, "u", 0.9), (3, "u", 0.5), (4, "u", 0.9), (4, "v", 0.7), (4, "u", 0.2)], "k int, uid string, s double")
    got = {r.k: (r.status, r.uid) for r in Res.settle(c, "k", "uid", "s", 0.6, 0.12).collect()}
    assert got == {1: ("ambiguous", None), 2: ("matched", "u"), 3: ("ambiguous", None), 4: ("matched", "u")}
    rng = random.Random(1)
    xs = [(i, rng.uniform(100, 110)) for i in range(200)]
    a, b = spark.createDataFrame(xs, "a int, x double"), spark.createDataFrame(xs + [(999, None)], "b int, y double")
    got = {(r.a, r.b) for r in Res.tolerance_join(a, "x", b, "y", F.col("x") * 1e-4, 0.02).collect()}
    assert got == {(i, j) for i, x in xs for j, y in xs if abs(x - y) <= x * 1e-4}
    ask = spark.createDataFrame([("q", "RYAAAAAAAAAAAA-BBBBBBBBBB-N"), ("n", "42"), ("x", "CHEBI:7"), ("t", "Some Name"), ("e", " ")], "k string, t string")
    kinds = {(r.k, r.namespace) for r in Res.expand_queries(ask, "k", "t").collect()}
    assert kinds == {("q", "INCHIKEY"), ("q", "TEXT"), ("n", "CID"), ("n", "TEXT"), ("x", "CHEBI"), ("x", "TEXT"), ("t", "TEXT")}


def test_metrics(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(12) / 12, int(rng.random() < 0.4), rng.randrange(7)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, s double, y int, o int")
    pos, neg = [s for _, s, y, _ in rows if y], [s for _, s, y, _ in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert M.roc_auc(df, "s", "y").head().auc == pytest.approx(auc)
    assert M.pairwise_accuracy(df.filter("y = 1").withColumn("g", F.lit(1)), df.filter("y = 0").withColumn("g", F.lit(1)), ["g"], "s").head().accuracy == pytest.approx(auc)
    assert M.roc_auc(df.filter("y = 1"), "s", "y").head().auc is None
    ap, tp = 0.0, 0
    for s in sorted({s for _, s, _, _ in rows}, reverse=True):
        here = sum(1 for _, t, y, _ in rows if y and t == s)
        tp += here
        ap += here * tp / sum(1 for _, t, _, _ in rows if t >= s)
    assert M.average_precision(df, "s", "y").head().average_precision == pytest.approx(ap / len(pos))

    def ranks(v):
        return [sum(w < x for w in v) + (sum(w == x for w in v) + 1) / 2 for x in v]

    a, b = ranks([r[1] for r in rows]), ranks([r[3] for r in rows])
    ma, mb = sum(a) / 400, sum(b) / 400
    r = sum((x - ma) * (y - mb) for x, y in zip(a, b, strict=True)) / math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b))
    assert M.spearman(df, "s", "o").head().spearman == pytest.approx(r)
    cal = M.calibration(spark.createDataFrame([(1.0, 2), (0.95, 0), (0.05, 0)], "p double, y int"), "p", "y").head()
    assert cal.overclaim_rate == pytest.approx(1 / 3) and cal.brier == pytest.approx((0.95**2 + 0.05**2) / 3)


def test_enrichment(spark):
    m = spark.createDataFrame([("A", i) for i in range(10)] + [("B", i) for i in range(5, 25)] + [("B", 5)], "s string, i int")
    chosen = spark.createDataFrame([(i,) for i in range(8)], "i int")
    got = {r.s: r for r in E.over_representation(m, "s", "i", chosen, 100).collect()}

    def tail(size, overlap):
        return sum(math.comb(size, k) * math.comb(100 - size, 8 - k) for k in range(overlap, min(size, 8) + 1)) / math.comb(100, 8)

    assert got["A"].p_value == pytest.approx(tail(10, 8)) and got["B"].p_value == pytest.approx(tail(20, 3))
    assert got["A"].fdr == pytest.approx(min(1, 2 * tail(10, 8)))
    # a universe of any size, and false discovery rates over several blocks with ties
    big = spark.createDataFrame([(50_000_000, 40)], "n long, k long").select(E.ln_choose(F.col("n"), F.col("k"))).head()[0]
    assert big == pytest.approx(math.lgamma(50_000_001) - math.lgamma(41) - math.lgamma(49_999_961), rel=1e-7)
    ps = [round(((i * 37) % 101) / 130 + 0.001, 2) for i in range(200)]
    fdr = {r.i: r.fdr for r in E.benjamini_hochberg(spark.createDataFrame(list(enumerate(ps)), "i int, p double"), "p", ["i"], 16).collect()}
    for i, p in enumerate(ps):
        assert fdr[i] == pytest.approx(min(min(1, q * 200 / sum(x <= q for x in ps)) for q in ps if q >= p))


def test_release(spark, tmp_path):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    delta = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    once = R.upsert(base, delta, ["k"])
    assert {tuple(r) for r in R.upsert(once, delta, ["k"]).collect()} == {(1, "a"), (2, "B"), (3, "c")}
    path = str(tmp_path / "t")
    assert R.write_upsert(spark, path, base, ["k"]) == 2 and R.write_upsert(spark, path, delta, ["k"]) == 3
    d = lambda df: R.content_digest(df).head().digest
    assert d(base) == d(base.orderBy(F.desc("k"))) != d(delta)
    notes = R.build_notes([("warn", "x", base), ("error", "y", base.limit(0))], spark)
    assert [tuple(r) for r in notes.collect()] == [("warn", "x", "2 rows")]
    gates = {r.check: r.passed for r in R.gate_rows(base, [("n", F.count("*"), 2), ("m", F.max("k"), 5)]).collect()}
    assert gates == {"n": True, "m": False}


def test_overlays(spark):
    left = spark.createDataFrame([("d1", "g1", None), ("d2", None, "u2"), ("d3", "g1", "u1")], "drug string, gene string, uni string")
    right = spark.createDataFrame([("t1", "g1", "u1"), ("t2", "g2", "u2")], "target string, gene string, uni string")
    got = {tuple(r) for r in Ov.any_key_join(left, "drug", [("gene", "gene"), ("uni", "uni")], right, "target").collect()}
    assert got == {("d1", "t1", "gene"), ("d2", "t2", "uni"), ("d3", "t1", "gene")}
    assert Ov.exclude_terms(right, ["G1"]).count() == 1


def test_learning(spark):
    pos = spark.createDataFrame([("a", "p", f"o{i}", "T") for i in range(4)] + [("b", "p", "o1", "T")], "subject string, predicate string, object string, object_type string")
    pool = spark.createDataFrame([(f"o{i}", "T") for i in range(6)] + [("z", "S")], "entity string, type string")
    neg = {tuple(r) for r in L.hashed_negatives(pos, pool, 3).collect()}
    true = {(r.subject, r.object) for r in pos.collect()}
    assert neg and not {(s, o) for s, _, o, _ in neg} & true and {o for _, _, o, _ in neg} <= {f"o{i}" for i in range(6)}
    assert {o for s, _, o, _ in neg if s == "a"} <= {"o4", "o5"}


def test_models(spark):
    rng = random.Random(2)
    rows = [(i, rng.random(), rng.choice("xy")) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, a double, c string").withColumn("y", (F.col("a") > 0.5).cast("double")).withColumn("w", F.lit(1.0))
    out = ml.boosted_scores(df.filter("id < 200"), df.filter("id >= 200"), ["a"], ["c"], "y", "w", 20, 3)
    assert out.count() == 100 and M.roc_auc(out.withColumn("l", F.col("y").cast("int")), "model_score", "l").head().auc > 0.95
    iso = ml.isotonic(df, df, "a", "y").orderBy("a").select("calibrated").collect()
    assert all(p.calibrated <= q.calibrated + 1e-12 for p, q in zip(iso, iso[1:], strict=False))
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(80)] + [(99, [0.0] * 4)], "id int, v array<double>")
    near = ml.nearest_neighbours(v.filter("id < 5"), v, "id", "v", 3).collect()
    data = {r.id: r.v for r in v.collect()}

    def cos(a, b):
        s = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / s if s else 0.0

    for q in range(5):
        want = sorted((-cos(data[q], data[j]), j) for j in data if j != q)[:3]
        assert [r.id for r in sorted(near, key=lambda r: r.rank) if r.query == q] == [j for _, j in want]
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta delta"), (3, ""), (4, None)], "id int, t string")
    vec = {r.id: r.vector for r in ml.term_vectors(docs, "id", "t", 2, 64, 1.0, 1.0).collect()}
    assert set(vec) == {1, 2, 3, 4}
