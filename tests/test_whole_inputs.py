"""Registered queries over whole inputs, on small tables, against brute force."""

import hashlib
import unicodedata
from collections import defaultdict

import pytest

import __spark_entry__ as e
from lodegraph.operators import learning as L


def run(spark, name, path):
    return e.queries()[name](spark, str(path)).collect()


def fold(text):
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


SYNONYMS = [
    (1, ["Alanine", "β-Alanine", "ﬁne salt", None]), (2, ["β-ALANINE", "Ａlanine", "café acid"]), (3, ["β-alanine", "café acid", "tab\tname"]), (4, ["ACYL 16:0", "Straße", "salt"]), (5, None),
]


def test_names_in_any_script(spark, tmp_path):
    spark.createDataFrame([(*r, "Alanine" if r[0] == 1 else None) for r in SYNONYMS], "pubchem_cid long, synonyms array<string>, title string").write.parquet(str(tmp_path / "cid_properties.parquet"))
    owners, spelled = defaultdict(set), defaultdict(set)
    for cid, names in SYNONYMS:
        for s in names or []:
            if s is not None:
                owners[fold(s)].add(cid)
                spelled[fold(s)].add((cid, s))
    risk = {r.name: r for r in run(spark, "name_risk", tmp_path)}
    assert {k: r.n_uids for k, r in risk.items()} == {k: len(v) for k, v in owners.items()}
    got = lambda n: tuple(risk[n])[1:]
    assert got("β-alanine") == (3, "name_maps_to_multiple_metabolites", 35 + 9 + 15, "manual_review_required", "auto_abstain_name_only")
    assert got("alanine") == (2, "name_maps_to_multiple_metabolites", 35, "manual_review_required", "auto_abstain_name_only")
    assert got("acyl 16:0") == (1, "lipid_shorthand_or_chain_notation", 45, "prefer_lipid_identifier", "requires_identifier_or_orthogonal_feature")
    assert got("salt") == (1, "broad_or_short_surface", 35, "avoid_broad_surface", "auto_abstain_name_only")
    assert got("strasse") == (1, "", 15, "review", "monitor")
    queue = run(spark, "review_queue", tmp_path)
    assert {r.name for r in queue} == set(owners) and {r.name for r in queue if r.stage == "block"} == {"β-alanine", "alanine", "café acid", "salt"}
    stats = {r.name: (r.n_rows, r.n_uids, r.best_rank, r.worst_rank) for r in run(spark, "name_statistics", tmp_path)}
    assert stats == {k: (len(v), len(owners[k]), max(len(s) for _, s in v), min(len(s) for _, s in v)) for k, v in spelled.items()}


def test_cases_in_any_script(spark, tmp_path):
    labels = [(1, "m1", "Alanine", None, "AAAAAAAAAAAAAA-BBBBBBBBBB-N"), (2, "m2", "β-alanine", None, None), (3, "m3", "PC 16:0", None, None)]
    cases = [(1, "Ａlanine"), (2, "Β-Alanine"), (3, "alanine\t"), (4, None), (5, "café"), (6, "ＰＣ　１６：０"), (7, "alanine"), (8, "\t "), (9, "café (a, b); β")]
    spark.createDataFrame(labels, "label_id long, metabolite_uid string, label string, short_code string, inchikey string").write.parquet(str(tmp_path / "metabolite_gold_labels.parquet"))
    spark.createDataFrame(cases, "case_id long, input_name string").write.parquet(str(tmp_path / "name_only_cases.parquet"))
    by_key = {fold(label): uid for _, uid, label, *_ in labels}
    hits = {i: by_key[fold(t)] for i, t in cases if t and fold(t) in by_key}
    assert hits == {1: "m1", 2: "m2", 3: "m1", 6: "m3", 7: "m1"}
    assert {r.case_id: r.entity_uid for r in run(spark, "resolve_ranked", tmp_path)} == hits
    assert {r.case_id: r.uid for r in run(spark, "ambiguity_margin", tmp_path)} == hits
    assert {r.case_id: r.uid for r in run(spark, "expanded_seeds", tmp_path)} == hits
    want = {i: "matched" if i in hits else "unmatched" if t and len(fold(t)) > 1 else "invalid" for i, t in cases}
    assert {r.case_id: r.bucket for r in run(spark, "precheck_buckets", tmp_path)} == want
    kinds = {r.case_id: r.kind for r in run(spark, "trait_kinds", tmp_path)}
    assert kinds == {i: "lipid_species" if i == 6 else "compound" for i, t in cases if t and fold(t)}
    decided = {r.case_id: (r.n_candidates, r.decision) for r in run(spark, "identity_decisions", tmp_path)}
    assert decided == {i: (1, "accepted_trait" if i == 7 else "accepted_exact") if i in hits else (0, "unmatched") for i in kinds}
    parts = {(r.case_id, r.part) for r in run(spark, "parts_outside_parentheses", tmp_path)}
    assert {(9, "café (a, b)"), (9, "β"), (1, "Ａlanine")} <= parts


def test_pagerank_settles(spark, tmp_path):
    items = [(1, 1, 4.0), (1, 2, 1.0), (2, 2, 2.0), (3, 2, 5.0), (3, 3, 1.0), (3, 3, 1.0), (4, 3, 7.0)]
    spark.createDataFrame(items, "l_partkey long, l_suppkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, 3), (2, 0), (3, 0)], "s_suppkey long, s_nationkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    weights = defaultdict(lambda: defaultdict(float))
    for p, s, w in items:
        weights[f"p{p}"][f"s{s}"] += w
        weights[f"s{s}"][f"p{p}"] += w
    score = {"s1": 1.0}
    for _ in range(30):
        new = defaultdict(float, s1=0.15)
        for a, x in score.items():
            for b, w in weights[a].items():
                new[b] += 0.85 * x * w / sum(weights[a].values())
        score = new
    assert {r.node: r.score for r in run(spark, "graph_pagerank", tmp_path)} == pytest.approx(score, abs=1e-8)


def test_negatives_of_subjects_that_know_nearly_all(spark):
    pool = [(f"o{i:03}", "T") for i in range(100)] + [(f"a{i}", "S") for i in range(3)]
    known = {"hot": [i for i in range(100) if i not in (40, 41)], "edge": [i for i in range(100) if i != 20], "all": range(100), "few": [3, 99]}
    rows = [(s, "p", f"o{i:03}", "T") for s, x in known.items() for i in x]
    want = set()
    for s, p, o, t in rows:
        at = int(hashlib.sha256(f"{s}|{p}|{o}|0".encode()).hexdigest()[:12], 16) % 10**9
        want |= {(s, p, f"o{i:03}", t) for i in [next((i % 100 for i in range(at, at + 100) if i % 100 not in known[s]), None)] if i is not None}
    got = L.hashed_negatives(spark.createDataFrame(rows, "subject string, predicate string, object string, object_type string"), spark.createDataFrame(pool, "entity string, type string"), 1)
    assert {tuple(r) for r in got.collect()} == want
    assert {s for s, *_ in want} == {"hot", "edge", "few"} and {o for s, _, o, _ in want if s == "hot"} == {"o040", "o041"}
