"""Feature rows worked out by hand."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import features as X

RELATION = "subject_uid string, subject_type string, object_uid string, object_type string, predicate string, support_class string, p_literature double, distinct_article_count int, evidence_sentence_count int, supported_existing_edge_count int, pmids array<string>, publication_year int, support_uid string"
RELATIONS = [
    ("m1", "metabolite", "g1", "gene", "regulates", "confirm", 0.9, 3, 4, 1, ["9", "12"], 2020, "r1"),
    ("m1", "metabolite", "gone", "gene", "disease marker", "refute", None, None, None, None, [], None, "r2"),
    ("", "metabolite", "g1", "gene", "x", "confirm", 1.0, 9, 9, 9, [], 2030, "r3"),
    ("m2", None, "g1", None, None, None, None, None, None, None, None, None, None),
]
ENTITIES = [("m1", "Lactate", "lactate of cells", 8.0, 3.0, ["a", "b"], 1.0), ("g1", "LDH gene", "makes lactate", 2.0, 15.0, ["b", "c"], 0.0), ("m2", None, None, None, None, None, None)]


def test_feature_rows(spark):
    lit = X.literature_candidates(spark.createDataFrame(RELATIONS, RELATION))
    ent = spark.createDataFrame(ENTITIES, "entity_uid string, display_name string, document string, graph_degree double, literature_support_count double, pathway_context_uids array<string>, prediction_overlay_count double")
    rows = {r.source_ref: r for r in X.feature_rows(lit, ent).collect()}
    assert set(rows) == {"r1", "r2", ""}
    r = rows["r1"]
    assert r.candidate_uid == "lit_" + hashlib.sha256(b"m1|regulates|g1|r1").hexdigest()[:24]
    assert (r.relation_family, r.weak_label, r.weak_label_class, r.group_id, r.publication_year) == ("metabolite_gene", "strong_positive", "supported", "paper_id:12", 2020)
    # lactate, of, cells and ldh, gene, makes, lactate: one of six words in common
    assert r.entity_semantic_overlap == pytest.approx(1 / 6) and r.metabolic_theme_overlap == 1 and r.shared_pathway_jaccard == pytest.approx(1 / 3)
    assert r.graph_degree_balance == 0.25 and r.endpoint_support_min_log == pytest.approx(math.log(4)) and r.literature_support_score == pytest.approx(math.log(5) * 0.9)
    prior = 0.18 * math.log(4) / 5 + 0.16 * math.log(3) / 5 + 0.16 * 2.5 / 6 + 0.18 + 0.12 + 0.10 + 0.10
    assert r.source_independent_prior_score == pytest.approx(prior)
    assert (rows["r2"].relation_family, rows["r2"].weak_label_class, rows["r2"].group_id, rows["r2"].object_name) == ("metabolite_disease", "contradicted", "support_uid:r2", None)
    assert rows[""].relation_family == "unknown" and rows[""].source_independent_prior_score == 0 and rows[""].group_id.startswith("candidate_uid:lit_")
    assert len(r) >= 70 and X.feature_rows(lit.limit(0), ent).count() == 0


def test_families(spark):
    edges = spark.createDataFrame([("e1", "m1", "metabolite", "g1", "gene", "t", "Curated db"), ("e2", "m1", "metabolite", "g2", "gene", "t", None), (None, "m1", "metabolite", "g3", "gene", "t", None)], "edge_uid string, subject_uid string, subject_type string, object_uid string, object_type string, edge_type string, evidence_level string")
    graph = X.graph_candidates(edges)
    drugs = spark.createDataFrame([("d", "g1", 0.8, "x"), ("d", "g2", None, "y"), ("d", None, 0.9, "z")], "drug_id string, target_uid string, confidence double, source_record_id string")
    pool = spark.createDataFrame([(f"g{i}", "gene") for i in range(1, 9)], "entity string, type string")
    negatives = X.negative_candidates(X.union_candidates(graph), pool)
    assert negatives.count() == 2 and not {r.object_uid for r in negatives.collect()} & {"g1", "g2"}
    every = X.union_candidates(graph, X.overlay_candidates(drugs), negatives)
    ent = spark.createDataFrame([("m1", 1.0)], "entity_uid string, graph_degree double")
    rows = X.settle_graph_labels(X.feature_rows(every, ent), graph.filter(F.col("_curated")))
    got = {(r.source_kind, r.object_uid): (r.weak_label, r.label_score) for r in rows.filter("source_kind <> 'shuffled_negative'").collect()}
    assert got == {
        ("canonical_graph_edge", "g1"): ("weak_positive", 0.56), ("canonical_graph_edge", "g2"): ("weak_positive", 0.5), ("drug_target_overlay", "g1"): ("medium_positive", 0.72), ("drug_target_overlay", "g2"): ("abstain", 0.0),
    }
