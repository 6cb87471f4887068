"""Feature rows of candidate relations between parts and suppliers, as metabolites and genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators import features as X
from lodegraph.queries.learning import _CAND, _candidates
from lodegraph.runtime import table

C = F.col


def _entities(spark, d):
    i = table(spark, d, "lineitem")
    orders = F.count_distinct("l_orderkey").cast("double")
    sides = []
    for key, other, prefix, kind, names, text in (
        ("l_partkey", "l_suppkey", "p", "metabolite", table(spark, d, "part").select(C("p_partkey").alias("k"), C("p_name").alias("n"), C("p_type").alias("t")), "t"),
        ("l_suppkey", "l_partkey", "s", "gene", table(spark, d, "supplier").select(C("s_suppkey").alias("k"), C("s_name").alias("n"), F.lit("glycolysis cell").alias("t")), "t"),
    ):
        sums = i.groupBy(C(key).alias("k")).agg(
            F.count("*").cast("double").alias("graph_degree"), orders.alias("literature_support_count"), F.collect_set(F.concat(F.lit("w"), F.pmod(other, F.lit(13)))).alias("pathway_context_uids"), F.count_if(C("l_discount") >= 0.1).cast("double").alias("prediction_overlay_count")
        )
        sides.append(sums.join(names, "k").select(F.concat(F.lit(prefix), "k").alias("entity_uid"), F.lit(kind).alias("type"), C("n").alias("display_name"), C(text).alias("document"), "graph_degree", "literature_support_count", "pathway_context_uids", "prediction_overlay_count"))
    return sides[0].unionByName(sides[1])


def _literature(spark, d):
    c = _candidates(spark, d)
    return X.literature_candidates(c.select(
        F.concat(F.lit("p"), "l_partkey").alias("subject_uid"), F.lit("metabolite").alias("subject_type"), F.concat(F.lit("s"), "l_suppkey").alias("object_uid"), F.lit("gene").alias("object_type"), F.lit("regulates_gene").alias("predicate"),
        "support_class", C("p").alias("p_literature"), C("articles").alias("distinct_article_count"), C("sentences").alias("evidence_sentence_count"), C("known").cast("long").alias("supported_existing_edge_count"),
        C("uid").alias("support_uid"), C("year").alias("publication_year"), F.array(F.concat(F.lit("y"), C("l_partkey").cast("string"))).alias("pmids"), F.concat(F.lit("cell c"), C("l_suppkey").cast("string")).alias("context"),
    ))


def candidate_features(spark: SparkSession, d: str) -> DataFrame:
    rows = X.feature_rows(_literature(spark, d), _entities(spark, d), 1998)
    r = lambda c: F.round(c, 9).alias(c)
    return rows.select(
        C("source_ref").alias("uid"), "relation_family", "subject_object_family", "weak_label_class", "group_id", "split", "publication_year", r("entity_semantic_overlap"), "metabolic_theme_overlap", "cell_context_overlap",
        r("graph_degree_balance"), r("graph_degree_sum_log"), r("shared_pathway_jaccard"), "metabolite_target_pathway_bridge", r("endpoint_support_min_log"), r("source_independent_prior_score"), r("literature_support_score"), "direct_graph_support_indicator",
    )


def candidate_families(spark: SparkSession, d: str) -> DataFrame:
    """How many candidates each family gives, with the labels that known edges get from their features."""
    lit = _literature(spark, d)
    i = table(spark, d, "lineitem").filter("l_linenumber = 1").select("l_partkey", "l_suppkey", "l_returnflag").groupBy("l_partkey", "l_suppkey").agg(F.min("l_returnflag").alias("flag"))
    ends = (F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey"))
    edges = i.select(ends[0].alias("subject_uid"), F.lit("metabolite").alias("subject_type"), ends[1].alias("object_uid"), F.lit("gene").alias("object_type"), F.lit("metabolite_gene").alias("edge_type"), F.concat(*ends).alias("edge_uid"), F.when(C("flag") == "A", "curated_database").otherwise("predicted").alias("evidence_level"))
    graph = X.graph_candidates(edges)
    drugs = table(spark, d, "lineitem").filter("l_quantity >= 49").select(F.concat(F.lit("d"), "l_partkey").alias("drug_id"), ends[1].alias("target_uid"), (C("l_discount") * 8).alias("confidence"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("source_record_id"))
    entities = _entities(spark, d)
    found = X.union_candidates(lit, graph, X.overlay_candidates(drugs))
    rows = X.feature_rows(X.union_candidates(found, X.negative_candidates(lit, entities.select(C("entity_uid").alias("entity"), "type"))), entities, 1998)
    rows = X.settle_graph_labels(rows, graph.filter("_curated"))
    return rows.groupBy("source_kind", "weak_label", "weak_label_class").agg(F.count("*").alias("n"), F.min("label_score").alias("least_score"), F.max("label_score").alias("most_score"))


QUERIES = {f.__name__: f for f in (candidate_features, candidate_families)}

_HEX = "('0x' || left(sha256({x}), 12))::bigint % {n}"
ORACLES = {
    "candidate_features": f"""
        with {_CAND},
        ep as (select l_partkey as k, count(*) as g, count(distinct l_orderkey) as o, list(distinct l_suppkey % 13) as w, count(*) filter (l_discount >= 0.1) as v from lineitem group by 1),
        es as (select l_suppkey as k, count(*) as g, count(distinct l_orderkey) as o, list(distinct l_partkey % 13) as w, count(*) filter (l_discount >= 0.1) as v from lineitem group by 1),
        tp as (select p_partkey as k, list_distinct(regexp_extract_all(lower(p_name || '  ' || p_type), '[a-z0-9][a-z0-9_-]+')) as t from part),
        ts as (select s_suppkey as k, list_distinct(regexp_extract_all(lower(s_name || '  glycolysis cell'), '[a-z0-9][a-z0-9_-]+')) as t from supplier),
        j as (select lab.*, ep.g as gp, es.g as gs, ep.o as op, es.o as os, ep.v + es.v > 0 as v, tp.t as pt, ts.t as st, len(list_intersect(ep.w, es.w)) as sh, len(list_distinct(list_concat(ep.w, es.w))) as ei,
          list_distinct(list_concat(tp.t, ts.t)) as bt, ['cell', 'c' || l_suppkey] as cw
          from lab join ep on ep.k = l_partkey join es on es.k = l_suppkey join tp on tp.k = l_partkey join ts on ts.k = l_suppkey),
        f as (select *, len(list_intersect(pt, st))::double / len(bt) as so, sh::double / ei as pj, ln(1 + least(op, os)) as sl, ln(1 + least(gp, gs)) as gl, len(list_intersect(list_intersect(pt, st), ['glycolysis', 'lipid', 'carbon', 'one', 'serine', 'redox'])) as th,
          len(list_intersect(list_intersect(cw, bt), ['cell', 'cells', 'tissue', 'tumor', 'immune', 'cancer'])) as ce from j)
        select uid, 'metabolite_gene' as relation_family, 'metabolite:gene' as subject_object_family, case weak_label when 'negative_refute' then 'contradicted' when 'abstain' then 'insufficient_evidence' else 'supported' end as weak_label_class,
          'paper_id:y' || l_partkey as group_id, case when year >= 1998 then 'temporal_holdout' when {_HEX.format(x="'cell c' || l_suppkey", n=20)} = 0 then 'context_holdout' when {_HEX.format(x="'paper_id:y' || l_partkey", n=100)} < 15 then 'test'
            when {_HEX.format(x="'paper_id:y' || l_partkey", n=100)} < 30 then 'validation' else 'train' end as split, year as publication_year, round(so, 9) as entity_semantic_overlap, th::double as metabolic_theme_overlap, ce::double as cell_context_overlap,
          round(least(gp, gs)::double / greatest(gp, gs), 9) as graph_degree_balance, round(ln(1 + gp + gs), 9) as graph_degree_sum_log, round(pj, 9) as shared_pathway_jaccard, (sh > 0)::int::double as metabolite_target_pathway_bridge, round(sl, 9) as endpoint_support_min_log,
          round(least(1, 0.18::double * least(1, sl / 5) + 0.16::double * least(1, gl / 5) + 0.16::double * least(1, so * 2.5::double) + 0.18::double * least(1, pj * 5) + 0.12::double * (sh > 0)::int + 0.1::double * v::int + 0.1::double * (th > 0)::int), 9) as source_independent_prior_score,
          round(ln(1 + sentences) * p, 9) as literature_support_score, known::int::double as direct_graph_support_indicator from f""",
}
