"""The feature rows of candidate relations and the families that candidates come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.operators import learning as L

# Words of metabolic themes, of cells and tissues, and words of a predicate that name a family.
THEME_TERMS = (
    "glycolysis", "lactate", "pyruvate", "tca", "citrate", "glutamine", "glutamate", "fatty", "lipid", "carnitine", "serine", "folate", "one", "carbon",
    "purine", "pyrimidine", "redox", "glutathione", "oxidative", "phosphorylation",
)
CELL_TERMS = (
    "cell", "cells", "cellline", "cell_line", "epithelial", "fibroblast", "immune", "macrophage", "tcell", "bcell", "stromal", "endothelial", "tumor",
    "tumour", "cancer", "lineage", "tissue",
)
DISEASE_TERMS = ("disease", "cancer", "tumor", "tumour", "carcinoma", "leukemia", "lymphoma")
PATHWAY_TERMS = ("pathway", "process", "reaction", "metabolic", "metabolism")

#: What a candidate may bring besides its ends; a column that is missing counts as null.
EVIDENCE = {
    "p_literature": "double", "distinct_article_count": "long", "evidence_sentence_count": "long", "supported_existing_edge_count": "long", "overlay_confidence": "double",
    "relevance_mean": "double", "relevance_max": "double", "relevance_min": "double", "relevance_scored_sentence_count": "long", "relevance_evidence_fraction": "double",
    "ner_candidate_count": "long", "ner_unique_surface_count": "long", "ner_label_count": "long", "ner_candidate_sentence_fraction": "double", "ner_candidate_density": "double",
    "pmids": "array<string>", "study_id": "string", "dataset_id": "string", "source_record_id": "string", "support_uid": "string",
    "publication_year": "int", "min_publication_year": "int", "max_publication_year": "int", "context": "string", "signature": "string",
}
#: The columns of an entity; a missing one counts as null.
ENTITY = {
    "display_name": "string", "canonical_name": "string", "document": "string", "graph_degree": "double", "canonical_edge_count": "double", "literature_mention_count": "double",
    "literature_article_count": "double", "literature_support_count": "double", "prediction_overlay_count": "double", "pathway_context_uids": "array<string>",
}


def token_set(*texts: Column) -> Column:
    """The distinct words of some texts, of two signs or more, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", *texts)), F.lit("([a-z0-9][a-z0-9_-]+)"), 1))


def relation_family(subject_type: Column, object_type: Column, predicate: Column) -> Column:
    """subject_disease, subject_pathway or subject_object, by the types and the words of the predicate; `unknown` without types."""
    s, o = F.lower(F.coalesce(subject_type, F.lit(""))), F.lower(F.coalesce(object_type, F.lit("")))
    words = token_set(F.coalesce(predicate, F.lit("")))
    has = lambda terms: F.arrays_overlap(words, F.array(*[F.lit(t) for t in terms]))
    plain = F.regexp_replace(F.concat(s, F.lit("_"), o), "^_+|_+$", "")
    return (
        F.when((o == "disease") | has(DISEASE_TERMS), F.concat(s, F.lit("_disease")))
        .when((o == "pathway") | has(PATHWAY_TERMS), F.concat(s, F.lit("_pathway")))
        .otherwise(F.coalesce(F.nullif(plain, F.lit("")), F.lit("unknown")))
    )


def group_of(candidate_uid: Column, row) -> Column:
    """Struct (group_key, group_id, paper_id): the smallest pmid, else the first id that is given, else the candidate."""
    made = lambda key, value: F.when(F.coalesce(value, F.lit("")) != "", F.struct(F.lit(key).alias("group_key"), value.alias("v")))
    ids = [made("paper_id", F.array_min(F.filter(row("pmids"), lambda x: x != "")))]
    ids += [made(k, row(k)) for k in ("study_id", "dataset_id", "source_record_id", "support_uid")]
    g = F.coalesce(*ids, F.struct(F.lit("candidate_uid").alias("group_key"), candidate_uid.alias("v")))
    paper = F.when(g["group_key"] == "paper_id", g["v"]).otherwise("")
    return F.struct(g["group_key"].alias("group_key"), F.concat_ws(":", g["group_key"], g["v"]).alias("group_id"), paper.alias("paper_id"))


def _filled(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in columns.items() if c not in df.columns])


def feature_rows(candidates: DataFrame, entities: DataFrame, from_year: int = 2024) -> DataFrame:
    """One row of features for each candidate.

    candidates: candidate_uid, subject_uid, subject_type, object_uid, object_type,
    predicate, source_kind, weak_label, label_score, label_reason and what they
    have of EVIDENCE.  entities: entity_uid (unique) and what they have of ENTITY.
    Unknown entities and nulls count as 0 or empty; years below 1 as none.
    """
    c = _filled(candidates, EVIDENCE)
    e = _filled(entities, ENTITY).select(F.col("entity_uid"), F.struct(*ENTITY).alias("_e"))
    j = c.join(e.select(F.col("entity_uid").alias("subject_uid"), F.col("_e").alias("_s")), "subject_uid", "left")
    j = j.join(e.select(F.col("entity_uid").alias("object_uid"), F.col("_e").alias("_o")), "object_uid", "left")
    empty = F.array().cast("array<string>")
    name = lambda side, n: F.col(f"{side}.{n}")
    words = lambda side: token_set(*[F.coalesce(name(side, n), F.lit("")) for n in ("display_name", "canonical_name", "document")])
    year = lambda n: F.when(F.col(n) > 0, F.col(n))
    # each step is a column of its own, so that it is worked out once
    j = j.withColumns({
        "_sw": words("_s"), "_ow": words("_o"), "_cw": token_set(F.coalesce("context", F.lit(""))), "_gw": token_set(F.coalesce("signature", F.lit(""))),
        "_sp": F.array_distinct(F.coalesce(name("_s", "pathway_context_uids"), empty)), "_op": F.array_distinct(F.coalesce(name("_o", "pathway_context_uids"), empty)),
        "relation_family": relation_family(F.col("subject_type"), F.col("object_type"), F.col("predicate")), "_g": group_of(F.col("candidate_uid"), lambda n: F.col(n)),
        "_year": F.coalesce(year("publication_year"), year("max_publication_year"), year("min_publication_year")),
    })
    z = lambda c: F.coalesce(c, F.lit(0.0))
    num = lambda n: z(F.col(n).cast("double"))
    ent = lambda side, n: F.greatest(F.lit(0.0), z(name(side, n)))
    log = lambda c: F.log1p(F.greatest(F.lit(0.0), c))
    low = lambda n: F.least(ent("_s", n), ent("_o", n))
    high = lambda n: F.greatest(ent("_s", n), ent("_o", n))
    both = lambda n: ent("_s", n) + ent("_o", n)
    common = lambda a, b, terms: F.size(F.array_intersect(F.array_intersect(a, b), F.array(*[F.lit(t) for t in terms]))).cast("double")
    shared, either = F.size(F.array_intersect("_sp", "_op")), F.size(F.array_union("_sp", "_op"))
    j = j.withColumns({
        "shared_pathway_count": shared.cast("double"), "shared_pathway_jaccard": F.when(either > 0, shared / either).otherwise(0.0), "entity_semantic_overlap": L.jaccard(F.col("_sw"), F.col("_ow")),
        "metabolic_theme_overlap": common(F.array_union("_sw", "_gw"), F.array_union("_ow", "_gw"), THEME_TERMS), "cell_context_overlap": common(F.array_union("_cw", "_gw"), F.array_union("_sw", "_ow"), CELL_TERMS),
        "signature_entity_overlap": F.size(F.array_intersect("_gw", F.array_union("_sw", "_ow"))).cast("double"), "endpoint_overlay_any": (high("prediction_overlay_count") > 0).cast("double"),
        "endpoint_support_min_log": log(low("literature_support_count")), "graph_degree_min_log": log(low("graph_degree")),
    })
    bridge = F.col("relation_family").isin("metabolite_gene", "metabolite_target", "metabolite_protein") & (F.col("shared_pathway_count") > 0)
    j = j.withColumn("metabolite_target_pathway_bridge", bridge.cast("double"))
    prior = L.prior(
        F.col("endpoint_support_min_log"), F.col("graph_degree_min_log"), F.col("entity_semantic_overlap"), F.col("shared_pathway_jaccard"), F.col("metabolite_target_pathway_bridge"),
        F.col("endpoint_overlay_any"), (F.col("metabolic_theme_overlap") > 0).cast("double"),
    )
    temporal = F.coalesce(F.col("_year") >= from_year, F.lit(False))
    context_held = F.coalesce((F.col("context") != "") & (L.hash_bucket(F.col("context"), 12, 20) == 0), F.lit(False))
    sentences, p = num("evidence_sentence_count"), num("p_literature")
    return j.select(
        "candidate_uid", "subject_uid", "subject_type", name("_s", "display_name").alias("subject_name"), "predicate", "relation_family",
        F.concat_ws(":", F.coalesce("subject_type", F.lit("")), F.coalesce("object_type", F.lit(""))).alias("subject_object_family"), "object_uid", "object_type", name("_o", "display_name").alias("object_name"),
        "source_kind", "weak_label", L.five_class(F.col("weak_label"), F.col("label_reason")).alias("weak_label_class"), "label_score", "label_reason", "_g.group_key", "_g.group_id", "_g.paper_id",
        F.col("_year").alias("publication_year"), F.coalesce(year("min_publication_year"), F.col("_year")).alias("min_publication_year"), F.coalesce(year("max_publication_year"), F.col("_year")).alias("max_publication_year"),
        "study_id", "dataset_id", F.when(temporal, "temporal_holdout").when(context_held, "context_holdout").otherwise(L.split_of(F.col("_g.group_id"))).alias("split"),
        temporal.alias("temporal_holdout"), context_held.alias("context_holdout"), p.alias("p_literature"), sentences.alias("literature_sentence_count"), num("distinct_article_count").alias("literature_distinct_article_count"),
        num("supported_existing_edge_count").alias("supported_existing_edge_count"), num("overlay_confidence").alias("overlay_confidence"),
        *[log(ent(s, n)).alias(f"{side}_{label}_log") for n, label in (("graph_degree", "graph"), ("literature_mention_count", "mention"), ("literature_support_count", "support"), ("prediction_overlay_count", "overlay")) for s, side in (("_s", "subject"), ("_o", "object"))],
        log(both("graph_degree")).alias("graph_degree_sum_log"), "graph_degree_min_log", log(high("graph_degree")).alias("graph_degree_max_log"),
        F.when(high("graph_degree") > 0, low("graph_degree") / high("graph_degree")).otherwise(0.0).alias("graph_degree_balance"), log(both("canonical_edge_count")).alias("canonical_edge_sum_log"),
        (num("supported_existing_edge_count") > 0).cast("double").alias("direct_graph_support_indicator"), "entity_semantic_overlap", "metabolic_theme_overlap", "cell_context_overlap", "signature_entity_overlap",
        log(F.size("_sp")).alias("subject_pathway_log"), log(F.size("_op")).alias("object_pathway_log"), "shared_pathway_count", "shared_pathway_jaccard", "metabolite_target_pathway_bridge", "endpoint_overlay_any",
        "endpoint_support_min_log", prior.alias("source_independent_prior_score"), (log(sentences) * p).alias("literature_support_score"), log(num("distinct_article_count")).alias("independent_article_score"),
        log(num("supported_existing_edge_count")).alias("curated_edge_score"), num("overlay_confidence").alias("overlay_score"), *[num(n).alias(n) for n in ("relevance_mean", "relevance_max", "relevance_min", "relevance_scored_sentence_count", "relevance_evidence_fraction")],
        (log(sentences) * p * (0.5 + 0.5 * num("relevance_mean"))).alias("relevance_weighted_literature_score"), (num("relevance_scored_sentence_count") / F.greatest(F.lit(1.0), sentences)).alias("relevance_coverage"),
        num("ner_candidate_count").alias("ner_candidate_count"), log(num("ner_candidate_count")).alias("ner_candidate_log"), *[num(n).alias(n) for n in ("ner_unique_surface_count", "ner_label_count", "ner_candidate_sentence_fraction", "ner_candidate_density")],
        (log(num("ner_candidate_count")) * num("ner_candidate_sentence_fraction")).alias("ner_evidence_complexity_score"), F.coalesce("support_uid", "source_record_id", F.lit("")).alias("source_ref"),
    )


def _candidate_uid(prefix: str, *parts: Column) -> Column:
    """prefix_ + 24 hex digits of the SHA-256 of the parts joined by `|`, nulls as ''."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 24))


def literature_candidates(relations: DataFrame) -> DataFrame:
    """Candidates from relations of texts: subject_uid, object_uid, predicate, support_class and what they have of EVIDENCE. Rows without an end are left out."""
    r = _filled(relations, EVIDENCE).filter("subject_uid <> '' and object_uid <> ''")
    label = L.weak_label(F.col("support_class"), F.col("p_literature"), F.col("distinct_article_count"), F.col("evidence_sentence_count"), F.col("supported_existing_edge_count"))
    uid = _candidate_uid("lit", F.col("subject_uid"), F.col("predicate"), F.col("object_uid"), F.col("support_uid"))
    return r.select("*", uid.alias("candidate_uid"), F.lit("literature_relation").alias("source_kind"), label.alias("_l")).select("*", "_l.*").drop("_l", "support_class")


def graph_candidates(edges: DataFrame) -> DataFrame:
    """Candidates from known edges: edge_uid, subject_uid, subject_type, object_uid, object_type, edge_type, evidence_level.

    The label is a first one, by the level alone; :func:`settle_graph_labels` sets
    it by the prior of the feature row.
    """
    e = edges.filter("subject_uid <> '' and object_uid <> '' and edge_uid <> ''")
    curated = F.coalesce(F.lower("evidence_level").contains("curated"), F.lit(False))
    return _filled(
        e.select(
            "subject_uid", "subject_type", "object_uid", "object_type", F.col("edge_type").alias("predicate"), _candidate_uid("graph", F.col("edge_uid")).alias("candidate_uid"), F.lit("canonical_graph_edge").alias("source_kind"),
            F.when(curated, "medium_positive").otherwise("weak_positive").alias("weak_label"), F.when(curated, 0.70).otherwise(0.55).alias("label_score"), F.lit("canonical_graph_edge").alias("label_reason"),
            F.col("edge_uid").alias("source_record_id"), F.lit(1).cast("long").alias("supported_existing_edge_count"), curated.alias("_curated"),
        ), EVIDENCE,
    )


def settle_graph_labels(rows: DataFrame, curated: DataFrame) -> DataFrame:
    """Feature rows with the labels of known edges set by their prior. curated: candidate_uid of the curated edges."""
    marked = rows.join(curated.select("candidate_uid").distinct().withColumn("_c", F.lit(True)), "candidate_uid", "left")
    graph = F.col("source_kind") == "canonical_graph_edge"
    label = L.graph_edge_label(F.coalesce("_c", F.lit(False)), F.col("source_independent_prior_score"))
    out = marked.withColumn("_l", label).withColumn("label_score", F.when(graph, F.col("_l.label_score")).otherwise(F.col("label_score")))
    return out.withColumn("weak_label", F.when(graph, F.col("_l.weak_label")).otherwise(F.col("weak_label"))).select(*rows.columns)


def overlay_candidates(drugs: DataFrame) -> DataFrame:
    """Candidates from drugs and their targets: drug_id, target_uid, confidence, source_record_id."""
    d = drugs.filter("target_uid <> '' and drug_id <> ''").withColumn("_l", L.overlay_label(F.coalesce("confidence", F.lit(0.0))))
    return _filled(
        d.select(
            F.col("drug_id").alias("subject_uid"), F.lit("drug").alias("subject_type"), F.col("target_uid").alias("object_uid"), F.lit("target").alias("object_type"), F.lit("targets").alias("predicate"),
            _candidate_uid("drug", F.col("drug_id"), F.col("target_uid"), F.col("source_record_id")).alias("candidate_uid"), F.lit("drug_target_overlay").alias("source_kind"), "_l.*",
            F.col("confidence").alias("overlay_confidence"), "source_record_id",
        ), EVIDENCE,
    )


def negative_candidates(positives: DataFrame, pool: DataFrame, per_positive: int = 1) -> DataFrame:
    """Candidates that pair the subjects of positive ones with other entities of the object's type; they keep the split context of a positive.

    positives: candidates; pool: entity, type.
    """
    p = positives.filter(F.col("weak_label").isin(*L.POSITIVE_LABELS))
    drawn = L.hashed_negatives(p.select("subject_uid", "predicate", "object_uid", "object_type").toDF("subject", "predicate", "object", "object_type"), pool, per_positive)
    context = ("pmids", "publication_year", "min_publication_year", "max_publication_year", "study_id", "dataset_id")
    kept = p.groupBy("subject_uid", "predicate").agg(F.min(F.struct("candidate_uid", "subject_type", *context)).alias("_p"))
    out = drawn.toDF("subject_uid", "predicate", "object_uid", "object_type").join(kept, ["subject_uid", "predicate"]).select("subject_uid", "predicate", "object_uid", "object_type", "_p.subject_type", F.col("_p.candidate_uid").alias("_from"), *[f"_p.{c}" for c in context])
    uid = _candidate_uid("neg", F.col("subject_uid"), F.col("predicate"), F.col("object_uid"), F.col("_from"))
    marks = {"candidate_uid": uid, "source_kind": F.lit("shuffled_negative"), "weak_label": F.lit("negative_shuffled"), "label_score": F.lit(0.0), "label_reason": F.lit("same_type_random_mismatch")}
    return _filled(out.withColumns(marks).drop("_from"), EVIDENCE)


def union_candidates(*families: DataFrame) -> DataFrame:
    """The candidates of several families in one table."""
    columns = ("candidate_uid", "subject_uid", "subject_type", "object_uid", "object_type", "predicate", "source_kind", "weak_label", "label_score", "label_reason")
    out = None
    for f in families:
        part = _filled(f, EVIDENCE).select(*columns, *[F.col(c).cast(t).alias(c) for c, t in EVIDENCE.items()])
        out = part if out is None else out.unionByName(part)
    return out
