"""Choosing, sampling and summing up what people or models look at."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.keys import folded_key, hash_bucket
from lodegraph.functions.text import tokens
from lodegraph.operators.learning import bucket_split
from lodegraph.operators.ordering import dense_index, first_in_group, top_in_group
from lodegraph.operators.resolve import small

# Words that say too little to be a mention of their own.
GENERIC_SURFACES = (
    "acid", "activation", "activity", "analysis", "assay", "background", "binding", "body", "cancer", "cell", "cells", "control", "controls", "data",
    "disease", "effect", "effects", "expression", "factor", "family", "growth", "group", "human", "level", "levels", "line", "lines", "metabolism",
    "method", "model", "models", "pathway", "patient", "patients", "protein", "response", "results", "role", "sample", "samples", "study", "target",
    "therapy", "tissue", "tissues", "tumor", "tumors",
)
# Surfaces that don't name a disease though a list of diseases has them.
LOW_PRECISION_SURFACES = (
    "abnormal", "angiogenesis", "braf", "breast cancer cell", "c myc", "cafs", "cancer cell", "cancer immunotherapy", "cancer progression", "cancer risk",
    "cancer therapy", "cancer treatment", "carcinogenesis", "ccnd1", "central", "chemotherapy", "chemo", "chip", "cyclin d1", "decreasing", "erbb2",
    "expansion", "favorable", "gastric", "gli1", "grade", "her2", "high risk", "igf2bp2", "igf2bp3", "intestinal", "intratumoral", "invasion",
    "irradiation", "kras", "ldha", "lkb1", "many", "measured", "mixed", "moderate", "negative", "normal", "oncogene", "oncogenesis", "oncology", "ovary",
    "pcos", "pfkfb3", "positive", "poor", "primary", "radiation", "radiotherapy", "recurrent", "runx1", "screening", "site", "stage", "targeting", "tcga",
    "tet1", "the cancer genome atlas", "tumor cell", "tumor expansion", "tumor immunity", "tumor necrosis", "tumor microenvironment",
    "tumor necrosis factor", "tumor progression", "tumor regression", "tumor suppression", "tumor suppressor", "tumor tissue", "tumorigenesis",
    "with tumor", "ythdf2", "brca1", "tp53", "cell cycle arrest", "cancer metastasis", "tumor metastasis", "metastases", "cancer related", "early stage",
    "interact", "deep",
)
# Fixed pattern: labels that name a process, a procedure or a molecule where a disease is meant.
LOW_PRECISION_LABEL = (
    r"\b(agent|therapeutic procedure|therapy agent|chemotherapy|radiation therapy|radiotherapy|immunotherapy|screening|measurement|assay|test|criteria|risk group|gene mutation|wt allele|allele"
    r"|oncogene|gene|protein|receptor|ligand|factor|kinase|antigen|enzyme|pathway|process|route of administration|microenvironment|immunity|angiogenesis|invasion|carcinogenesis"
    r"|tumou?rigenesis|progression|regression|suppression|regulation|fibroblast|question|consortium|atlas)\b"
)
# Gene symbols that are also words.
BLOCKED_SYMBOLS = (
    "ACE", "ALL", "AND", "ARE", "AS", "AT", "CAT", "COX", "DNA", "FOR", "GAP", "HAD", "HAS", "IN", "INH", "ITS", "MAP", "MET", "NO", "NOT", "OR", "PR",
    "RAN", "SET", "WAS",
)


def surface_text(surface: Column) -> Column:
    """A surface in comparable form: folded, with hyphens, slashes and underscores as blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(folded_key(surface), "[\u2010-\u2015_/-]+", " "), " +", " "))


def surface_verdict(surface: Column, kind: Column, label: Column | None = None, field: Column | None = None, longest: int = 96, most_tokens: int = 10) -> Column:
    """keep, or why a surface isn't matched.

    empty, too_long, many_tokens, no_letters, generic, short (fewer than 4 signs
    in one token, 3 for genes and targets), blocked_symbol, low_precision (of a
    disease, by its surface or its label).  A null surface is empty.
    """
    flat = surface_text(surface)
    toks = tokens(flat)
    n, key = F.size(toks), F.array_join(toks, " ")
    gene = kind.isin("gene", "target")
    one = lambda least: (n == 1) & (F.length(F.element_at(toks, 1)) < least)
    low = key.isin(*LOW_PRECISION_SURFACES)
    if label is not None:
        low = low | surface_text(label).rlike(LOW_PRECISION_LABEL)
    if field is not None:
        low = low | ((field == "alias") & key.isin(*GENERIC_SURFACES))
    return (
        F.when(surface.isNull() | (flat == "") | (n <= 0), "empty")
        .when(F.length(flat) > longest, "too_long")
        .when(n > most_tokens, "many_tokens")
        .when(~key.rlike("[a-z]"), "no_letters")
        .when(flat.isin(*GENERIC_SURFACES), "generic")
        .when(~gene & one(4), "short")
        .when(gene & F.upper(F.trim(surface)).isin(*BLOCKED_SYMBOLS), "blocked_symbol")
        .when(gene & one(3), "short")
        .when((kind == "disease") & F.coalesce(low, F.lit(False)), "low_precision")
        .otherwise("keep")
    )


def limited_to(rows: DataFrame, uid: str, edges: DataFrame, ends: Sequence[str]) -> DataFrame:
    """The rows whose uid is an end of an edge."""
    used = None
    for e in ends:
        part = edges.select(F.col(e).alias(uid))
        used = part if used is None else used.union(part)
    return rows.join(used.distinct(), uid, "left_semi")


def known_pairs(asked: DataFrame, known: DataFrame, pair: Sequence[str]) -> DataFrame:
    """asked with is_known: whether the exact pair is there; both columns are narrowed before the join."""
    k = known.select(*pair).distinct().withColumn("is_known", F.lit(True))
    return asked.join(k, list(pair), "left").withColumn("is_known", F.coalesce("is_known", F.lit(False)))


def merge_overlay(base: DataFrame, overlay: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of both, one for each key: the base's before the overlay's, then the smallest in the order."""
    both = base.withColumn("_side", F.lit(0)).unionByName(overlay.withColumn("_side", F.lit(1)))
    return first_in_group(both, list(keys), ["_side", *order]).drop("_side")


def signal_rollup(signals: DataFrame, code: str, case: str, tags: str, severity: str) -> DataFrame:
    """code, tag, n_signals, n_cases, worst: signals with a list of tags, each tag counted."""
    each = signals.select(code, case, severity, F.explode_outer(tags).alias("tag")).distinct()
    return each.groupBy(code, "tag").agg(F.count("*").alias("n_signals"), F.count_distinct(case).alias("n_cases"), F.max(severity).alias("worst"))


def name_statistics(index: DataFrame, name: str, uid: str, rank: str, field: str, examples: int = 5) -> DataFrame:
    """name, n_rows, n_uids, best_rank, worst_rank, fields (sorted), examples (the smallest uids)."""
    base = index.groupBy(name).agg(
        F.count("*").alias("n_rows"), F.count_distinct(uid).alias("n_uids"), F.max(rank).alias("best_rank"), F.min(rank).alias("worst_rank"), F.array_sort(F.collect_set(field)).alias("fields")
    )
    few = top_in_group(index.select(name, uid).distinct(), [name], [F.asc(uid)], examples).groupBy(name).agg(F.array_sort(F.collect_list(uid)).alias("examples"))
    return base.join(few, name)


def hash_sample(df: DataFrame, stratum: str, key: str, n: int) -> DataFrame:
    """n rows of each stratum in the order of a hash bucket of the key, then the key: the same rows in every run."""
    b = df.withColumn("_b", hash_bucket(F.col(key).cast("string"), 12, 100))
    return top_in_group(b, [stratum], [F.asc("_b"), F.asc(key)], n).drop("_b")


def rank_fractions(df: DataFrame, key: str, score: str) -> DataFrame:
    """key, rank (from 1, best score first, ties by key), fraction (1 for the best, 0 for the last)."""
    ordered = dense_index(df.select(key, score), [F.desc(score), F.asc(key)], "_at")
    n = ordered.count()
    return ordered.select(key, (F.col("_at") + 1).alias("rank"), (1 - F.col("_at") / F.lit(max(n - 1, 1))).alias("fraction"))


def holdout_specs(labels: DataFrame, kind: str, source: str, least: int = 2, parts: int = 3) -> DataFrame:
    """spec, source_kind, source, part, n: what is held out in turn.

    Every source of a kind with several sources; a kind of one source is cut
    into hash parts, since holding it out whole would leave nothing of its kind.
    """
    n = labels.filter(F.col(source).isNotNull()).groupBy(kind, source).agg(F.count("*").alias("n"))
    per = n.groupBy(kind).agg(F.count("*").alias("_sources"))
    j = n.join(small(per), kind)
    whole = j.filter(F.col("_sources") >= least).select(F.col(kind).alias("source_kind"), F.col(source).alias("source"), F.lit(None).cast("int").alias("part"), "n")
    cut = j.filter(F.col("_sources") < least).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(F.col(kind).alias("source_kind"), F.col(source).alias("source"), F.col("part").cast("int").alias("part"), "n")
    out = whole.unionByName(cut)
    return out.withColumn("spec", F.concat_ws(":", "source_kind", "source", F.col("part").cast("string")))


def ratio_components(df: DataFrame, key: str, name: str, effect: str) -> DataFrame:
    """key, position, component, effect: the two sides of ratios `a / b`; the denominator's effect is turned round."""
    sides = F.split(F.regexp_replace(F.lower(F.trim(name)), r"\s+ratio$", ""), r"\s*/\s*")
    two = df.withColumn("_s", sides).filter(F.size("_s") == 2)
    return two.select(key, F.posexplode("_s").alias("position", "component"), F.col(effect).alias("_e")).select(
        key, "position", "component", F.when(F.col("position") == 0, F.col("_e")).otherwise(-F.col("_e")).alias("effect")
    )


def forbidden_text(texts: DataFrame, key: str, text: str, phrases: Sequence[str]) -> DataFrame:
    """key, phrase: forbidden phrases in texts, case ignored, whole words."""
    low = F.lower(text)
    found = F.array_compact(F.array(*[F.when(low.rlike(rf"(^|[^a-z0-9]){p.lower()}($|[^a-z0-9])"), F.lit(p)) for p in phrases]))
    return texts.select(key, F.explode(found).alias("phrase"))


def prediction_rows(rows: DataFrame, label: Column, features: dict[str, Column], group: Column) -> DataFrame:
    """Training rows: prediction_id, label (0 negative, 1 unsure, 2 positive), the features with nulls as 0, and the group's split."""
    split = bucket_split(group, 8)
    return rows.select("prediction_id", label.alias("label"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in features.items()], split.alias("split"))
