"""Overlays of drugs, targets and cell types on a graph's entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.ordering import first_in_group, top_in_group
from lodegraph.operators.resolve import small


def any_key_join(left: DataFrame, left_key: str, keys: Sequence[tuple[str, str]], right: DataFrame, right_key: str) -> DataFrame:
    """left_key, right_key, via: pairs that agree in any of several keys.

    A union of equi-joins, never a join on a disjunction; a pair is kept once,
    with the first of the keys it agrees in.
    """
    out = None
    for i, (a, b) in enumerate(keys):
        l_ = left.filter(F.col(a).isNotNull()).select(left_key, F.col(a).alias("_k"))
        r_ = right.filter(F.col(b).isNotNull()).select(right_key, F.col(b).alias("_k"))
        part = l_.join(r_, "_k").select(left_key, right_key, F.lit(i).alias("_i"), F.lit(a).alias("via"))
        out = part if out is None else out.unionByName(part)
    return first_in_group(out, [left_key, right_key], ["_i", "via"]).drop("_i")


def symbol_targets(genes: DataFrame, symbol: str, uid: str) -> DataFrame:
    """symbol (upper case), uid: one target for each symbol, the smallest uid."""
    s = F.upper(F.trim(symbol))
    return genes.select(s.alias("symbol"), F.col(uid).alias("uid")).filter("symbol <> '' and uid is not null").groupBy("symbol").agg(F.min("uid").alias("uid"))


def attach_targets(values: DataFrame, symbol: str, targets: DataFrame) -> DataFrame:
    return values.join(small(targets), F.upper(F.trim(F.col(symbol))) == F.col("symbol"), "left").select(*values.columns, "uid")


def wide_to_long(df: DataFrame, key: str, columns: Sequence[str], name: str, value: str) -> DataFrame:
    """A wide matrix as rows (key, name, value) without the empty cells."""
    return df.select(key, *columns).unpivot([key], list(columns), name, value).filter(F.col(value).isNotNull())


def top_dependencies(long: DataFrame, model: str, gene: str, effect: str, at_most: float = -0.5, n: int = 50) -> DataFrame:
    """model, gene, effect, rank, confidence of the n strongest dependencies (effect <= at_most) of each model."""
    kept = top_in_group(long.filter(F.col(effect) <= at_most), [model], [F.asc(effect), F.asc(gene)], n, "rank")
    counted = kept.groupBy(model).agg(F.count("*").alias("_n"))
    c = 0.55 + 0.18 * F.least(F.abs(F.col(effect)), F.lit(1.5)) + 0.002 * F.least(F.col("_n"), F.lit(50))
    return kept.join(small(counted), model).select(model, gene, effect, "rank", clamp(c).alias("confidence"))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def source_confidence(kind: Column, mechanism: Column, action: Column, activity: Column, phase: Column, reports: Column) -> Column:
    """Confidence of a drug's target by the kind of its source; activity is on a scale to 10, phases go to 4."""
    by_phase = F.when(phase >= 4, 0.95).when(phase >= 3, 0.86).when(phase >= 2, 0.74).when(phase >= 1, 0.62).otherwise(0.50)
    yes = lambda c: c.cast("double")
    return clamp(
        F.when(kind == "curated", 0.35 + 0.25 * yes(mechanism) + 0.15 * yes(action) + 0.20 * (activity / 10))
        .when(kind == "clinical", by_phase + F.least(F.lit(0.05), 0.01 * reports))
        .when(kind == "mechanism", 0.55 + 0.10 * yes(action) + 0.10 * yes(mechanism) + 0.15 * (phase / 4))
        .when(kind == "interaction", 0.42 + 0.25 * yes(mechanism) + 0.15 * (F.least(reports, F.lit(10)) / 10) + 0.08 * (phase >= 4).cast("double"))
        .otherwise(0.65 * (activity / 10))
    )


def marker_signatures(markers: DataFrame, cell: str, gene: str, score: str, licence: str) -> DataFrame:
    """cell, symbols (sorted), n_symbols, confidence (the best), licence (the first in order) of each cell type."""
    return markers.groupBy(cell).agg(
        F.array_sort(F.collect_set(gene)).alias("symbols"), F.count_distinct(gene).alias("n_symbols"), F.max(score).alias("confidence"), F.min(licence).alias("licence")
    )


def best_markers(markers: DataFrame, cell: str, gene: str, score: str, tissue: str) -> DataFrame:
    """cell, gene, score (the best), tissues (sorted) of each marker."""
    return markers.groupBy(cell, gene).agg(F.max(score).alias("score"), F.array_sort(F.collect_set(tissue)).alias("tissues"))


def context_match(text: Column, terms: Sequence[str]) -> Column:
    """The share of context terms that a text has (case ignored); 0 without terms."""
    if not terms:
        return F.lit(0.0)
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((low.contains(t.lower()).cast("int") for t in terms), F.lit(0)) / len(terms)


def exclude_terms(df: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Rows of which no string column has one of the terms, case ignored, literally."""
    texts = [c for c, t in df.dtypes if t == "string"]
    hit = F.lit(False)
    for c in texts:
        for t in terms:
            hit = hit | F.coalesce(F.lower(c).contains(t.lower()), F.lit(False))
    return df.filter(~hit)


def appendix_policy(df: DataFrame, text: str, score: str, terms: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """df with in_appendix and policy_score: rows of the terms and not of the allowed ones go to the appendix, at most 0.25."""
    low = F.lower(F.coalesce(text, F.lit("")))
    any_of = lambda ts: F.lit(False) if not ts else low.rlike("|".join(ts))
    out = df.withColumn("in_appendix", any_of([t.lower() for t in terms]) & ~any_of([t.lower() for t in allowed]))
    return out.withColumn("policy_score", F.when(F.col("in_appendix"), F.least(F.lit(0.25), F.col(score))).otherwise(F.col(score)))


def merge_learned(service: DataFrame, learned: DataFrame, key: str, cap: float = 0.34) -> DataFrame:
    """key, score, origin: service rows with the learned score mixed in; learned rows alone are scored lower, at most the cap."""
    s, m = service.select(key, F.col("score").alias("_s")), learned.select(key, F.col("score").alias("_m"))
    both = s.join(m, key, "full")
    score = F.when(F.col("_s").isNull(), F.least(F.lit(cap), 0.5 * F.col("_m"))).otherwise(0.8 * F.col("_s") + 0.2 * F.coalesce("_m", F.lit(0.0)))
    origin = F.when(F.col("_s").isNull(), "learned").when(F.col("_m").isNull(), "service").otherwise("both")
    return both.select(key, score.alias("score"), origin.alias("origin"))
