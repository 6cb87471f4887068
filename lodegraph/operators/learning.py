"""Weak labels, splits, features and scores of candidate relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions.keys import hash_bucket
from lodegraph.operators.ordering import dense_index
from lodegraph.operators.resolve import small

# Classes of support by what they say about a relation.
POSITIVE_CLASSES = ("confirm", "support_direction", "support", "supported_existing_edge")
WEAK_CLASSES = ("novel_candidate", "candidate", "uncertain")
NEGATIVE_CLASSES = ("conflict", "refute", "refuted", "opposite_direction")
CONTEXT_MISMATCH_CLASSES = ("context_mismatch", "wrong_context", "out_of_context")
# The most that a model may give a candidate with a weak label; other labels get OTHER_CAP.
LABEL_CAPS = {"strong_positive": 1.0, "medium_positive": 0.82, "weak_positive": 0.62, "abstain": 0.25, "negative_shuffled": 0.05, "negative_refute": 0.05}
OTHER_CAP = 0.25
POSITIVE_LABELS = ("strong_positive", "medium_positive", "weak_positive")


def choose(c: Column, values: dict, other: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c), other)


def weak_label(support_class: Column, p: Column, articles: Column, sentences: Column, known_edges: Column) -> Column:
    """Struct (weak_label, label_score, label_reason) of a relation from texts; nulls count as nothing.

    A refuted relation is negative whatever its probability; only classes that
    confirm make a strong or medium positive.
    """
    kind, prob = F.lower(F.coalesce(support_class, F.lit(""))), F.coalesce(p, F.lit(0.0))
    n, m, edges = (F.coalesce(c, F.lit(0)) for c in (articles, sentences, known_edges))
    made = lambda label, score, reason: F.struct(F.lit(label).alias("weak_label"), F.lit(score).alias("label_score"), F.lit(reason).alias("label_reason"))
    positive = kind.isin(*POSITIVE_CLASSES)
    return (
        F.when(kind.isin(*NEGATIVE_CLASSES), made("negative_refute", 0.0, "literature_refute"))
        .when(positive & (prob >= 0.85) & (n >= 2) & (edges > 0), made("strong_positive", 1.0, "curated_and_literature"))
        .when(positive & (prob >= 0.70) & (m >= 2), made("medium_positive", 0.78, "literature_support"))
        .when(kind.isin(*WEAK_CLASSES) & (prob >= 0.75) & (n >= 2), made("weak_positive", 0.58, "novel_literature_candidate"))
        .when((prob >= 0.90) & (n >= 3), made("weak_positive", 0.55, "high_literature_probability"))
        .otherwise(made("abstain", 0.0, "insufficient_or_context_only"))
    )


def graph_edge_label(curated: Column, prior: Column) -> Column:
    """Struct (weak_label, label_score, label_reason) of a known edge from its source-independent prior."""
    score = F.round(F.least(F.lit(0.86), F.greatest(F.lit(0.50), 0.50 + 0.36 * prior + F.when(curated, 0.06).otherwise(0.0))), 6)
    label = F.when(score >= 0.65, "medium_positive").otherwise("weak_positive")
    return F.struct(label.alias("weak_label"), score.alias("label_score"), F.lit("canonical_graph_edge").alias("label_reason"))


def overlay_label(confidence: Column) -> Column:
    """Struct (weak_label, label_score, label_reason) of a drug and its target by the confidence of the source."""
    made = lambda label, score, reason: F.struct(F.lit(label).alias("weak_label"), F.lit(score).alias("label_score"), F.lit(reason).alias("label_reason"))
    return (
        F.when(confidence >= 0.75, made("medium_positive", 0.72, "curated_drug_target_overlay"))
        .when(confidence >= 0.45, made("weak_positive", 0.52, "drug_target_overlay"))
        .otherwise(made("abstain", 0.0, "low_confidence_overlay"))
    )


def five_class(label: Column, reason: Column) -> Column:
    """context_mismatch, contradicted, supported, unrelated or insufficient_evidence."""
    low, why = F.lower(F.coalesce(label, F.lit(""))), F.lower(F.coalesce(reason, F.lit("")))
    return (
        F.when(low.isin(*CONTEXT_MISMATCH_CLASSES) | why.contains("context_mismatch"), "context_mismatch")
        .when(low.isin(*NEGATIVE_CLASSES) | low.startswith("negative") | why.contains("refute"), "contradicted")
        .when(low.isin(*POSITIVE_LABELS), "supported")
        .otherwise("insufficient_evidence")
    )


def bucket_split(group: Column, digits: int = 12) -> Column:
    """test, validation, train by the hash of a group (15, 15 and 70 of 100)."""
    b = hash_bucket(group, digits, 100)
    return F.when(b < 15, "test").when(b < 30, "validation").otherwise("train")


def split_of(group: Column, year: Column | None = None, context: Column | None = None, from_year: int = 2024) -> Column:
    """The split of a group, with hold-outs by year (first) and by context; a group without a name is `ungrouped`."""
    out = bucket_split(F.coalesce(F.nullif(group, F.lit("")), F.lit("ungrouped")))
    if context is not None:
        out = F.when((context != "") & (hash_bucket(context, 12, 20) == 0), "context_holdout").otherwise(out)
    if year is not None:
        out = F.when(year >= from_year, "temporal_holdout").otherwise(out)
    return out


def hashed_negatives(positives: DataFrame, pool: DataFrame, per_positive: int = 2) -> DataFrame:
    """subject, predicate, object, object_type: for each positive so many objects of its type that aren't its true ones.

    The pool's entities of a type are indexed densely; a hash of the positive and
    the draw's number picks an index, and a true object is replaced by the next
    index that isn't one, from the last to the first.  Only a subject whose true
    objects are the whole type gets none.
    """
    indexed = dense_index(pool.select("entity", "type").distinct(), ["type", "entity"], "at")
    sizes = small(indexed.groupBy("type").agg(F.min("at").alias("first"), F.count("*").alias("size")))
    asks = positives.select("subject", "predicate", "object", F.col("object_type").alias("type")).distinct().join(sizes, "type")
    draws = asks.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(per_positive - 1))))
    pick = hash_bucket(F.concat_ws("|", "subject", "predicate", "object", F.col("draw").cast("string")), 12, 10**9)
    draws = draws.withColumn("at", F.col("first") + F.pmod(pick, F.col("size")))
    # each true object with the end of its run of neighbouring true ones, and the end of the run at the type's first index
    true = positives.select("subject", "predicate", F.col("object").alias("entity")).distinct().join(indexed, "entity").join(sizes, "type")
    group = Window.partitionBy("subject", "predicate", "type")
    true = true.withColumn("run", F.col("at") - F.row_number().over(group.orderBy("at")))
    true = true.withColumn("last", F.max("at").over(Window.partitionBy("subject", "predicate", "type", "run")))
    true = true.withColumn("head", F.max(F.when(F.col("at") == F.col("first"), F.col("last"))).over(group))
    found = draws.join(true.select("subject", "predicate", "type", "at", "last", "head"), ["subject", "predicate", "type", "at"], "left")
    end, after = F.col("first") + F.col("size"), F.col("last") + 1
    free = F.when(F.col("last").isNull(), F.col("at")).when(after < end, after).otherwise(F.coalesce(F.col("head") + 1, F.col("first")))
    chosen = found.withColumn("at", free).filter(F.col("at") < end).join(indexed.select("at", "entity"), "at")
    return chosen.select("subject", "predicate", F.col("entity").alias("object"), F.col("type").alias("object_type")).distinct()


def jaccard(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(0.0)


def prior(support_log: Column, degree_log: Column, overlap: Column, pathway: Column, bridge: Column, overlay: Column, theme: Column) -> Column:
    """A source-independent prior of a pair, at most 1."""
    one = lambda x: F.least(F.lit(1.0), x)
    return one(0.18 * one(support_log / 5) + 0.16 * one(degree_log / 5) + 0.16 * one(2.5 * overlap) + 0.18 * one(5 * pathway) + 0.12 * bridge + 0.10 * overlay + 0.10 * theme)


def sample_weights(df: DataFrame, group: Sequence[str], strong: Column) -> DataFrame:
    """df with weight = (1 + .5 strong) x clip(sqrt(N / groups / size of the group), .35, 6)."""
    sizes = df.groupBy(*group).agg(F.count("*").alias("_size"))
    totals = sizes.agg(F.sum("_size"), F.count("*")).head()
    mean = (totals[0] or 0) / (totals[1] or 1)
    out = df.join(small(sizes), list(group))
    balance = F.greatest(F.lit(0.35), F.least(F.lit(6.0), F.sqrt(F.lit(float(mean)) / F.col("_size"))))
    return out.withColumn("weight", (1 + 0.5 * strong.cast("double")) * balance).drop("_size")


def capped(score: Column, label: Column) -> Column:
    """The score, at most the cap of the label; labels without a cap are negative ones."""
    return F.least(score, choose(label, LABEL_CAPS, F.lit(OTHER_CAP)))


def debias(df: DataFrame, raw: str, positives: str, candidates: str, support: str, degree: str, mentions: str, generic: Column, hub: Column) -> DataFrame:
    """df with debiased: raw x density x support, less for popular, generic and hub entities."""
    top = df.agg(F.max(F.col(positives) / F.sqrt(F.greatest(F.col(candidates), F.lit(1)))).alias("d"), F.max(support).alias("s")).head()
    over = lambda c, m: c / F.lit(float(m)) if m else F.lit(0.0)
    density = over(F.col(positives) / F.sqrt(F.greatest(F.col(candidates), F.lit(1))), top["d"])
    popularity = 1 + 0.10 * F.log1p(F.col(candidates)) + 0.04 * F.log1p(F.col(degree)) + 0.05 * F.log1p(F.col(mentions))
    factor = F.when(generic, 0.65).otherwise(1.0) * F.when(hub, 0.72 * 0.82).otherwise(1.0)
    return df.withColumn("debiased", F.col(raw) * (0.55 + 0.45 * density) * (0.85 + 0.15 * over(F.col(support), top["s"])) * factor / popularity)


def contextual(rank: Column, coverage: Column, overlap: Column, evidence: Column, learned: Column, p_value: Column, context: Column) -> Column:
    """A re-ranking score of a pathway from its rank, overlap, evidence, model score, p-value and fit to the context."""
    by_rank = 1 / F.log2(rank + 2)
    shared = F.least(F.lit(1.0), coverage + 0.08 * overlap)
    by_p = F.least(F.lit(1.0), -F.log10(F.greatest(p_value, F.lit(1e-300))) / 8)
    return 0.30 * by_rank + 0.18 * shared + 0.16 * evidence + 0.16 * learned + 0.10 * by_p + 0.10 * context


def evidence_strength(p: Column, pmids: Column) -> Column:
    return F.least(F.lit(1.0), p * (0.65 + 0.08 * F.log1p(pmids)))


def evidence_tier(score: Column, evidence: Column, learned: Column) -> Column:
    return (
        F.when((score >= 0.75) & (evidence >= 0.65), "strong")
        .when((score >= 0.45) & ((evidence >= 0.35) | (learned >= 0.5)), "medium")
        .otherwise("exploratory")
    )


def entity_rollup(df: DataFrame, entity: str, score: str, partner: str) -> DataFrame:
    """entity, best, mean, n, n_high, best_partner (the partner of the best score; ties to the smaller one)."""
    return df.groupBy(entity).agg(
        F.max(score).alias("best"), F.avg(score).alias("mean"), F.count("*").alias("n"), F.count_if(F.col(score) >= 0.5).alias("n_high"),
        F.min(F.struct(-F.col(score), F.col(partner)))[partner].alias("best_partner"),
    )


def signal_score(degree: Column, mentions: Column, support: Column, overlay: Column) -> Column:
    return F.log1p(degree) + 2 * F.log1p(mentions) + 3 * F.log1p(support) + 2 * F.log1p(overlay)


def top_terms(df: DataFrame, entity: str, term: str, k: int = 24) -> DataFrame:
    """entity, document: its k most frequent terms, each int(ln(1 + n)) + 1 times, at most 3; ties by term."""
    counts = df.filter(F.col(term).isNotNull()).groupBy(entity, term).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy(entity).orderBy(F.desc("n"), F.asc(term)))).filter(F.col("r") <= k)
    times = F.greatest(F.lit(1), F.least(F.lit(3), F.floor(F.log1p("n")).cast("int") + 1))
    text = ranked.withColumn("t", F.array_join(F.array_repeat(F.col(term), times), " "))
    lists = text.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct("r", "t"))).alias("x"))
    return lists.select(entity, F.array_join(F.transform("x", lambda s: s["t"]), " ").alias("document"))
