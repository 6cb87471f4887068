"""What a name or trait denotes, and what may be decided about its identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns: kinds of measured traits, tried in this order.
TRAIT_KINDS = (
    ("ratio", r"\bratio\b|[a-z0-9)] ?/ ?[a-z(]|\bto\b.*\bratio\b"),
    ("sum", r"^(total|sum of|free)\b|\(sum\)"),
    ("lipid_species", r"\b[a-z]{2,}[ (-]c?[0-9]{1,2}:[0-9]{1,2}\)?|^[a-z]+ ?\(?[0-9]{1,2}:[0-9]"),
    ("class", r"\b(species|pool|class|lipids?|acids|derivatives|extract)\b"),
)
def trait_kind(name: Column) -> Column:
    """ratio, sum, lipid_species, class or compound."""
    low = F.lower(F.trim(name))
    out = None
    for kind, pattern in TRAIT_KINDS:
        out = F.when(low.rlike(pattern), kind) if out is None else out.when(low.rlike(pattern), kind)
    return out.otherwise("compound")


def granularity(kind: Column) -> Column:
    return F.when(kind == "compound", "molecule").when(kind == "lipid_species", "species").when(kind.isin("sum", "class"), "class").otherwise("composite")


def decide(feature: Column, trait: Column, class_: Column, chemical: Column) -> Column:
    """Struct (decision, entity_uid, entity_kind, reason, confidence, review) of a feature by the entities that are registered for it.

    feature: ratio, lipid_class, trait_score or anything else; trait, class_ and
    chemical: the uid of the registered entity of each kind, null or '' for none.
    Only a chemical is exact; a ratio, class or score without its entity is
    ambiguous, anything else without a chemical unmatched.
    """

    def made(decision: str, uid: Column, kind: str, reason: str, confidence: float, review: str = "needs_review") -> Column:
        return F.struct(
            F.lit(decision).alias("decision"), uid.alias("entity_uid"), F.lit(kind).alias("entity_kind"), F.lit(reason).alias("reason"), F.lit(confidence).alias("confidence"), F.lit(review).alias("review")
        )

    none = F.lit("")
    has = lambda c: F.coalesce(c != "", F.lit(False))
    return (
        F.when((feature == "ratio") & has(trait), made("accepted_trait", trait, "trait", "ratio_not_exact_abundance", 0.8))
        .when(feature == "ratio", made("ambiguous", none, "", "ratio_not_exact_abundance;missing_trait_entity", 0.0))
        .when((feature == "lipid_class") & has(class_), made("accepted_class", class_, "class", "class_name_not_exact_identity", 0.65))
        .when(feature == "lipid_class", made("ambiguous", none, "", "class_name_not_exact_identity", 0.0))
        .when((feature == "trait_score") & has(trait), made("accepted_trait", trait, "trait", "trait_score_not_direct_abundance", 0.7))
        .when(feature == "trait_score", made("ambiguous", none, "", "trait_score_without_registered_trait", 0.0))
        .when(has(chemical), made("accepted_exact", chemical, "chemical", "stable_source_entity", 0.9, "auto"))
        .otherwise(made("unmatched", none, "", "no_candidate_entity", 0.0))
    )


def name_variants(name: Column) -> Column:
    """The name with its acid or anion, without stereo marks, and its lipid chain in both notations; sorted, without repeats."""
    low = F.lower(F.trim(name))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(
        low,
        F.when(low.rlike("ic acid$"), F.regexp_replace(low, "ic acid$", "ate")),
        F.when(low.rlike("ate$"), F.regexp_replace(low, "ate$", "ic acid")),
        F.when(low.rlike("^(d|l|alpha|beta)-"), F.regexp_replace(low, "^(d|l|alpha|beta)-", "")),
        F.when(low.rlike(" [0-9]{1,2}:[0-9]{1,2}$"), F.regexp_replace(low, " ([0-9]{1,2}:[0-9]{1,2})$", "($1)")),
    ))))


def review_bucket(kind: Column, n_candidates: Column, risk: Column) -> Column:
    """Which review list an unresolved name goes to."""
    return (
        F.when(kind == "ratio", "ratio_components").when(kind.isin("sum", "class"), "class_or_pool").when(n_candidates > 1, "ambiguous_candidates").when(risk >= 35, "risky_name")
        .when(n_candidates == 1, "single_unconfirmed").otherwise("no_candidate")
    )


def group_decisions(rows: DataFrame, group: str, uid: str, vote: str) -> DataFrame:
    """group, uid, share, agreed: the uid that most rows of a group name (ties to the smaller uid), agreed from two thirds on."""
    n = rows.filter(F.col(uid).isNotNull()).groupBy(group, uid).agg(F.sum(vote).alias("n"))
    total = n.groupBy(group).agg(F.sum("n").alias("t"), F.min(F.struct((-F.col("n")).alias("m"), uid)).alias("w"))
    return total.select(group, F.col(f"w.{uid}").alias(uid), (-F.col("w.m") / F.col("t")).alias("share"), (-F.col("w.m") * 3 >= F.col("t") * 2).alias("agreed"))
