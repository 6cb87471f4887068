"""From texts to mentions, relations and supported edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import text as X
from lodegraph.operators.curation import surface_text, surface_verdict
from lodegraph.operators.ordering import top_in_group
from lodegraph.operators.resolve import small

# Confidence of a lexicon surface by entity type and field, and what the field adds to its priority.
FIELD_CONFIDENCE = {
    ("target", "approved_symbol"): 0.94, ("target", "preferred_name"): 0.86, ("metabolite", "canonical_name"): 0.93, ("metabolite", "synonym"): 0.82,
    ("gene", "symbol"): 0.94, ("gene", "alias"): 0.80, ("pathway", "name"): 0.90, ("disease", "name"): 0.91, ("disease", "alias"): 0.80,
}
FIELD_BONUS = {"canonical_name": 0.08, "symbol": 0.08, "approved_symbol": 0.08, "name": 0.05, "preferred_name": 0.04, "synonym": 0.0, "alias": 0.0}


def split_sentences(documents: DataFrame, key: str, text: str, least: int = 8) -> DataFrame:
    """key, sentence_no (from 0), sentence, n_tokens; null texts give no row."""
    s = documents.select(key, F.posexplode(X.sentences(F.col(text), least)).alias("sentence_no", "sentence"))
    return s.withColumn("n_tokens", F.size(X.tokens(F.col("sentence"))))


def build_lexicon(surfaces: DataFrame, margin: float = 0.12) -> DataFrame:
    """surface_key, entity_uid, entity_type, confidence, priority, n_tokens of the surfaces with one clear entity for each type.

    surfaces: surface, entity_uid, entity_type, field, confidence.  Surfaces that
    :func:`surface_verdict` doesn't keep are left out; one with several entities of
    a type is dropped when the best of its rows leads the next one by less than the
    margin.  Ties go by uid, then field; repeated rows count once.
    """
    bonus = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in FIELD_BONUS.items() for x in kv]), F.col("field")), F.lit(0.0))
    t = surfaces.select("surface", "entity_uid", "entity_type", "field", "confidence").distinct()
    t = t.filter(surface_verdict(F.col("surface"), F.col("entity_type"), None, F.col("field")) == "keep")
    t = t.withColumn("toks", X.tokens(surface_text(F.col("surface")))).withColumn("n_tokens", F.size("toks")).withColumn("surface_key", F.array_join("toks", " "))
    t = t.withColumn("priority", F.least(F.lit(1.0), F.col("confidence") + bonus + F.least(F.lit(0.06), 0.015 * F.col("n_tokens"))))
    keys = ["entity_type", "surface_key"]
    uids = t.groupBy(*keys).agg(F.count_distinct("entity_uid").alias("n_uids"))
    best = top_in_group(t, keys, [F.desc("priority"), F.asc("entity_uid"), F.asc("field")], 2, "_r")
    first = F.min(F.when(F.col("_r") == 1, F.struct("entity_uid", "confidence", "priority", "n_tokens"))).alias("w")
    two = best.groupBy(*keys).agg(first, F.max(F.when(F.col("_r") == 2, F.col("priority"))).alias("second"))
    out = two.join(uids, keys).filter((F.col("n_uids") == 1) | (F.col("w.priority") - F.coalesce("second", F.lit(-1.0)) >= margin))
    return out.select("surface_key", "w.entity_uid", "entity_type", "w.confidence", "w.priority", "w.n_tokens")


def match_phrases(sentences: DataFrame, keys: Sequence[str], sentence: str, lexicon: DataFrame, most_tokens: int = 10) -> DataFrame:
    """keys, entity_uid, entity_type, confidence, token_from, token_to, surface_key: every phrase of the lexicon in a sentence.

    N-grams up to the lexicon's longest phrase are looked up by equality.
    """
    longest = lexicon.agg(F.max("n_tokens")).head()[0] or 0
    n = min(most_tokens, longest)
    t = sentences.select(*keys, X.tokens(F.col(sentence)).alias("toks")).filter(F.size("toks") > 0)
    if not n:
        grams = t.select(*keys, F.lit(0).alias("token_from"), F.lit(0).alias("token_to"), F.lit("").alias("surface_key")).limit(0)
    else:
        # the grams are made inside the row: only a gram and its place are copied for each
        grams_of = lambda i: F.transform(
            F.sequence(F.lit(1), F.least(F.lit(n), F.size("toks") - i)),
            lambda w: F.struct(i.alias("token_from"), (i + w).alias("token_to"), F.array_join(F.slice("toks", i + 1, w), " ").alias("surface_key")),
        )
        grams = t.select(*keys, F.inline(F.flatten(F.transform(F.sequence(F.lit(0), F.size("toks") - 1), grams_of))))
    return grams.join(small(lexicon.select("surface_key", "entity_uid", "entity_type", "confidence")), "surface_key")


def longest_matches(found: DataFrame, keys: Sequence[str], most: int = 14) -> DataFrame:
    """The matches that greedy matching keeps: from left to right, longest first, none over another of the same type.

    At most `most` of a sentence stay, the most confident ones.  The choice is a
    fold over the sorted matches of one sentence and type, inside the JVM.
    """
    spans = found.groupBy(*keys, "entity_type").agg(
        F.array_sort(F.collect_list(F.struct("token_from", (-F.col("token_to")).alias("end"), "entity_uid", "confidence", "surface_key"))).alias("m")
    )
    empty = F.filter("m", lambda x: F.lit(False))
    free = lambda acc, x: ~F.exists(acc, lambda y: (x["token_from"] < -y["end"]) & (y["token_from"] < -x["end"]))
    kept = F.aggregate("m", empty, lambda acc, x: F.when(free(acc, x), F.array_append(acc, x)).otherwise(acc))
    out = spans.select(*keys, "entity_type", F.inline(kept)).withColumn("token_to", -F.col("end")).drop("end")
    return top_in_group(out, keys, [F.desc("confidence"), F.asc("token_from"), F.asc("token_to"), F.asc("entity_type"), F.asc("entity_uid")], most)


def cap_mentions(mentions: DataFrame, unit: str, confidence: str, order: Sequence[str], most: int = 14) -> DataFrame:
    """The most confident mentions of each sentence; pairs of mentions are then bounded by a constant for each sentence."""
    return top_in_group(mentions, [unit], [F.desc(confidence), *[F.asc(c) for c in order]], most)


def relation_pairs(mentions: DataFrame, keys: Sequence[str], pairs: DataFrame, most_distance: int) -> DataFrame:
    """keys, subject_uid, object_uid, subject_type, object_type, predicate, distance, min_confidence.

    mentions: keys, entity_uid, entity_type, start, end, confidence; keys are a
    sentence with a capped number of mentions (:func:`cap_mentions`).  pairs: subject_type, object_type, predicate.  The distance is the gap between the
    two spans; the nearest pair of two entities counts.
    """
    cols = ("entity_uid", "entity_type", "start", "end", "confidence")
    side = lambda p: mentions.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in cols])
    both = side("s").join(side("o"), list(keys)).filter("s_entity_uid <> o_entity_uid")
    typed = both.join(F.broadcast(pairs), (F.col("s_entity_type") == F.col("subject_type")) & (F.col("o_entity_type") == F.col("object_type")))
    gap = F.greatest(F.lit(0), F.greatest(F.col("s_start") - F.col("o_end"), F.col("o_start") - F.col("s_end")))
    near = typed.withColumn("distance", gap).filter(F.col("distance") <= most_distance)
    return near.groupBy(*keys, F.col("s_entity_uid").alias("subject_uid"), F.col("o_entity_uid").alias("object_uid"), "subject_type", "object_type", "predicate").agg(
        F.min("distance").alias("distance"), F.max(F.least("s_confidence", "o_confidence")).alias("min_confidence")
    )


def relation_probability(score: Column, section: Column, confidence: Column, context: Column, signed: Column, distance: Column, n_mentions: Column, certainty: Column) -> Column:
    """The product of the weights of a relation, clamped to [0, 1]."""
    near = F.when(distance <= 80, 1.0).when(distance <= 160, 0.88).otherwise(0.72)
    density = F.when(n_mentions <= 6, 1.0).otherwise(F.greatest(F.lit(0.72), 1.0 - 0.035 * (n_mentions - 6)))
    direction = F.when(signed, 1.0).otherwise(0.82)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score * X.section_weight(section) * confidence * context * direction * near * density * certainty))


def noisy_or(df: DataFrame, keys: Sequence[str], p: str, name: str = "probability", clamp: float = 1.0) -> DataFrame:
    """1 - product(1 - p) of each group, p clamped to [0, clamp]; null p is left out."""
    inside = F.greatest(F.lit(0.0), F.least(F.lit(clamp), F.col(p)))
    return df.filter(F.col(p).isNotNull()).groupBy(*keys).agg((1 - F.product(1 - inside)).alias(name), F.count("*").alias("n"))


def clustered_probability(df: DataFrame, keys: Sequence[str], article: str, p: str) -> DataFrame:
    """keys, probability, n_articles, n_rows: the best sentence of each article, then noisy-or over articles."""
    per = df.filter(F.col(p).isNotNull()).groupBy(*keys, article).agg(F.max(p).alias("_p"), F.count("*").alias("_n"))
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_p")))
    return per.groupBy(*keys).agg((1 - F.product(1 - inside)).alias("probability"), F.count("*").alias("n_articles"), F.sum("_n").alias("n_rows"))


def edge_support(relations: DataFrame, known: DataFrame, minimum: float = 0.25) -> DataFrame:
    """Edges of relations with their class of support.

    relations: subject_uid, predicate, object_uid, polarity, status (support,
    contradict, uncertain, background), article, p.  known: subject_uid,
    predicate, object_uid.  Class: conflict_candidate for a contradiction or
    opposite polarities; background_candidate or unresolved without support;
    support_direction or confirm for a known edge; novel_candidate from the
    minimum probability on; else unresolved.
    """
    keys = ["subject_uid", "predicate", "object_uid"]
    # articles are combined first, so that a hot edge is spread over its articles
    per = relations.groupBy(*keys, "article").agg(
        F.max("p").alias("p"), F.count("*").alias("n"), F.collect_set("polarity").alias("pol"), F.collect_set("status").alias("st")
    )
    total = per.groupBy(*keys).agg(
        (1 - F.product(1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("p", F.lit(0.0)))))).alias("probability"),
        F.sum("n").alias("n_sentences"), F.count("*").alias("n_articles"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("pol")))).alias("polarities"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("st")))).alias("statuses"),
    )
    marked = total.join(known.select(*keys).distinct().withColumn("is_known", F.lit(True)), keys, "left").withColumn("is_known", F.coalesce("is_known", F.lit(False)))
    pol = lambda x: F.array_contains("polarities", x)
    st = lambda x: F.array_contains("statuses", x)
    opposite = (pol("increase") & pol("decrease")) | (pol("activation") & pol("inhibition"))
    signed = F.exists("polarities", lambda x: x != "association")
    kind = (
        F.when(st("contradict") | opposite, "conflict_candidate")
        .when(~st("support") & st("background") & (F.size("statuses") == 1), "background_candidate")
        .when(~st("support"), "unresolved")
        .when(F.col("is_known"), F.when(signed, "support_direction").otherwise("confirm"))
        .when(F.col("probability") >= minimum, "novel_candidate")
        .otherwise("unresolved")
    )
    return marked.withColumn("support_class", kind)


def precision_rules(surfaces: DataFrame, rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, blocked, multiplier: wildcard rules on surface, entity type and matched field.

    surfaces: surface_key, entity_type, matched_field.  rules: surface_key,
    entity_type, matched_field (`*` is any), multiplier (0 blocks); all that match
    multiply; without a match the multiplier is 1.
    """
    # a row asks for its eight ways of being matched, so that the rules are looked up and not tried one by one
    either = lambda c: F.explode(F.array(F.col(c), F.lit("*")))
    asks = surfaces.select(*keys, F.col("surface_key").alias("_s"), F.col("entity_type").alias("_t"), F.col("matched_field").alias("_f"))
    for c in ("_s", "_t", "_f"):
        asks = asks.withColumn(f"r{c}", either(c))
    r = rules.groupBy(F.col("surface_key").alias("r_s"), F.col("entity_type").alias("r_t"), F.col("matched_field").alias("r_f")).agg(F.product("multiplier").alias("multiplier"))
    hit = asks.join(small(r), ["r_s", "r_t", "r_f"], "left")
    out = hit.groupBy(*keys).agg(F.product(F.coalesce("multiplier", F.lit(1.0))).alias("multiplier"))
    return out.select(*keys, (F.col("multiplier") == 0).alias("blocked"), "multiplier")


def mention_statistics(mentions: DataFrame, keys: Sequence[str], surface: str, entity: str, article: str) -> DataFrame:
    """Mentions, entities and articles of each surface, with its risk flags (many entities, a short or numeric form)."""
    out = mentions.groupBy(*keys).agg(F.count("*").alias("n_mentions"), F.count_distinct(entity).alias("n_entities"), F.count_distinct(article).alias("n_articles"))
    flags = F.array_compact(F.array(
        F.when(F.col("n_entities") > 1, "many_entities"), F.when(F.length(surface) <= 3, "short"), F.when(F.col(surface).rlike("[0-9]"), "digits"),
        F.when(F.col("n_mentions") >= 50, "frequent"),
    ))
    return out.withColumn("risk_flags", F.array_join(flags, ";"))


def relevance_weighted(df: DataFrame, p: str, relevance: str, minimum: float = 0.20) -> DataFrame:
    """Rows whose probability times (0.5 + 0.5 relevance) is still the minimum; without a relevance it stays."""
    weight = F.coalesce(0.5 + 0.5 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(relevance))), F.lit(1.0))
    return df.withColumn("weighted", F.col(p) * weight).filter(F.col("weighted") >= minimum)


def fact_gate(rows: DataFrame, reasons: Sequence[tuple[str, Column]]) -> DataFrame:
    """rows with blocking_reasons, is_fact and readiness.

    rows: role, semantic (whether the role is from a semantic source).  Readiness
    .96 for a substrate or product of a semantic source, .92 of another, .85 for
    another named role, .78 for a participant; 0 with any blocking reason.
    """
    blocked = F.array_compact(F.array(*[F.when(c, n) for n, c in reasons]))
    side = F.col("role").isin("substrate", "product")
    ready = F.when(side & F.col("semantic"), 0.96).when(side, 0.92).when(F.col("role") == "participant", 0.78).otherwise(0.85)
    out = rows.withColumn("blocking_reasons", blocked)
    return out.withColumn("is_fact", F.size("blocking_reasons") == 0).withColumn("readiness", F.when(F.col("is_fact"), ready).otherwise(0.0))


def co_mentions(mentions: DataFrame, unit: str, entity: str, kind: str, least: int = 2) -> DataFrame:
    """Pairs of entities of different types in one unit, with the units that hold both.

    Units are sentences or articles with a bounded number of entities; pairs are
    counted before they are sorted out.
    """
    m = mentions.select(unit, F.col(entity).alias("e"), F.col(kind).alias("k")).distinct()
    a, b = m.select(unit, F.col("e").alias("a"), F.col("k").alias("a_type")), m.select(unit, F.col("e").alias("b"), F.col("k").alias("b_type"))
    return a.join(b, unit).filter("a < b and a_type <> b_type").groupBy("a", "b", "a_type", "b_type").agg(F.count("*").alias("n_units")).filter(F.col("n_units") >= least)
