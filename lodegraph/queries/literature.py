"""Evidence from the documents and from the sentence mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions import text as X
from lodegraph.functions.keys import hash_bucket
from lodegraph.functions.values import bare_number
from lodegraph.operators import literature as L
from lodegraph.queries import sql_patterns as S
from lodegraph.runtime import Scratch, table, widen

C = F.col
TERMS = {
    "process": ("biosynthesis", "degradation", "transcription", "homeostasis", "inhibition", "metabolism"),
    "anatomy": ("kidney", "liver", "muscle", "skin", "heart", "cell"),
}
PAIRS = (("metabolite", "disease", "associated_with_disease"), ("gene", "pathway", "regulates_process"), ("metabolite", "gene", "regulates_gene"))
RULES = (("*", "gene", "alias", 0.7), ("*", "metabolite", "synonym", 0.85), ("rdva", "*", "*", 0.0), ("*", "*", "alias", 0.9))
COLUMNS = ("mention_uid", "sentence_uid", "article_uid", "pmid", "section", "entity_uid", "entity_type", "normalized_surface", "start_offset", "end_offset", "matched_field", "resolution_confidence")


def _mentions(spark, d, *columns):
    return table(spark, d, "sentence_mentions").select("mention_uid", *columns).dropDuplicates(["mention_uid"])


def _sentences(spark, d):
    return L.split_sentences(widen(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d)


def sentence_cues(spark: SparkSession, d: str) -> DataFrame:
    s = L.split_sentences(widen(table(spark, d, "documents").select(F.struct("doc_id", "section").alias("k"), "text")), "k", "text")
    s = s.select("k.doc_id", "sentence_no", "sentence", X.cues(C("sentence"), C("k.section")).alias("cues")).withColumn("a", X.assertion(C("cues")))
    return s.select("doc_id", "sentence_no", F.array_join("cues", ";").alias("cues"), "a.status", "a.reason", F.array_join(X.method_cues(C("sentence")), ";").alias("methods"))


def oncology_weights(spark: SparkSession, d: str) -> DataFrame:
    s = _sentences(spark, d).withColumn("oncology_weight", X.oncology_weight(C("sentence"), C("sentence").contains("disease")))
    return s.groupBy("oncology_weight").agg(F.count("*").alias("n_sentences"))


def assertion_counts(spark: SparkSession, d: str) -> DataFrame:
    s = _sentences(spark, d).withColumn("status", X.assertion_status(X.cues(C("sentence"))))
    s = s.withColumn("certainty", F.round(X.certainty_weight(C("sentence"), C("status")), 4))
    return s.groupBy("status", "certainty").agg(F.count("*").alias("n_sentences"))


def sentence_triggers(spark: SparkSession, d: str) -> DataFrame:
    s = _sentences(spark, d)
    for family in ("change", "association", "regulation"):
        s = s.withColumn(family, X.trigger(C("sentence"), family))
    return s.select("doc_id", "sentence_no", C("change.polarity").alias("change"), C("association.polarity").alias("association"), C("regulation.polarity").alias("regulation"), C("regulation.score").alias("regulation_score")).filter("change is not null or association is not null or regulation is not null")


def _lexicon(spark, d):
    labels = table(spark, d, "metabolite_gold_labels").select(C("label").alias("surface"), C("metabolite_uid").alias("entity_uid"), F.lit("metabolite").alias("entity_type"), F.lit("canonical_name").alias("field"), F.lit(0.93).alias("confidence"))
    bare = table(spark, d, "metabolite_gold_labels").select(F.regexp_replace("label", "^(D|L|alpha|beta)-", "").alias("surface"), C("metabolite_uid").alias("entity_uid"), F.lit("metabolite").alias("entity_type"), F.lit("synonym").alias("field"), F.lit(0.82).alias("confidence"))
    rows = [(t, f"{k}_{t}", k, "name", 0.9) for k, ts in TERMS.items() for t in ts]
    return L.build_lexicon(labels.unionByName(bare).unionByName(spark.createDataFrame(rows, labels.schema)))


def lexicon(spark: SparkSession, d: str) -> DataFrame:
    out = _lexicon(spark, d)
    return out.select("surface_key", "entity_uid", "entity_type", F.round("priority", 4).alias("priority"), "n_tokens")


def phrase_matches(spark: SparkSession, d: str) -> DataFrame:
    out = L.match_phrases(_sentences(spark, d), ["doc_id", "sentence_no"], "sentence", _lexicon(spark, d))
    return out.select("doc_id", "sentence_no", "entity_uid", "entity_type", "token_from", "token_to", "surface_key")


def longest_mentions(spark: SparkSession, d: str) -> DataFrame:
    keys = ["doc_id", "sentence_no"]
    return L.longest_matches(L.match_phrases(_sentences(spark, d), keys, "sentence", _lexicon(spark, d)), keys)


def _relations(spark, d):
    m = _mentions(spark, d, *COLUMNS[1:]).select("mention_uid", "sentence_uid", "article_uid", "section", "entity_uid", "entity_type", C("start_offset").alias("start"), C("end_offset").alias("end"), F.coalesce("resolution_confidence", F.lit(0.5)).alias("confidence"))
    m = L.cap_mentions(m, "sentence_uid", "confidence", ["start", "end", "mention_uid"])
    pairs = spark.createDataFrame(PAIRS, "subject_type string, object_type string, predicate string")
    rel = L.relation_pairs(m, ["sentence_uid"], pairs, 240)
    per = m.groupBy("sentence_uid").agg(F.count("*").alias("n_mentions"), F.max(F.when(C("entity_type") == "disease", 1).otherwise(0)).alias("disease"), F.min("section").alias("section"), F.min("article_uid").alias("article_uid"))
    return rel.join(per, "sentence_uid")


def relations(spark: SparkSession, d: str) -> DataFrame:
    return _relations(spark, d).select("sentence_uid", "subject_uid", "object_uid", "predicate", "distance", F.round("min_confidence", 6).alias("min_confidence"))


def _probable(spark, d):
    r = _relations(spark, d)
    p = L.relation_probability(F.lit(0.74), C("section"), C("min_confidence"), F.when(C("disease") == 1, 1.0).otherwise(0.85), C("predicate") != "associated_with_disease", C("distance"), C("n_mentions"), F.lit(1.0))
    return r.withColumn("p", p)


def relation_probability(spark: SparkSession, d: str) -> DataFrame:
    return _probable(spark, d).filter("p >= 0.2").select("sentence_uid", "subject_uid", "object_uid", F.round(C("p") + 1e-9, 6).alias("p"))


def noisy_or(spark: SparkSession, d: str) -> DataFrame:
    m = _mentions(spark, d, "entity_uid", "resolution_confidence").withColumn("p", C("resolution_confidence") * 0.02)
    out = L.noisy_or(m, ["entity_uid"], "p")
    return out.select("entity_uid", F.round("probability", 6).alias("probability"), "n")


def clustered_probability(spark: SparkSession, d: str) -> DataFrame:
    m = _mentions(spark, d, "entity_uid", "article_uid", "resolution_confidence").withColumn("p", C("resolution_confidence") * 0.02)
    out = L.clustered_probability(m, ["entity_uid"], "article_uid", "p")
    return out.select("entity_uid", F.round("probability", 6).alias("probability"), "n_articles", "n_rows")


def edge_support(spark: SparkSession, d: str) -> DataFrame:
    r = Scratch(spark, "support").save(_probable(spark, d))  # the known edges are taken from it, too
    b = hash_bucket(F.concat("subject_uid", "article_uid"), 8, 10)
    r = r.withColumn("b", b).withColumn("polarity", F.when(C("b") < 2, "activation").when(C("b") < 3, "inhibition").otherwise("association"))
    r = r.withColumn("status", F.when(C("b") == 9, "contradict").when(C("b") == 8, "uncertain").when(C("b") == 7, "background").otherwise("support"))
    known = r.filter(hash_bucket(C("object_uid"), 8, 5) == 0).select("subject_uid", "predicate", "object_uid")
    out = L.edge_support(r.withColumnRenamed("article_uid", "article"), known)
    return out.select("subject_uid", "predicate", "object_uid", F.round(C("probability") + 1e-9, 6).alias("probability"), "n_articles", F.array_join("polarities", ";").alias("polarities"), F.array_join("statuses", ";").alias("statuses"), "is_known", "support_class")


def precision_rules(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sentence_mentions").select(C("normalized_surface").alias("surface_key"), "entity_type", "matched_field").filter("surface_key is not null").distinct()
    rules = spark.createDataFrame(RULES, "surface_key string, entity_type string, matched_field string, multiplier double")
    keys = ["surface_key", "entity_type", "matched_field"]
    out = L.precision_rules(s, rules, keys)
    return out.select(*keys, "blocked", F.round("multiplier", 6).alias("multiplier"))


def surface_statistics(spark: SparkSession, d: str) -> DataFrame:
    m = _mentions(spark, d, "normalized_surface", "entity_uid", "pmid").filter("normalized_surface is not null").withColumn("pmid", bare_number(C("pmid")))
    return L.mention_statistics(m, ["normalized_surface"], "normalized_surface", "entity_uid", "pmid")


def entity_mentions(spark: SparkSession, d: str) -> DataFrame:
    m = _mentions(spark, d, "entity_uid", "entity_type", "article_uid", "normalized_surface")
    return m.groupBy("entity_uid", "entity_type").agg(F.count("*").alias("n_mentions"), F.count_distinct("article_uid").alias("n_articles"), F.count_distinct("normalized_surface").alias("n_surfaces"))


def relevance_weighted(spark: SparkSession, d: str) -> DataFrame:
    m = _mentions(spark, d, "section", "resolution_confidence").filter("resolution_confidence is not null")
    rel = m.withColumn("relevance", F.when(C("section").isNotNull(), X.section_weight(C("section")) - 0.2))
    out = L.relevance_weighted(rel.withColumn("p", C("resolution_confidence") * 0.3), "p", "relevance", 0.2)
    return out.select("mention_uid", F.round(C("weighted") + 1e-9, 6).alias("weighted"))


def fact_gate(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "chemical_xrefs").select("chemical_uid", "xref_source", "xref_id", "xref_type", "source_record_uid").distinct()
    role = F.when(C("xref_type") == "exact", "substrate").when(C("xref_type") == "related", "product").otherwise("participant")
    rows = x.withColumn("role", role).withColumn("semantic", F.upper(F.trim("xref_source")) == "CHX")
    out = L.fact_gate(rows, [("no_record", C("source_record_uid").isNull()), ("no_identifier", C("xref_id").isNull() | (F.trim("xref_id") == "")), ("unresolved_role", C("role") == "participant")])
    return out.groupBy("role", F.array_join("blocking_reasons", ";").alias("blocking_reasons"), "readiness").agg(F.count("*").alias("n_rows"))


def co_mentions(spark: SparkSession, d: str) -> DataFrame:
    return L.co_mentions(_mentions(spark, d, "sentence_uid", "entity_uid", "entity_type"), "sentence_uid", "entity_uid", "entity_type")


QUERIES = {f.__name__: f for f in (
    sentence_split, sentence_cues, oncology_weights, assertion_counts, sentence_triggers, lexicon, phrase_matches, longest_mentions, relations, relation_probability,
    noisy_or, clustered_probability, edge_support, precision_rules, surface_statistics, entity_mentions, relevance_weighted, fact_gate, co_mentions,
)}


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


_S = """
    s0 as (select doc_id, regexp_extract_all(text, '[^.!?\\n]+(?:[.!?]+|$)') as ss from documents),
    s1 as (select doc_id, list_filter(list_transform(ss, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: length(x) >= 8) as ss from s0),
    s as (select doc_id, (i - 1)::int as sentence_no, ss[i] as sentence from (select *, unnest(range(1, len(ss) + 1)) as i from s1))"""
_SAID = {c: f"regexp_matches(low, '{_q(p)}')" for c, p in S.CUES.items()}
_NEG = f"""case when {_SAID['non_negating_negation']} and not {_SAID['null_result']} and not {_SAID['hedged_negation']}
    then regexp_matches(regexp_replace(low, '{_q(S.CUES['non_negating_negation'])}', '', 'g'), '{_q(S.CUES['negation'])}') else {_SAID['negation']} end"""
_HAS = _SAID | {"negation": _NEG, "causal_weakening": f"({_SAID['causal_weakening']} or {_SAID['alternative_explanation']})"}
_CUED = f"""
    {_S}, c as (select doc_id, sentence_no, sentence, low, {', '.join(f"{_HAS[c]} as {c}" for c in sorted(S.CUES))}, {_SAID['causal_weakening']} as causal_said from (select *, lower(sentence) as low from s)),
    cs as (select * replace (background or coalesce(lower(trim(section, ' ')) in ('background', 'review'), false) as background) from c join (select doc_id, section from documents) using (doc_id)),
    st as (select *, case when null_result then 'contradict' when conflict or context_boundary then 'uncertain' when causal_weakening then 'uncertain'
      when negation and not (hedged_negation or weak_observation) then 'contradict' when uncertainty or weak_observation or hedged_negation then 'uncertain'
      when concession and not (direct_assay or comparison_context) then 'uncertain' when background then 'background' else 'support' end as status from c)"""
# Fixed patterns of the SQL: its own copy of the method cues.
_METHODS = (
    ("patient_sample", r"\b(patients?|tumou?r tissue|tumou?r regions?|samples?|clinical sample|clinical cohorts?|cohorts?|biopsy|adjacent tissue|matched normal|plasma|serum)\b"),
    ("cell_line_model", r"\b(cell line|cells?|in vitro|culture)\b"),
    ("animal_model", r"\b(mouse|mice|murine|xenograft|in vivo)\b"),
    ("measurement_assay", r"\b(measured|quantified|detected|lc[- ]?ms|ms/ms|mass spectrometry|metabolomics|western blot|qpcr|single[- ]cell|spatial metabolomics|isotope|tracing|13c)\b"),
    ("intervention_assay", r"\b(knockdown|knockout|overexpression|inhibitor|inhibition|silencing|crispr|sirna|shrna|treated with|depletion|deprivation|withdrawal)\b"),
)
_TRIGGER = {
    f: "case " + " ".join(f"when regexp_matches(lower(sentence), '{_q(p)}') then {{{i}}}" for i, (k, _, _, p) in enumerate(x for x in S.TRIGGERS if x[0] == f)) + " end"
    for f in ("change", "association", "regulation")
}
_POL = {f: [repr(pol) for k, pol, _, _ in S.TRIGGERS if k == f] for f in _TRIGGER}
_REG_SCORE = [f"{sc}::double" for k, _, sc, _ in S.TRIGGERS if k == "regulation"]
_TERM_ROWS = " union all ".join(f"select '{t}', '{k}_{t}', '{k}', 0.95::double, 'name'" for k, ts in TERMS.items() for t in ts)
_LEX = f"""
    l0 as (select label as surface, metabolite_uid as uid, 'metabolite' as kind, 1.01::double as base, 'canonical_name' as field from metabolite_gold_labels
      union all select regexp_replace(label, '^(D|L|alpha|beta)-', ''), metabolite_uid, 'metabolite', 0.82::double, 'synonym' from metabolite_gold_labels union all {_TERM_ROWS}),
    l1 as (select distinct *, regexp_extract_all(lower(surface), '[a-z0-9]+') as toks from l0),
    l2 as (select array_to_string(toks, ' ') as surface_key, uid, kind, field, len(toks)::int as n_tokens, least(1.0, base + least(0.06, 0.015 * len(toks))) as priority from l1
      where (len(toks) > 1 or length(toks[1]) >= 4) and lower(surface) not in ('metabolism', 'cell')),
    l4 as (select *, row_number() over w as rn, lead(priority) over w as second, (select count(distinct uid) from l2 u where u.kind = l2.kind and u.surface_key = l2.surface_key) as n_uids from l2 window w as (partition by kind, surface_key order by priority desc, uid, field)),
    lex as (select surface_key, uid as entity_uid, kind as entity_type, round(priority, 4) as priority, n_tokens from l4 where rn = 1 and (n_uids = 1 or priority - second >= 0.12))"""
_M = "m as (select distinct mention_uid, sentence_uid, article_uid, pmid, section, entity_uid, entity_type, normalized_surface, start_offset, end_offset, matched_field, resolution_confidence from sentence_mentions)"
_PAIR_ROWS = " union all ".join(f"select '{a}' as st, '{b}' as ot, '{p}' as predicate" for a, b, p in PAIRS)
_REL = f"""
    {_M}, pt as ({_PAIR_ROWS}),
    k as (select *, coalesce(resolution_confidence, 0.5) as c, row_number() over (partition by sentence_uid order by coalesce(resolution_confidence, 0.5) desc, start_offset, end_offset, mention_uid) as rn from m),
    k2 as (select * from k where rn <= 14),
    r as (select a.sentence_uid, a.entity_uid as subject_uid, b.entity_uid as object_uid, predicate, min(greatest(0, a.start_offset - b.end_offset, b.start_offset - a.end_offset)) as distance, max(least(a.c, b.c)) as min_confidence
      from k2 a join k2 b on a.sentence_uid = b.sentence_uid and a.entity_uid <> b.entity_uid join pt on a.entity_type = st and b.entity_type = ot
      where greatest(0, a.start_offset - b.end_offset, b.start_offset - a.end_offset) <= 240 group by 1, 2, 3, 4),
    per as (select sentence_uid, count(*) as n_mentions, max((entity_type = 'disease')::int) as disease, min(section) as section, min(article_uid) as article_uid from k2 group by 1)"""
_SECTION = "coalesce(map {" + ", ".join(f"'{k}': {v}::double" for k, v in S.SECTION_WEIGHTS.items()) + "}[lower(trim(section))], 0.7)"
_PROB = f"""{_REL}, pr as (select r.*, article_uid, greatest(0, least(1, 0.74::double * {_SECTION} * min_confidence * (case when disease = 1 then 1.0 else 0.85 end)::double * (case when predicate <> 'associated_with_disease' then 1.0 else 0.82 end)::double
      * (case when distance <= 80 then 1.0 when distance <= 160 then 0.88 else 0.72 end)::double * (case when n_mentions <= 6 then 1.0::double else greatest(0.72::double, 1.0::double - 0.035::double * (n_mentions - 6)) end))) as p from r join per using (sentence_uid))"""
_B = "('0x' || left(sha256({x}), 8))::bigint % {n}"
_RULE_ROWS = " union all ".join(f"select '{a}' as rs, '{b}' as rt, '{c}' as rf, {m}::double as mult" for a, b, c, m in RULES)

ORACLES = {
    "sentence_split": f"with {_S} select doc_id, sentence_no, sentence, len(regexp_extract_all(lower(sentence), '[a-z0-9]+'))::int as n_tokens from s",
    "sentence_cues": f"""
        with {_CUED}, q as (select *, case when null_result then 'contradict:null_result' when conflict or context_boundary then 'uncertain:conflict_or_context_boundary' when causal_weakening then 'uncertain:causal_weakening'
          when negation and not (hedged_negation or weak_observation) then 'contradict:effective_negation' when uncertainty or weak_observation or hedged_negation then 'uncertain:uncertain_or_weak_language'
          when concession and not (direct_assay or comparison_context) then 'uncertain:unsupported_concession' when background then 'background:background_or_review_context' else 'support:direct_or_contextual_support' end as v from cs)
        select doc_id, sentence_no, concat_ws(';', {', '.join(f"case when {c} then '{c}' end" for c in sorted(S.CUES))}) as cues, split_part(v, ':', 1) as status, split_part(v, ':', 2) as reason,
          concat_ws(';', {', '.join(f"case when regexp_matches(low, '{_q(p)}') then '{n}' end" for n, p in _METHODS)}) as methods from q""",
    "oncology_weights": f"""
        with {_S} select (case when contains(sentence, 'disease') then 1 when regexp_matches(lower(sentence), 'cancer|tumou?r|carcinoma|sarcoma|melanoma|leuka?emia|lymphoma|glioma|glioblastoma|neoplasm|metastasis|metastatic|oncogenic|malignan(cy|t)')
          then 0.85 else 0 end)::double as oncology_weight, count(*) as n_sentences from s group by 1""",
    "assertion_counts": f"""
        with {_CUED}, w as (select status, round(greatest(0.55, least(1.08, (case when uncertainty or weak_observation then 0.72 else 1 end)::double * (case when status = 'contradict' then 0.7 else 1 end)::double * (case when causal_said then 0.68 else 1 end)::double
          * (case when conflict then 0.7 else 1 end)::double * (case when context_boundary then 0.74 else 1 end)::double * (case when concession and not direct_assay then 0.84 else 1 end)::double
          * (case when background then 0.86 else 1 end)::double * (case when comparison_context then 1.03 else 1 end)::double * (case when direct_assay then 1.06 else 1 end)::double)), 4) as certainty from st)
        select status, certainty, count(*) as n_sentences from w group by 1, 2""",
    "sentence_triggers": f"""
        with {_S} select * from (select doc_id, sentence_no, {', '.join(f"{_TRIGGER[f].format(*_POL[f])} as {f}" for f in _TRIGGER)}, {_TRIGGER['regulation'].format(*_REG_SCORE)} as regulation_score from s)
        where change is not null or association is not null or regulation is not null""",
    "lexicon": f"with {_LEX} select * from lex",
    "phrase_matches": f"""
        with {_S}, {_LEX}, t as (select doc_id, sentence_no, regexp_extract_all(lower(sentence), '[a-z0-9]+') as toks from s),
        g as (select doc_id, sentence_no, toks, unnest(range(len(toks))) as i from t),
        n as (select doc_id, sentence_no, i::int as token_from, (i + w)::int as token_to, array_to_string(toks[i + 1 : i + w], ' ') as surface_key from g, range(1, 11) r(w) where i + w <= len(toks))
        select doc_id, sentence_no, entity_uid, entity_type, token_from, token_to, surface_key from n join lex using (surface_key)""",
    "relations": f"with {_REL} select sentence_uid, subject_uid, object_uid, predicate, distance, round(min_confidence, 6) as min_confidence from r",
    "relation_probability": f"with {_PROB} select sentence_uid, subject_uid, object_uid, round(p + 1e-9::double, 6) as p from pr where p >= 0.2",
    "noisy_or": f"with {_M} select entity_uid, round(1 - product(1 - resolution_confidence * 0.02::double), 6) as probability, count(*) as n from m where resolution_confidence is not null group by 1",
    "clustered_probability": f"""
        with {_M}, a as (select entity_uid, article_uid, max(resolution_confidence * 0.02::double) as p, count(*) as n from m where resolution_confidence is not null group by 1, 2)
        select entity_uid, round(1 - product(1 - p), 6) as probability, count(*) as n_articles, sum(n)::bigint as n_rows from a group by 1""",
    "edge_support": f"""
        with {_PROB}, q as (select *, {_B.format(x="subject_uid || article_uid", n=10)} as b from pr),
        v as (select *, case when b < 2 then 'activation' when b < 3 then 'inhibition' else 'association' end as polarity, case when b = 9 then 'contradict' when b = 8 then 'uncertain' when b = 7 then 'background' else 'support' end as status from q),
        w as (select subject_uid, predicate, object_uid, article_uid, max(p) as p, list(polarity) as pol, list(status) as st from v group by 1, 2, 3, 4),
        e as (select subject_uid, predicate, object_uid, 1 - product(1 - p) as probability, count(*) as n_articles, list_sort(list_distinct(flatten(list(pol)))) as pol, list_sort(list_distinct(flatten(list(st)))) as st, {_B.format(x="object_uid", n=5)} = 0 as is_known from w group by 1, 2, 3)
        select subject_uid, predicate, object_uid, round(probability + 1e-9::double, 6) as probability, n_articles, array_to_string(pol, ';') as polarities, array_to_string(st, ';') as statuses, is_known,
          case when list_contains(st, 'contradict') or (list_contains(pol, 'activation') and list_contains(pol, 'inhibition')) then 'conflict_candidate'
            when not list_contains(st, 'support') and st = ['background'] then 'background_candidate' when not list_contains(st, 'support') then 'unresolved'
            when is_known then case when len(list_filter(pol, lambda x: x <> 'association')) > 0 then 'support_direction' else 'confirm' end when probability >= 0.25 then 'novel_candidate' else 'unresolved' end as support_class from e""",
    "precision_rules": f"""
        with s as (select distinct normalized_surface as surface_key, entity_type, matched_field from sentence_mentions where normalized_surface is not null), r as ({_RULE_ROWS})
        select surface_key, entity_type, matched_field, product(coalesce(mult, 1)) = 0 as blocked, round(product(coalesce(mult, 1)), 6) as multiplier
        from s left join r on (rs = '*' or rs = surface_key) and (rt = '*' or rt = entity_type) and (rf = '*' or rf = matched_field) group by 1, 2, 3""",
    "surface_statistics": f"""
        with {_M}, p as (select normalized_surface, entity_uid, nullif(regexp_extract(pmid, '0*([1-9][0-9]*)', 1), '')::bigint as pmid from m where normalized_surface is not null),
        g as (select normalized_surface, count(*) as n_mentions, count(distinct entity_uid) as n_entities, count(distinct pmid) as n_articles from p group by 1)
        select *, concat_ws(';', case when n_entities > 1 then 'many_entities' end, case when length(normalized_surface) <= 3 then 'short' end, case when regexp_matches(normalized_surface, '[0-9]') then 'digits' end, case when n_mentions >= 50 then 'frequent' end) as risk_flags from g""",
    "entity_mentions": f"with {_M} select entity_uid, entity_type, count(*) as n_mentions, count(distinct article_uid) as n_articles, count(distinct normalized_surface) as n_surfaces from m group by 1, 2",
    "relevance_weighted": f"""
        with {_M}, w as (select mention_uid, resolution_confidence * 0.3::double * coalesce(0.5 + 0.5 * greatest(0, least(1, case when section is not null then {_SECTION} - 0.2 end)), 1) as weighted from m where resolution_confidence is not null)
        select mention_uid, round(weighted + 1e-9::double, 6) as weighted from w where weighted >= 0.2""",
    "fact_gate": """
        with x as (select distinct chemical_uid, xref_source, xref_id, xref_type, source_record_uid from chemical_xrefs),
        r as (select *, case xref_type when 'exact' then 'substrate' when 'related' then 'product' else 'participant' end as role, upper(trim(xref_source, ' ')) = 'CHX' as semantic from x),
        b as (select *, concat_ws(';', case when source_record_uid is null then 'no_record' end, case when xref_id is null or trim(xref_id, ' ') = '' then 'no_identifier' end, case when role = 'participant' then 'unresolved_role' end) as blocking_reasons from r)
        select role, blocking_reasons, (case when blocking_reasons <> '' then 0 when role <> 'participant' and semantic then 0.96 when role <> 'participant' then 0.92 else 0.78 end)::double as readiness, count(*) as n_rows from b group by 1, 2, 3""",
    "co_mentions": f"""
        with {_M}, e as (select distinct sentence_uid, entity_uid, entity_type from m)
        select x.entity_uid as a, y.entity_uid as b, x.entity_type as a_type, y.entity_type as b_type, count(*) as n_units from e x join e y using (sentence_uid) where x.entity_uid < y.entity_uid and x.entity_type <> y.entity_type group by 1, 2, 3, 4 having count(*) >= 2""",
}
