"""Sentences, tokens and the language of evidence, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENTENCE = r"[^.!?\n]+(?:[.!?]+|$)"

# Fixed patterns: the cues of a sentence about evidence, without look-around so that other engines can run them.
CUES = {
    "alternative_explanation": r"\b(rather than|instead of|secondary to|(?:not )?attributable to|(?:not )?explained by|confounded by|driven by .{0,80} rather than)\b",
    "background": r"\b(review|summarizes?|background|overview|known to|has been implicated|previous studies|prior studies|has been reported|have been reported|is reported to|are reported to|canonical|hallmark)\b",
    "causal_weakening": r"\b(correlation does not (?:imply|prove) caus(?:e|ality)|does not prove caus(?:e|ality)|not sufficient|insufficient to|not required|independent of|dispensable|not necessary|necessary but not sufficient|cannot establish caus(?:e|ality)|remains to be determined|(?:no longer|not) significant after (?:adjustment|adjusting|controlling)|adjust(?:ed|ing) for .{0,80}(?:abolished|attenuated|weakened))\b",
    "comparison_context": r"\b(compared (?:with|to)|relative to|versus|vs\.?|tumou?r[- ]?vs[- ]?normal|adjacent|matched normal|control(?:s)?)\b",
    "concession": r"\b(although|though|whereas|while|despite|however|nevertheless|nonetheless|but)\b",
    "conflict": r"\b(conflicting|inconsistent|mixed results|discordant|controversial|contradictory)\b",
    "context_boundary": r"\b(only in (?:cell lines|cells|mice|mouse|xenografts?|animal models?)|in vitro but not in vivo|cell lines? but not (?:patient|tumou?r|clinical)|not observed in (?:patient|tumou?r|clinical|in vivo)|absent in (?:patient|tumou?r|clinical|in vivo)|only when|unless|except in|restricted to|context[- ]dependent|subtype[- ]specific)\b",
    "direct_assay": r"\b(measured|quantified|detected|validated|confirmed|knockdown|overexpression|inhibitor|isotope|tracing|13c|lc[- ]?ms|ms/ms|western blot|qpcr|single[- ]cell|spatial metabolomics)\b",
    "hedged_negation": r"\b(not necessarily|not always|not uniformly|not exclusively|not consistently)\b",
    "negation": r"\b(no|not|neither|without|failed to|did not|lack(?:ed|s|ing)?|absence of|little effect|no effect)\b",
    "non_negating_negation": r"\b(not only|not merely|not just|not simply)\b",
    "null_result": r"\b(no significant (?:difference|change|association|correlation)|no (?:detectable |measurable |appreciable )?(?:effect|change|difference|association|correlation)|failed to (?:show|demonstrate|detect|observe|confirm|rescue|suppress)|did not (?:show|demonstrate|detect|observe|confirm|increase|decrease|alter|rescue|suppress)|not (?:significantly )?(?:associated|correlated|linked|elevated|increased|decreased|changed|altered|higher|lower))\b",
    "uncertainty": r"\b(may|might|could|suggests?|potential|putative|hypothes(?:is|ized)|possible|possibly|unclear|inconclusive|cannot exclude|remains unknown|will be required|future work)\b",
    "weak_observation": r"\b(trend(?:ed)? toward|appears? to|tended to|nominal(?:ly)?|borderline|not statistically significant)\b",
}
# Fixed patterns: triggers of a relation as (family, polarity, score, pattern); the first that is found counts.
TRIGGERS = (
    ("change", "increase", 0.78, r"\b(elevated|increased|upregulated|overexpressed|higher|accumulated|enriched)\b"),
    ("change", "decrease", 0.78, r"\b(decreased|reduced|downregulated|lower|depleted|suppressed)\b"),
    ("association", "association", 0.70, r"\b(associated with|correlated with|linked to|predictive of|marker of|biomarker for|poor prognosis|overall survival|progression free survival)\b"),
    ("regulation", "activation", 0.74, r"\b(activates|activated|promotes|promoted|enhances|enhanced|induces|induced|drives|stabilizes|upregulates|upregulated)\b"),
    ("regulation", "inhibition", 0.74, r"\b(inhibits|inhibited|suppresses|suppressed|blocks|blocked|reduces|reduced|downregulates|downregulated)\b"),
    ("regulation", "association", 0.66, r"\b(regulates|regulated|modulates|modulated|controls|controlled)\b"),
)
# Weights of the sections of an article; any other section weighs OTHER_SECTION.
SECTION_WEIGHTS = {
    "title": 1.05, "abstract": 1.0, "results": 1.0, "conclusion": 1.0, "conclusions": 1.0, "discussion": 0.75,
    "introduction": 0.65, "background": 0.60, "full_text": 0.70, "methods": 0.20, "materials and methods": 0.20, "references": 0.05,
}
OTHER_SECTION = 0.70
# Fixed patterns: what a sentence says about how something was found.
METHOD_CUES = {
    "patient_sample": r"\b(patient(?:s)?|tumou?r tissue|tumou?r regions?|samples?|clinical sample|clinical cohorts?|cohorts?|biopsy|adjacent tissue|matched normal|plasma|serum)\b",
    "cell_line_model": r"\b(cell line|cells?|in vitro|culture)\b",
    "animal_model": r"\b(mouse|mice|murine|xenograft|in vivo)\b",
    "measurement_assay": r"\b(measured|quantified|detected|lc[- ]?ms|ms/ms|mass spectrometry|metabolomics|western blot|qpcr|single[- ]cell|spatial metabolomics|isotope|tracing|13c)\b",
    "intervention_assay": r"\b(knockdown|knockout|overexpression|inhibitor|inhibition|silencing|crispr|sirna|shrna|treated with|depletion|deprivation|withdrawal)\b",
}
# Words that tell of a tumour, found anywhere in a text.
ONCOLOGY_KEYWORDS = (
    "cancer", "cancers", "tumor", "tumors", "tumour", "tumours", "carcinoma", "adenocarcinoma", "sarcoma", "melanoma", "leukemia", "leukaemia",
    "lymphoma", "glioma", "glioblastoma", "neoplasm", "neoplasms", "metastasis", "metastatic", "oncogenic", "malignancy", "malignant",
)


def sentences(text: Column, least: int = 8) -> Column:
    """The sentences of a text with blanks collapsed, those shorter than `least` left out."""
    found = F.regexp_extract_all(text, F.lit(f"({SENTENCE})"), 1)
    flat = F.transform(found, lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.filter(flat, lambda s: F.length(s) >= least)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def has_cue(text: Column, cue: str) -> Column:
    """Whether a cue is found; a negation counts only outside `not only` and the like, unless a null result or a hedge is there."""
    low = F.lower(text)
    if cue == "causal_weakening":
        return low.rlike(CUES[cue]) | low.rlike(CUES["alternative_explanation"])
    if cue == "negation":
        idiom = low.rlike(CUES["non_negating_negation"]) & ~low.rlike(CUES["null_result"]) & ~low.rlike(CUES["hedged_negation"])
        return F.when(idiom, F.regexp_replace(low, CUES["non_negating_negation"], "").rlike(CUES[cue])).otherwise(low.rlike(CUES[cue]))
    return low.rlike(CUES[cue])


def cues(text: Column, section: Column | None = None) -> Column:
    """The sorted cues of a sentence; a background or review section is a background cue."""
    found = []
    for c in sorted(CUES):
        hit = has_cue(text, c)
        if c == "background" and section is not None:
            hit = hit | F.coalesce(F.lower(F.trim(section)).isin("background", "review"), F.lit(False))
        found.append(F.when(hit, c))
    return F.array_compact(F.array(*found))


def assertion(cues_: Column) -> Column:
    """Struct (status, reason) by the order of precedence of the cues; status is support, contradict, uncertain or background."""
    has = lambda *names: F.arrays_overlap(cues_, F.array(*[F.lit(n) for n in names]))
    made = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    return (
        F.when(has("null_result"), made("contradict", "null_result"))
        .when(has("conflict", "context_boundary"), made("uncertain", "conflict_or_context_boundary"))
        .when(has("causal_weakening"), made("uncertain", "causal_weakening"))
        .when(has("negation") & ~has("hedged_negation", "weak_observation"), made("contradict", "effective_negation"))
        .when(has("uncertainty", "weak_observation", "hedged_negation"), made("uncertain", "uncertain_or_weak_language"))
        .when(has("concession") & ~has("direct_assay", "comparison_context"), made("uncertain", "unsupported_concession"))
        .when(has("background"), made("background", "background_or_review_context"))
        .otherwise(made("support", "direct_or_contextual_support"))
    )


def assertion_status(cues_: Column) -> Column:
    return assertion(cues_)["status"]


def method_cues(text: Column) -> Column:
    """The method cues of a sentence, in the order of the fixed patterns."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike(p), n) for n, p in METHOD_CUES.items()]))


def oncology_weight(text: Column, has_disease: Column) -> Column:
    """1 with a mention of a disease, .85 with a word that tells of a tumour, else 0."""
    low = F.lower(text)
    return F.when(has_disease, 1.0).when(reduce(or_, [low.contains(k) for k in ONCOLOGY_KEYWORDS]), 0.85).otherwise(0.0)


def certainty_weight(text: Column, status: Column) -> Column:
    """The factor of a relation's probability that the wording of its sentence gives."""
    low = F.lower(text)
    said = lambda *names: reduce(or_, [low.rlike(CUES[n]) for n in names])
    factors = (
        (said("uncertainty", "weak_observation"), 0.72),
        (status == "contradict", 0.70),
        (said("causal_weakening"), 0.68),
        (said("conflict"), 0.70),
        (said("context_boundary"), 0.74),
        (said("concession") & ~said("direct_assay"), 0.84),
        (said("background"), 0.86),
        (said("comparison_context"), 1.03),
        (said("direct_assay"), 1.06),
    )
    weight = F.lit(1.0)
    for hit, x in factors:
        weight = weight * F.when(hit, x).otherwise(1.0)
    return F.greatest(F.lit(0.55), F.least(F.lit(1.08), weight))


def trigger(text: Column, family: str) -> Column:
    """Struct (polarity, score) of the first trigger of a family, null without one."""
    low, out = F.lower(text), None
    for kind, polarity, score, pattern in TRIGGERS:
        if kind == family:
            value = F.struct(F.lit(polarity).alias("polarity"), F.lit(score).alias("score"))
            out = F.when(low.rlike(pattern), value) if out is None else out.when(low.rlike(pattern), value)
    return out


def section_weight(section: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for kv in SECTION_WEIGHTS.items() for x in kv])
    return F.coalesce(F.element_at(weights, F.lower(F.trim(section))), F.lit(OTHER_SECTION))


def _spans(pattern: str, name: str, strip: str = "") -> Callable[[Column], Column]:
    """A column function that gives the matches of a pattern with their offsets, in one pass over each text."""
    kind = T.ArrayType(T.StructType([T.StructField(name, T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    arrow = pa.list_(pa.struct([(name, pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf(kind)
    def find(texts: pa.Array) -> pa.Array:
        found = re.compile(pattern)
        row = lambda m: {name: m.group().strip(strip) if strip else m.group(), "start": m.start(), "end": m.end()}
        return pa.array([None if t is None else [row(m) for m in found.finditer(t)] for t in texts.to_pylist()], arrow)

    return find


def tokens_with_offsets(text: Column) -> Column:
    """[(token, start, end)] of the alphanumeric tokens of a text, offsets from 0; null for null."""
    return _spans("[A-Za-z0-9]+", "token")(text)


def sentence_offsets(text: Column) -> Column:
    """[(sentence, start, end)] of the raw sentences of a text, offsets from 0; null for null."""
    return _spans(SENTENCE, "sentence", " ")(text)


def split_outside_parentheses(text: Column, separators: str = ",;") -> Column:
    """The trimmed non-blank parts of a text, split at separators that aren't inside parentheses; a fold over its characters."""
    chars = F.split(text, "")
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("part"), F.array(F.lit("")).alias("parts"))

    def step(acc: Column, c: Column) -> Column:
        depth = F.greatest(F.lit(0), acc["depth"] + F.when(c.isin("(", "["), 1).when(c.isin(")", "]"), -1).otherwise(0))
        cut = c.isin(*separators) & (acc["depth"] == 0)
        return F.struct(
            depth.alias("depth"), F.when(cut, F.lit("")).otherwise(F.concat(acc["part"], c)).alias("part"), F.when(cut, F.array_append(acc["parts"], acc["part"])).otherwise(acc["parts"]).alias("parts")
        )

    parts = F.aggregate(chars, start, step, lambda acc: F.array_append(acc["parts"], acc["part"]))
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
