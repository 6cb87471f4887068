"""Fixed patterns and weights of the SQL that checks the evidence queries: its own copy, so that a slip in the library shows."""

from __future__ import annotations

# Fixed patterns: the cues of a sentence.
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
# Fixed patterns: triggers as (family, polarity, score, pattern).
TRIGGERS = (
    ("change", "increase", 0.78, r"\b(elevated|increased|upregulated|overexpressed|higher|accumulated|enriched)\b"),
    ("change", "decrease", 0.78, r"\b(decreased|reduced|downregulated|lower|depleted|suppressed)\b"),
    ("association", "association", 0.70, r"\b(associated with|correlated with|linked to|predictive of|marker of|biomarker for|poor prognosis|overall survival|progression free survival)\b"),
    ("regulation", "activation", 0.74, r"\b(activates|activated|promotes|promoted|enhances|enhanced|induces|induced|drives|stabilizes|upregulates|upregulated)\b"),
    ("regulation", "inhibition", 0.74, r"\b(inhibits|inhibited|suppresses|suppressed|blocks|blocked|reduces|reduced|downregulates|downregulated)\b"),
    ("regulation", "association", 0.66, r"\b(regulates|regulated|modulates|modulated|controls|controlled)\b"),
)
# Weights of sections.
SECTION_WEIGHTS = {
    "title": 1.05,
    "abstract": 1.0,
    "results": 1.0,
    "conclusion": 1.0,
    "conclusions": 1.0,
    "discussion": 0.75,
    "introduction": 0.65,
    "background": 0.6,
    "full_text": 0.7,
    "methods": 0.2,
    "materials and methods": 0.2,
    "references": 0.05,
}
