"""Features made of the compounds' masses, matched back to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators import matching as M
from lodegraph.operators.resolve import settle
from lodegraph.runtime import table

C = F.col
THEMES = {"transport": ("transport", "shunt"), "turnover": ("degradation", "salvage", "cycle"), "absent": ("xylophone",)}


def _compounds(spark, d):
    return table(spark, d, "cid_properties").filter("exact_mass is not null").select("pubchem_cid", "exact_mass", "formula").dropDuplicates(["pubchem_cid"])


def _features(spark, d):
    c, n = _compounds(spark, d), C("pubchem_cid").cast("long")
    adduct = F.when(n % 3 == 0, "[M+H]+").when(n % 3 == 1, "[2M+H]+").otherwise("[M-H]-")
    shift = F.when(n % 3 == 2, -1.007276).otherwise(1.007276)
    return c.select(
        F.concat(F.lit("f"), "pubchem_cid").alias("feature"), (C("exact_mass") * F.when(n % 3 == 1, 2).otherwise(1) + shift + 0.0005).alias("mz"), adduct.alias("adduct"), F.lit(20.0).alias("ppm_tolerance"),
        F.when(n % 2 == 0, C("formula")).alias("f_formula"), (n % 17).cast("double").alias("rt"),
    )


def _scored(spark, d):
    held = _compounds(spark, d).select(C("pubchem_cid").alias("compound"), C("exact_mass").alias("mass"), C("formula").alias("c_formula"), (C("pubchem_cid").cast("long") % 19).cast("double").alias("c_rt"))
    pairs = M.mass_candidates(_features(spark, d), held)
    score = M.candidate_score(C("ppm"), C("ppm_tolerance"), F.coalesce(C("f_formula") == C("c_formula"), F.lit(False)), F.abs(C("rt") - C("c_rt")), F.lit(3.0), F.lit(None).cast("double"))
    return pairs.withColumn("score", score)


def feature_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("feature", "compound", F.round("ppm", 3).alias("ppm"), F.round("score", 4).alias("score"))


def settled_features(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d).select("feature", "compound", F.round("score", 4).alias("score"))
    out = settle(s, "feature", "compound", "score", 60.0, 15.0)
    return out.select("feature", "status", "compound", "n_uids")


def context_filtered(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "cell_type_signatures").select("signature_id", "context_terms", "confidence").dropDuplicates(["signature_id"])
    return M.context_filter(t, "context_terms", ["late", "early"], "confidence").select("signature_id", "context_fit", "confidence")


def theme_coverage(spark: SparkSession, d: str) -> DataFrame:
    return M.theme_coverage(table(spark, d, "cell_type_signatures").select("signature_id", "pathway_terms").dropDuplicates(["signature_id"]), "pathway_terms", THEMES)


QUERIES = {f.__name__: f for f in (feature_candidates, settled_features, context_filtered, theme_coverage)}

_SCORED = """
    c as (select distinct pubchem_cid, exact_mass, formula, pubchem_cid::bigint as n from cid_properties where exact_mass is not null),
    f as (select 'f' || pubchem_cid as feature, case when n % 2 = 0 then formula end as ff, (n % 17)::double as rt, exact_mass * (case when n % 3 = 1 then 2 else 1 end) + (case when n % 3 = 2 then -1.007276 else 1.007276 end)::double + 0.0005::double as mz, n % 3 as k from c),
    g as (select *, case k when 0 then (mz * 1.0::double - 1.007276::double) / 1.0::double when 1 then (mz * 1.0::double - 1.007276::double) / 2.0::double else (mz * 1.0::double + 1.007276::double) / 1.0::double end as neutral from f),
    p as (select feature, pubchem_cid as compound, abs(neutral - exact_mass) / exact_mass * 1e6::double as ppm, ff = formula as same, abs(rt - (n % 19)) as gap from g join c on abs(neutral - exact_mass) <= neutral * 20.0::double * 1e-6::double),
    s as (select feature, compound, ppm, 50.0::double * (0.98::double + 0.02::double * greatest(0, 1 - ppm / 20)) + (case when same then 20.0 else 0 end)::double + case when gap <= 3 then 12.0::double * (0.85::double + 0.15::double * greatest(0, 1 - gap / 3)) else 0 end as score from p)"""

ORACLES = {
    "feature_candidates": f"with {_SCORED} select feature, compound, round(ppm, 3) as ppm, round(score, 4) as score from s",
    "settled_features": f"""
        with {_SCORED}, r as (select feature, compound, round(score, 4) as s, row_number() over (partition by feature order by round(score, 4) desc, compound desc) as rn, count(*) over (partition by feature) as n_uids from s),
        w as (select a.feature, a.compound, a.s as top, b.s as second, a.n_uids from r a left join r b on a.feature = b.feature and b.rn = 2 where a.rn = 1)
        select feature, case when top >= 60 and (second is null or top - second >= 15) then 'matched' else 'ambiguous' end as status, case when top >= 60 and (second is null or top - second >= 15) then compound end as compound, n_uids from w""",
    "context_filtered": """
        with t as (select distinct signature_id, lower(coalesce(context_terms, '')) as t, confidence from cell_type_signatures), f as (select *, case when trim(t, ' ') = '' then 'unknown' when regexp_matches(t, 'late|early') then 'match' else 'mismatch' end as context_fit from t)
        select signature_id, context_fit, case when context_fit = 'mismatch' then confidence * 0.5::double else confidence end as confidence from f""",
    "theme_coverage": "with t as (select distinct signature_id, lower(coalesce(pathway_terms, '')) as t from cell_type_signatures) "
    + " union all ".join(
        f"select '{k}' as theme, count(*) filter ({' or '.join(f'contains(t, {chr(39)}{x}{chr(39)})' for x in ts)}) as n_rows, ({' + '.join(f'coalesce(bool_or(contains(t, {chr(39)}{x}{chr(39)})), false)::bigint' for x in ts)})::bigint as n_terms, "
        f"({' + '.join(f'coalesce(bool_or(contains(t, {chr(39)}{x}{chr(39)})), false)::bigint' for x in ts)}) >= 2 as passed from t"
        for k, ts in THEMES.items()
    ),
}
