"""Measured features against compounds: adduct masses, candidate scores, context filters and themes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.resolve import tolerance_join

# Molecules, charge and mass shift (in Da) of usual adducts.
ADDUCTS = {
    "[M+H]+": (1, 1, 1.007276), "[M+Na]+": (1, 1, 22.989218), "[M+K]+": (1, 1, 38.963158), "[M+NH4]+": (1, 1, 18.033823), "[M+2H]2+": (1, 2, 2.014552),
    "[2M+H]+": (2, 1, 1.007276), "[M-H]-": (1, 1, -1.007276), "[M+Cl]-": (1, 1, 34.969402), "[M+HCOO]-": (1, 1, 44.998201), "[M-2H]2-": (1, 2, -2.014552),
}
# Points of a candidate's parts: a mass at the edge of its window still has most of its points.
POINTS = {"mass": 50.0, "formula": 20.0, "rt": 12.0, "ms2": 18.0}


def neutral_mass(mz: Column, adduct: Column) -> Column:
    """The neutral mass of an ion; null for an unknown adduct."""
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in ADDUCTS.items() for x in (k, float(v[i]))]), adduct)
    return (mz * pick(1) - pick(2)) / pick(0)


def mass_candidates(features: DataFrame, compounds: DataFrame, bucket: float = 0.01) -> DataFrame:
    """features x compounds within each feature's ppm window, with ppm (absolute).

    features: feature, mz, adduct, ppm_tolerance, ...; compounds: compound, mass, ...
    """
    f = features.withColumn("neutral", neutral_mass(F.col("mz"), F.col("adduct"))).filter("neutral is not null")
    pairs = tolerance_join(f, "neutral", compounds, "mass", F.col("neutral") * F.col("ppm_tolerance") * 1e-6, bucket)
    return pairs.withColumn("ppm", F.abs(F.col("neutral") - F.col("mass")) / F.col("mass") * 1e6)


def candidate_score(ppm: Column, tolerance: Column, same_formula: Column, rt_gap: Column, rt_tolerance: Column, cosine: Column) -> Column:
    """The sum of the points for mass, formula, retention time and fragments; a part that wasn't measured has none."""
    near = lambda gap, width: F.greatest(F.lit(0.0), 1 - gap / width)
    return (
        POINTS["mass"] * (0.98 + 0.02 * near(ppm, tolerance))
        + F.when(same_formula, POINTS["formula"]).otherwise(0.0)
        + F.when(rt_gap <= rt_tolerance, POINTS["rt"] * (0.85 + 0.15 * near(rt_gap, rt_tolerance))).otherwise(0.0)
        + F.when(cosine.isNotNull(), POINTS["ms2"] * cosine).otherwise(0.0)
    )


def context_filter(rows: DataFrame, column: str, wanted: Sequence[str], score: str, hard: bool = False, mismatch: float = 0.5) -> DataFrame:
    """rows with context_fit (match, unknown, mismatch) and the score lowered for a mismatch, or without mismatches."""
    low = F.lower(F.coalesce(F.col(column), F.lit("")))
    fit = F.when(F.trim(low) == "", "unknown").when(low.rlike("|".join(w.lower() for w in wanted)) if wanted else F.lit(True), "match").otherwise("mismatch")
    out = rows.withColumn("context_fit", fit)
    if hard:
        return out.filter("context_fit <> 'mismatch'")
    return out.withColumn(score, F.when(F.col("context_fit") == "mismatch", F.col(score) * mismatch).otherwise(F.col(score)))


def theme_coverage(rows: DataFrame, text: str, themes: Mapping[str, Sequence[str]], least: int = 2) -> DataFrame:
    """theme, n_rows, n_terms (different terms that occur), passed: rows that mention a theme's terms, and whether enough terms do."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    cells = F.array_compact(F.array(*[F.when(low.contains(t.lower()), F.struct(F.lit(k).alias("theme"), F.lit(t).alias("term"))) for k, ts in themes.items() for t in ts]))
    ident = rows.withColumn("_row", F.monotonically_increasing_id()).select("_row", F.inline(cells))
    found = ident.groupBy("theme").agg(F.count_distinct("_row").alias("n_rows"), F.count_distinct("term").alias("n_terms"))
    every = rows.sparkSession.createDataFrame([(k,) for k in themes], "theme string")
    out = every.join(F.broadcast(found), "theme", "left").na.fill(0, ["n_rows", "n_terms"])
    return out.withColumn("passed", F.col("n_terms") >= least)
