"""Indexes of compounds by structure key, formula and mass, and measured features that are attached to them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.keys import hill_formula, id_token, inchikey_block, stable_uid_sha1, to_float
from lodegraph.runtime import fresh
from lodegraph.sources.blocks import parse_peaks


def inchikey_index(df: DataFrame, uid: str, inchikey: str, field: str, rank: float) -> DataFrame:
    """lookup_uid, uid, inchikey, connectivity_key, raw_value, match_field, rank of the well-formed InChIKeys of a table; repeats once."""
    raw = F.trim(inchikey)
    key = F.upper(id_token(raw))
    rows = df.select(F.col(uid).cast("string").alias("uid"), raw.alias("raw_value"), key.alias("inchikey")).filter("uid <> ''").filter(key.rlike("^[A-Z0-9]{14}-[A-Z0-9]{10}-[A-Z0-9]$"))
    marked = rows.select(
        stable_uid_sha1("compound_inchikey_lookup", F.col("uid"), F.col("inchikey"), F.lit(field)).alias("lookup_uid"), "uid", "inchikey", inchikey_block(F.col("inchikey")).alias("connectivity_key"), "raw_value",
        F.lit(field).alias("match_field"), F.lit(float(rank)).alias("rank"),
    )
    return marked.dropDuplicates(["lookup_uid"])


def formula_mass_index(df: DataFrame, uid: str, formula: str, mass: str, field: str, rank: float) -> DataFrame:
    """lookup_uid, uid, formula, formula_key (Hill order), exact_mass, mass_mda_bucket (thousandths, half to even), match_field, rank.

    Rows without a uid or a positive mass are left out; a missing formula is ''.
    """
    value = to_float(F.col(mass).cast("string"))
    rows = df.select(F.col(uid).cast("string").alias("uid"), F.coalesce(formula, F.lit("")).alias("formula"), value.alias("exact_mass")).filter("uid <> '' and exact_mass > 0")
    keyed = rows.withColumn("formula_key", hill_formula(F.col("formula")))
    marked = keyed.select(
        stable_uid_sha1("compound_formula_mass_lookup", F.col("uid"), F.col("formula_key"), F.format_string("%.8f", "exact_mass"), F.lit(field)).alias("lookup_uid"), "uid", "formula", "formula_key", "exact_mass",
        F.rint(F.col("exact_mass") * 1000).cast("long").alias("mass_mda_bucket"), F.lit(field).alias("match_field"), F.lit(float(rank)).alias("rank"),
    )
    return marked.dropDuplicates(["lookup_uid"])


def attached(rows: DataFrame, key: str, ids: Mapping[str, str], resolver: DataFrame) -> DataFrame:
    """rows with uid and status: resolved by exactly one compound, ambiguous, or unresolved.

    ids: column -> namespace of the identifiers that a row may have; all that are
    given are looked up together.  resolver: namespace, lookup_key, uid.  key
    identifies a row; its name and those of other columns may clash with nothing
    here.
    """
    cells = [F.struct(F.lit(space).alias("namespace"), id_token(F.col(c).cast("string")).alias("lookup_key")) for c, space in ids.items()]
    asks = rows.select(F.col(key).alias("_key"), F.inline(F.array(*cells))).filter("lookup_key <> ''").distinct()
    found = asks.join(resolver.select("namespace", "lookup_key", F.col("uid").alias("_uid")).distinct(), ["namespace", "lookup_key"])
    per = found.groupBy("_key").agg(F.min("_uid").alias("_least"), F.max("_uid").alias("_most"))
    uid, status = fresh(rows, "uid", "status")
    kind = F.when(F.col("_least").isNull(), "unresolved").when(F.col("_least") == F.col("_most"), "resolved").otherwise("ambiguous")
    joined = rows.join(per, rows[key].eqNullSafe(per["_key"]), "left")
    return joined.select(*[rows[c] for c in rows.columns], F.when(kind == "resolved", F.col("_least")).alias(uid), kind.alias(status))


def method_key(c: Column) -> Column:
    """A method's name in comparable form; `default` without one."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_")), F.lit("")), F.lit("default"))


def rt_index(rows: DataFrame, rt: str, unit: str | None = None, method: str | None = None) -> DataFrame:
    """lookup_uid, uid, rt, rt_unit, method_key of attached rows with a retention time; repeats once."""
    time = to_float(F.col(rt).cast("string"))
    m = method_key(F.col(method)) if method else F.lit("default")
    u = F.coalesce(F.nullif(F.col(unit), F.lit("")), F.lit("min")) if unit else F.lit("min")
    out = rows.filter("status = 'resolved'").select("uid", time.alias("rt"), u.alias("rt_unit"), m.alias("method_key")).filter("rt is not null")
    return out.select(stable_uid_sha1("compound_rt_lookup", F.col("uid"), F.col("method_key"), F.format_string("%.6f", "rt")).alias("lookup_uid"), "*").dropDuplicates(["lookup_uid"])


def ms2_index(rows: DataFrame, record: str, precursor: str, peaks: str, adduct: str | None = None, mode: str | None = None) -> DataFrame:
    """lookup_uid, uid, record, precursor_mz, adduct, ion_mode, fragment_mz, fragment_intensity: a row for each peak of attached records.

    peaks: `mz:intensity` tokens, or an array of (mz, intensity).
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c else F.lit("")
    each = F.col(peaks) if dict(rows.dtypes)[peaks].startswith("array") else parse_peaks(F.col(peaks))
    out = rows.filter("status = 'resolved'").select(
        "uid", F.col(record).cast("string").alias("record"), to_float(F.col(precursor).cast("string")).alias("precursor_mz"), text(adduct).alias("adduct"), text(mode).alias("ion_mode"), F.inline(each).alias("fragment_mz", "fragment_intensity")
    )
    return out.select(stable_uid_sha1("compound_ms2_lookup", F.col("uid"), F.col("record"), F.format_string("%.6f", "fragment_mz")).alias("lookup_uid"), "*").dropDuplicates(["lookup_uid"])


def import_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    """status, n_rows of attached rows."""
    return rows.groupBy(status).agg(F.count("*").alias("n_rows"))
