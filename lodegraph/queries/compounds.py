"""Compound indexes over the properties of compounds, and features attached by identifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators import compounds as X
from lodegraph.runtime import table

C = F.col


def inchikey_index(spark: SparkSession, d: str) -> DataFrame:
    return X.inchikey_index(table(spark, d, "cid_properties"), "pubchem_cid", "inchikey", "inchikey", 95)


def formula_mass_index(spark: SparkSession, d: str) -> DataFrame:
    out = X.formula_mass_index(table(spark, d, "cid_properties"), "pubchem_cid", "formula", "exact_mass", "exact_mass", 90)
    return out.select("uid", "formula", "exact_mass", "mass_mda_bucket", "match_field", "rank")


def _attached(spark, d):
    """Labels without their form marker as measured features: found by InChIKey or by name, with or without the marker."""
    labels = table(spark, d, "metabolite_gold_labels")
    bare = F.regexp_replace(F.regexp_replace(F.lower("label"), r"\s+", ""), "^(d|l|alpha|beta)-", "")
    named = lambda key: labels.select(F.lit("NAME").alias("namespace"), key.alias("lookup_key"), C("metabolite_uid").alias("uid"))
    keys = labels.filter("inchikey is not null").select(F.lit("INCHIKEY").alias("namespace"), F.lower("inchikey").alias("lookup_key"), C("metabolite_uid").alias("uid"))
    rows = labels.select("label_id", F.when(C("label_id") % 3 == 0, C("inchikey")).alias("inchikey"), F.when(C("label_id") % 5 > 0, bare).alias("name"), (C("label_id") % 97 / 8).alias("rt"))
    return X.attached(rows, "label_id", {"inchikey": "INCHIKEY", "name": "NAME"}, keys.unionByName(named(bare)))


def attached_features(spark: SparkSession, d: str) -> DataFrame:
    return X.import_counts(_attached(spark, d))


def rt_index(spark: SparkSession, d: str) -> DataFrame:
    rows = _attached(spark, d).withColumn("method", F.lit("HILIC (pos)"))
    return X.rt_index(rows, "rt", None, "method").select("uid", F.round("rt", 6).alias("rt"), "rt_unit", "method_key")


QUERIES = {f.__name__: f for f in (inchikey_index, formula_mass_index, attached_features, rt_index)}

_ATTACHED = """
    b as (select *, regexp_replace(regexp_replace(lower(label), '\\s+', '', 'g'), '^(d|l|alpha|beta)-', '') as bare from metabolite_gold_labels),
    h as (select label_id, metabolite_uid as uid from b where label_id % 3 = 0 and inchikey is not null and inchikey <> ''
      union select a.label_id, o.metabolite_uid from b a join b o using (inchikey) where a.label_id % 3 = 0 union select a.label_id, o.metabolite_uid from b a join b o on a.bare = o.bare where a.label_id % 5 > 0),
    n as (select label_id, count(distinct uid) as n, min(uid) as uid from h group by 1),
    a as (select b.label_id, label_id % 97 / 8 as rt, n.uid, case when n is null then 'unresolved' when n = 1 then 'resolved' else 'ambiguous' end as status from b left join n using (label_id))"""
ORACLES = {
    "inchikey_index": """
        with k as (select distinct pubchem_cid as uid, upper(trim(inchikey, ' ')) as inchikey, trim(inchikey, ' ') as raw_value from cid_properties)
        select 'compound_inchikey_lookup_' || left(sha1(uid || '|' || inchikey || '|inchikey'), 20) as lookup_uid, uid, inchikey, split_part(inchikey, '-', 1) as connectivity_key, raw_value, 'inchikey' as match_field, 95.0::double as rank
        from k where regexp_full_match(inchikey, '[A-Z0-9]{14}-[A-Z0-9]{10}-[A-Z0-9]')""",
    "formula_mass_index": """
        select distinct pubchem_cid as uid, coalesce(formula, '') as formula, exact_mass, round_even(exact_mass * 1000, 0)::bigint as mass_mda_bucket, 'exact_mass' as match_field, 90.0::double as rank from cid_properties where exact_mass > 0""",
    "attached_features": f"with {_ATTACHED} select status, count(*) as n_rows from a group by 1",
    "rt_index": f"with {_ATTACHED} select distinct uid, round(rt, 6) as rt, 'min' as rt_unit, 'hilic_pos' as method_key from a where status = 'resolved'",
}
