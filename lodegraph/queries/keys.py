"""Identifiers, buckets and normal forms over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions import keys as K
from lodegraph.runtime import table

C = F.col


def stable_uids(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "genes").select("record_id", "symbol", "taxon", "source_name").distinct()
    parts = (C("symbol"), C("taxon"), C("source_name"))
    return g.select("record_id", K.stable_uid_sha1("gene", *parts).alias("uid_sha1"), K.stable_uid_sha256("gene", *parts).alias("uid_sha256"))


def hash_buckets(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "sentence_mentions").select("entity_uid").distinct()
    b = {"bucket_100": (12, 100), "bucket_5": (8, 5), "bucket_10": (8, 10)}
    return m.select("entity_uid", *[K.hash_bucket(C("entity_uid"), *v).alias(k) for k, v in b.items()])


def lookup_keys(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "cell_type_signatures").select("signature_id", "cell_type_id", "cell_type_name").distinct()
    return t.select("signature_id", K.text_key(C("cell_type_name")).alias("text_key"), K.id_token(C("cell_type_id")).alias("id_token"), K.name_key(C("cell_type_name")).alias("name_key"))


def parsed_xrefs(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "chemical_xrefs").select("xref_id").distinct()
    return x.select("xref_id", K.parse_xref(C("xref_id")).alias("x")).select("xref_id", "x.*").filter("key is not null")


def prefixed_ids(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "cell_type_signatures").select("cell_type_id").distinct()
    made = t.select(F.explode(F.array(C("cell_type_id"), F.concat(F.lit("CL_"), F.regexp_replace("cell_type_id", "^.*:", "")), F.concat(F.lit("ENSG"), F.regexp_replace("cell_type_id", "^.*:", ""), F.lit(".7")))).alias("raw_id"))
    return made.select("raw_id", K.prefixed_id(C("raw_id")).alias("xref")).distinct()


def hill_formulas(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "cid_properties").select("formula").filter("formula is not null").distinct()
    # written out of order, with an element twice
    mixed = t.select("formula", F.concat(F.lit("O2"), C("formula"), F.lit("H")).alias("raw"))
    return mixed.select("formula", K.hill_formula(C("formula")).alias("hill"), K.hill_formula(C("raw")).alias("hill_mixed"))


def inchikey_blocks(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "metabolite_gold_labels").filter("inchikey is not null")
    return t.groupBy(K.inchikey_block(C("inchikey")).alias("block")).agg(F.count("*").alias("n_labels"))


def canonical_json(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "metabolite_gold_labels")
    return t.select("label_id", K.canonical_json({"label": C("label"), "formula": C("formula"), "code": C("short_code")}).alias("metadata_json"))


def deduped_aliases(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "genes").select("record_id", "aliases").filter("aliases is not null").distinct()
    return g.select("record_id", F.array_join(K.distinct_nonblank(C("aliases")), "|").alias("aliases"))


def safe_casts(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "chemical_xrefs").select("xref_id").distinct()
    return x.select("xref_id", K.to_int(C("xref_id")).alias("as_int"), K.to_float(C("xref_id")).alias("as_float"))


def publication_years(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.groupBy(K.publication_year(C("pub_date")).alias("pub_year")).agg(F.count("*").alias("n_documents"))


QUERIES = {
    "stable_uids": stable_uids, "hash_buckets": hash_buckets, "lookup_keys": lookup_keys, "parsed_xrefs": parsed_xrefs,
    "prefixed_ids": prefixed_ids, "hill_formulas": hill_formulas, "inchikey_blocks": inchikey_blocks, "canonical_json": canonical_json,
    "deduped_aliases": deduped_aliases, "safe_casts": safe_casts, "publication_years": publication_years,
}

_PAYLOAD = "concat_ws('|', nullif(trim(symbol), ''), nullif(trim(taxon), ''), nullif(trim(source_name), ''))"
_HILL = """(select string_agg(e || case when n = 1 then '' else n::varchar end, '' order by case e when 'C' then '0' when 'H' then '1' else '2' || e end)
  from (select regexp_extract(t, '^[A-Z][a-z]?') e, sum(coalesce(nullif(regexp_extract(t, '[0-9]+$'), ''), '1')::bigint)::bigint n
        from (select unnest(regexp_extract_all({x}, '[A-Z][a-z]?[0-9]*')) t) group by 1))"""

ORACLES = {
    "stable_uids": f"""
        select distinct record_id, 'gene_' || left(sha1({_PAYLOAD}), 20) as uid_sha1, 'gene_' || left(sha256({_PAYLOAD}), 20) as uid_sha256
        from (select distinct record_id, symbol, taxon, source_name from genes)""",
    "hash_buckets": """
        select entity_uid, ('0x' || left(sha256(entity_uid), 12))::bigint % 100 as bucket_100, ('0x' || left(sha256(entity_uid), 8))::bigint % 5 as bucket_5,
               ('0x' || left(sha256(entity_uid), 8))::bigint % 10 as bucket_10
        from (select distinct entity_uid from sentence_mentions)""",
    "lookup_keys": """
        select signature_id, lower(trim(regexp_replace(cell_type_name, '\\s+', ' ', 'g'))) as text_key,
               regexp_replace(replace(lower(trim(regexp_replace(cell_type_id, '\\s+', ' ', 'g'))), '_', ':'), '\\s+', '', 'g') as id_token,
               trim(regexp_replace(lower(cell_type_name), '[^a-z0-9]+', ' ', 'g')) as name_key
        from (select distinct signature_id, cell_type_id, cell_type_name from cell_type_signatures)""",
    "parsed_xrefs": """
        with t as (select distinct xref_id, trim(xref_id, ' ') as s from chemical_xrefs),
             p as (select xref_id, upper(trim(regexp_extract(s, '^([^:]+):', 1))) as source, trim(regexp_extract(s, '^[^:]+:(.*)$', 1)) as id from t)
        select xref_id, source, id, source || ':' || id as key from p where id <> ''""",
    "prefixed_ids": """
        with t as (select distinct cell_type_id from cell_type_signatures),
             r as (select cell_type_id as raw_id from t union select 'CL_' || regexp_replace(cell_type_id, '^.*:', '') from t
                   union select 'ENSG' || regexp_replace(cell_type_id, '^.*:', '') || '.7' from t)
        select distinct raw_id, case when raw_id like '%:%' then upper(split_part(raw_id, ':', 1)) || ':' || trim(split_part(raw_id, ':', 2))
               when raw_id like 'CL\\_%' escape '\\' then 'CL:' || substr(raw_id, 4)
               else 'ENSEMBL:' || split_part(raw_id, '.', 1) end as xref from r""",
    "hill_formulas": f"""
        with t as (select distinct formula, 'O2' || formula || 'H' as raw from cid_properties where formula is not null)
        select formula, {_HILL.format(x="formula")} as hill, {_HILL.format(x="raw")} as hill_mixed from t""",
    "inchikey_blocks": """
        select split_part(upper(inchikey), '-', 1) as block, count(*) as n_labels from metabolite_gold_labels where inchikey is not null group by 1""",
    "canonical_json": """
        select label_id, '{' || concat_ws(',', case when short_code is not null then '"code":"' || short_code || '"' end,
               case when formula is not null then '"formula":"' || formula || '"' end, case when label is not null then '"label":"' || label || '"' end) || '}' as metadata_json
        from metabolite_gold_labels""",
    "deduped_aliases": """
        with g as (select record_id, any_value(aliases) as aliases from genes where aliases is not null group by 1),
             e as (select record_id, trim(aliases[i]) as a, i from (select *, unnest(range(1, len(aliases) + 1)) as i from g)),
             f as (select record_id, a, min(i) as i from e where a is not null and a <> '' and a <> '-' group by 1, 2)
        select g.record_id, coalesce((select string_agg(a, '|' order by i) from f where f.record_id = g.record_id), '') as aliases from g""",
    "safe_casts": """
        with t as (select distinct xref_id, trim(xref_id) as s from chemical_xrefs)
        select xref_id, case when s ~ '^[0-9]+(\\.[0-9]+)?$' then trunc(s::double)::bigint end as as_int, case when s ~ '^[0-9]+(\\.[0-9]+)?$' then s::double end as as_float from t""",
    "publication_years": """
        select nullif(regexp_extract(pub_date, '\\b(18[0-9]{2}|19[0-9]{2}|20[0-9]{2}|2100)\\b', 1), '')::int as pub_year, count(*) as n_documents from documents group by 1""",
}
