"""Resolution of names, identifiers and masses over the compound tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.keys import folded_key
from lodegraph.operators import resolve as R
from lodegraph.operators.ordering import staged_queue
from lodegraph.operators.resolve import LookupSpec
from lodegraph.queries.sql_folding import folded
from lodegraph.runtime import table

C = F.col
SPECS = (
    LookupSpec("metabolite_uid", "metabolite", "label", "TEXT", 100),
    LookupSpec("metabolite_uid", "metabolite", "short_code", "TEXT", 80),
    LookupSpec("metabolite_uid", "metabolite", "inchikey", "INCHIKEY", 95),
)


def _index(spark, d):
    return R.lookup_index(table(spark, d, "metabolite_gold_labels"), SPECS)


def _cases(spark, d):
    return table(spark, d, "name_only_cases").select("case_id", "input_name").dropDuplicates(["case_id"])


def lookup_index(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).select("entity_uid", "namespace", "lookup_key", "match_field", "rank", "raw_value")


def query_expansion(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "metabolite_gold_labels").filter("inchikey is not null").select(C("label_id").alias("case_id"), C("inchikey").alias("input_name"))
    xrefs = table(spark, d, "chemical_xrefs").select(F.lit(0).cast("long").alias("case_id"), F.trim("xref_id").alias("input_name")).distinct()
    return R.expand_queries(ids.unionByName(xrefs), "case_id", "input_name")


def resolve_ranked(spark: SparkSession, d: str) -> DataFrame:
    return R.resolve(R.expand_queries(_cases(spark, d), "case_id", "input_name"), "case_id", _index(spark, d), 5)


def _bare_index(spark, d):
    """Stems without their form markers, which several labels share."""
    t = table(spark, d, "metabolite_gold_labels").select("metabolite_uid", folded_key(C("label")).alias("k"))
    full = t.select("k", C("metabolite_uid").alias("uid"), F.lit(1.0).alias("score"))
    bare = t.select(F.regexp_replace("k", "^(l|d|alpha|beta)-| [0-9:]+$", "").alias("k"), C("metabolite_uid").alias("uid"), F.lit(0.8).alias("score"))
    return full.unionByName(bare)


def _settled(spark, d):
    asks = _cases(spark, d).select("case_id", folded_key(C("input_name")).alias("k"))
    return R.settle(asks.join(_bare_index(spark, d), "k"), "case_id", "uid", "score", 0.6, 0.12)


def ambiguity_margin(spark: SparkSession, d: str) -> DataFrame:
    return _settled(spark, d)


def precheck_buckets(spark: SparkSession, d: str) -> DataFrame:
    return R.precheck(_cases(spark, d).withColumn("input_name", folded_key(C("input_name"))), "case_id", "input_name", _settled(spark, d))


def name_risk(spark: SparkSession, d: str) -> DataFrame:
    """Titles are canonical names of rank 100, synonyms rank by their place; the authority is a title."""
    c = table(spark, d, "cid_properties").select("pubchem_cid", "title", "synonyms")
    titles = c.select("pubchem_cid", C("title").alias("raw"), F.lit("canonical_name").alias("field"), F.lit(100).alias("rank"))
    others = c.select("pubchem_cid", F.posexplode("synonyms").alias("rank", "raw")).select("pubchem_cid", "raw", F.lit("synonym").alias("field"), (80 - C("rank")).alias("rank"))
    index = titles.unionByName(others).filter("raw is not null").select("*", folded_key(C("raw")).alias("name"), (C("field") == "canonical_name").alias("known"))
    out = R.name_risk(index, "name", "pubchem_cid", "raw", "field", "rank", "known")
    return out.withColumn("risk_reasons", F.array_join("risk_reasons", ";"))


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    risk = name_risk(spark, d)
    order = [F.desc("risk_score"), F.asc("name")]
    return staged_queue(risk, "name", [
        ("block", C("policy") == "auto_abstain_name_only", order, 5), ("shared", C("n_uids") > 1, order, 20), ("lipid", C("risk_reasons").contains("lipid"), order, 15),
        ("stereo", C("risk_reasons").contains("synonym_only"), order, 15), ("any", F.lit(True), order, 10),
    ]).select("name", "stage", "risk_score")


def mass_tolerance(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "cid_properties").filter("exact_mass is not null").select("pubchem_cid", "exact_mass").distinct()
    # what a positive ion of each compound would show
    seen = t.select(C("pubchem_cid").alias("feature"), (C("exact_mass") + 1.007276 - 1.007276 + 0.0004).alias("mass"))
    out = R.tolerance_join(seen, "mass", t, "exact_mass", C("mass") * 10e-6, 0.01)
    return out.select("feature", "pubchem_cid", F.round((C("mass") - C("exact_mass")) / C("exact_mass") * 1e6, 3).alias("ppm"))


def price_window(spark: SparkSession, d: str) -> DataFrame:
    """A window join on retention-like values: parts of nearly the same price and size."""
    p = table(spark, d, "part")
    a = p.select(C("p_partkey").alias("a"), C("p_retailprice").alias("x"))
    b = p.select(C("p_partkey").alias("b"), C("p_retailprice").alias("y"))
    return R.value_join(a, "x", b, "y", 0.25).filter("a < b").select("a", "b")


def _peaks(spark, d, name):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("v", C("v").cast("double"))
    shift = F.when(F.lit(name == "query"), F.pmod("vec_id", F.lit(3)) * 0.004).otherwise(0.0)
    return e.select(C("vec_id").alias(name), (100 + C("i") * 8 + F.round(F.abs("v") * 50, 1) + shift).alias("mz"), (1 + F.pmod(C("vec_id") + C("i"), F.lit(9))).cast("double").alias("intensity"))


def spectrum_match(spark: SparkSession, d: str) -> DataFrame:
    """The ten best entries of every twentieth spectrum, with all peaks of both sides."""
    out = R.spectrum_scores(_peaks(spark, d, "query").filter("query % 20 = 0"), _peaks(spark, d, "entry"), 0.01, 10)
    return out.select("query", "entry", "n_shared", F.round("cosine", 6).alias("cosine"))


def first_xref_hit(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "cid_properties").filter("synonyms is not null").select("pubchem_cid", F.transform("synonyms", lambda s: F.lower(s)).alias("keys")).dropDuplicates(["pubchem_cid"])
    index = table(spark, d, "cid_properties").filter("title is not null").select(F.concat(F.lower("title"), F.lit("s")).alias("lookup_key"), C("pubchem_cid").alias("uid")).distinct()
    return R.first_key_hit(t, "pubchem_cid", "keys", index)


def expanded_seeds(spark: SparkSession, d: str) -> DataFrame:
    s = _bare_index(spark, d).join(_cases(spark, d).select("case_id", folded_key(C("input_name")).alias("k")), "k")
    kinds = s.select("case_id", "uid", F.when(C("score") == 1.0, "matched").otherwise("soft").alias("kind"))
    best = kinds.groupBy("case_id", "uid").agg(F.min("kind").alias("kind"))
    out = R.expand_seeds(best, "case_id", "uid", "kind")
    return out.select("case_id", "uid", F.round("seed_weight", 6).alias("seed_weight"))


def cid_cache(spark: SparkSession, d: str) -> DataFrame:
    """Properties of the compounds that are referred to, with their first five synonyms."""
    wanted = table(spark, d, "chemical_xrefs").filter("upper(trim(xref_source)) = 'PCID'").select(F.regexp_replace("xref_id", "[^0-9]", "").alias("n")).distinct()
    props = table(spark, d, "cid_properties").dropDuplicates(["pubchem_cid"])
    kept = props.withColumn("n", (C("pubchem_cid").cast("long") - 1000000).cast("string")).join(wanted, "n", "left_semi")
    return kept.select("pubchem_cid", "title", F.array_join(F.slice(F.array_compact("synonyms"), 1, 5), "|").alias("synonyms"))


def folded_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cid_properties").filter("title is not null").select("pubchem_cid", folded_key(C("title")).alias("title_key")).distinct()


QUERIES = {f.__name__: f for f in (
    lookup_index, query_expansion, resolve_ranked, ambiguity_margin, precheck_buckets, name_risk, review_queue, mass_tolerance, price_window,
    spectrum_match, first_xref_hit, expanded_seeds, cid_cache, folded_titles,
)}

_KEY = "lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"
_INDEX = f"""
    i0 as (select metabolite_uid as entity_uid, 'TEXT' as namespace, {_KEY.format(x="label")} as lookup_key, 'label' as match_field, 100 as rank, label as raw_value from metabolite_gold_labels
      union all select metabolite_uid, 'TEXT', {_KEY.format(x="short_code")}, 'short_code', 80, short_code from metabolite_gold_labels where short_code is not null
      union all select metabolite_uid, 'INCHIKEY', lower(inchikey), 'inchikey', 95, inchikey from metabolite_gold_labels where inchikey is not null),
    idx as (select entity_uid, namespace, lookup_key, match_field, max(rank)::int as rank, min(raw_value) as raw_value from i0 group by 1, 2, 3, 4)"""
_CASES = f"cases as (select distinct case_id, input_name, {folded('input_name')} as asked from name_only_cases)"
_BARE = f"""
    t as (select metabolite_uid as uid, {_KEY.format(x="label")} as k from metabolite_gold_labels),
    bare as (select k, uid, 1.0::double as score from t union all select regexp_replace(k, '^(l|d|alpha|beta)-| [0-9:]+$', '', 'g'), uid, 0.8::double from t),
    c as (select case_id, uid, max(score) as s from cases join bare on asked = k group by 1, 2),
    o as (select *, row_number() over (partition by case_id order by s desc, uid desc) as rn, count(*) over (partition by case_id) as n_uids from c),
    w as (select a.case_id, a.uid, a.s as top, b.s as second, a.n_uids from o a left join o b on a.case_id = b.case_id and b.rn = 2 where a.rn = 1),
    settled as (select case_id, case when top >= 0.6 and (second is null or top - second >= 0.12) then 'matched' else 'ambiguous' end as status,
      case when top >= 0.6 and (second is null or top - second >= 0.12) then uid end as uid, top, second, n_uids from w)"""
_RISK = f"""
    x as (select pubchem_cid, title as raw, true as canonical, 100 as rank from cid_properties union all select pubchem_cid, synonyms[i + 1], false, 80 - i from cid_properties, range(200) t(i) where i < len(synonyms)),
    n as (select {folded("raw")} as name, count(distinct pubchem_cid) as n_uids, min(raw) as raw, bool_or(canonical) as canonical, min(rank) as rank from x where raw is not null group by 1),
    f as (select *, n_uids > 1 as m, contains(raw, ',') as de, regexp_matches(raw, '\\b([a-zA-Z]{{1,4}}\\s*)?[0-9]{{1,2}}:[0-9](/[0-9]{{1,2}}:[0-9])?\\b|d[0-9]{{1,2}}:[0-9]/[0-9]{{1,2}}:[0-9]') as li,
      replace(name, '-', ' ') in ('aconitate', '2 hydroxyglutarate', 'xanthine', 'sorbitol', 'butyrylcarnitine', 'free carnitine', 'asymmetric dimethylarginine') as st,
      replace(name, '-', ' ') in ('acid', 'base', 'salt', 'unknown', 'lipid', 'ceramide', 'hexose', 'pentose', 'sugar', 'protein', 'peptide') or length(regexp_replace(name, '[^a-z0-9]', '', 'g')) <= 3 as br,
      not canonical and rank <= 70 as lo from n),
    r as (select name, n_uids, concat_ws(';', case when m then 'name_maps_to_multiple_metabolites' end, case when de then 'delimiter_sensitive_name' end, case when li then 'lipid_shorthand_or_chain_notation' end,
        case when st then 'stereo_or_isomer_under_specified' end, case when br then 'broad_or_short_surface' end, case when lo then 'synonym_only_low_rank_surface' end) as risk_reasons,
      (m::int * 35 + st::int * 35 + li::int * 30 + de::int * 20 + br::int * 20 + lo::int * 10 + case when n_uids > 2 then least(30, 3 * n_uids) else 0 end + case when canonical then 0 else 15 end)::bigint as risk_score,
      case when st then 'require_specific_isomer_or_identifier' when m and li then 'require_lipid_identifier' when m then 'manual_review_required' when de then 'quote_delimiter_sensitive_name' when li then 'prefer_lipid_identifier'
        when br then 'avoid_broad_surface' else 'review' end as action, li from f),
    risk as (select name, n_uids, risk_reasons, risk_score, action, case when action in ('require_specific_isomer_or_identifier', 'require_lipid_identifier', 'manual_review_required', 'avoid_broad_surface') then 'auto_abstain_name_only'
      when li then 'requires_identifier_or_orthogonal_feature' when action = 'quote_delimiter_sensitive_name' then 'format_warning' when risk_score >= 70 then 'auto_abstain_name_only'
      when risk_score >= 35 then 'monitor_or_downweight' else 'monitor' end as policy from r)"""
_STAGES = (("block", "policy = 'auto_abstain_name_only'", 5), ("shared", "n_uids > 1", 20), ("lipid", "risk_reasons like '%lipid%'", 15), ("stereo", "risk_reasons like '%synonym_only%'", 15), ("any", "true", 10))
_QUEUE = ",".join(
    f" s{i} as (select name, '{n}' as stage, risk_score from risk where {c}" + "".join(f" and name not in (select name from s{j})" for j in range(i)) + f" order by risk_score desc, name limit {q})"
    for i, (n, c, q) in enumerate(_STAGES)
)

ORACLES = {
    "lookup_index": f"with {_INDEX} select * from idx",
    "query_expansion": """
        with t as (select label_id as case_id, inchikey as input_name from metabolite_gold_labels where inchikey is not null union all select distinct 0, trim(xref_id, ' ') from chemical_xrefs)
        select case_id, 'INCHIKEY' as namespace, lower(input_name) as lookup_key, 120 as priority from t where regexp_full_match(input_name, '[A-Z]{14}-[A-Z]{10}-[A-Z]')
        union all select case_id, upper(regexp_extract(input_name, '^([A-Za-z.]+):', 1)), replace(lower(input_name), '_', ':'), 100 from t where regexp_full_match(input_name, '[A-Za-z.]+:[^ ]+')
        union all select case_id, 'CID', input_name, 60 from t where regexp_full_match(input_name, '[0-9]+')
        union all select case_id, 'TEXT', lower(regexp_replace(input_name, '\\s+', ' ', 'g')), 10 from t where input_name <> ''""",
    "resolve_ranked": f"""
        with {_INDEX}, {_CASES},
        h as (select case_id, entity_uid, raw_value, rank, row_number() over (partition by case_id, entity_uid order by rank desc, raw_value) as rn
              from cases join idx on namespace = 'TEXT' and lookup_key = asked),
        p as (select *, (row_number() over (partition by case_id order by rank desc, entity_uid, raw_value))::int as place from h where rn = 1)
        select case_id, place, entity_uid, 'metabolite' as entity_type, raw_value, (10 + rank)::int as score from p where place <= 5""",
    "ambiguity_margin": f"with {_CASES}, {_BARE} select case_id, status, uid, top, second, n_uids from settled",
    "precheck_buckets": f"""
        with {_CASES}, {_BARE}
        select case_id, case when asked is null or length(asked) < 2 then 'invalid' when status is null then 'unmatched' else status end as bucket from cases left join settled using (case_id)""",
    "name_risk": f"with {_RISK} select * from risk",
    "review_queue": f"with {_RISK},{_QUEUE} " + " union all ".join(f"select * from s{i}" for i in range(len(_STAGES))),
    "mass_tolerance": """
        with t as (select distinct pubchem_cid, exact_mass from cid_properties where exact_mass is not null), f as (select pubchem_cid as feature, exact_mass + 1.007276::double - 1.007276::double + 0.0004::double as mass from t)
        select feature, pubchem_cid, round((mass - exact_mass) / exact_mass * 1e6::double, 3) as ppm from f join t on abs(mass - exact_mass) <= mass * 10e-6::double""",
    "price_window": "select a.p_partkey as a, b.p_partkey as b from part a join part b on abs(a.p_retailprice - b.p_retailprice) <= 0.25 and a.p_partkey < b.p_partkey",
    "expanded_seeds": f"""
        with {_CASES}, {_BARE} select case_id, uid, round((case when s = 1.0 then 1.0 else 0.5 end)::double / n_uids, 6) as seed_weight from o""",
    "spectrum_match": f"""
        with q as (select vec_id as query, round(100 + i * 8 + round(abs(embedding[i + 1]::double) * 50, 1), 6) + (vec_id % 3) * 0.004::double as mz, sqrt((1 + (vec_id + i) % 9)::double) as a
                   from embeddings, range(64) t(i) where vec_id % 20 = 0),
             e as (select vec_id as entry, 100 + i * 8 + round(abs(embedding[i + 1]::double) * 50, 1) as mz, sqrt((1 + (vec_id + i) % 9)::double) as b from embeddings, range(64) t(i)),
             p as (select query, entry, q.mz, a, b, row_number() over (partition by query, entry, q.mz, a order by abs(q.mz - e.mz), e.mz, b) as rn from q join e on abs(q.mz - e.mz) <= 0.01),
             dot as (select query, entry, count(*) as n_shared, sum(a * b) as dot from p where rn = 1 group by 1, 2)
        select query, entry, n_shared, round(dot / (sqrt(na) * sqrt(nb)), 6) as cosine from dot
        join (select query, sum(a * a) as na from q group by 1) using (query) join (select entry, sum(b * b) as nb from e group by 1) using (entry)
        qualify row_number() over (partition by query order by round(dot / (sqrt(na) * sqrt(nb)), 9) desc, entry) <= 10""",
    "folded_titles": f"select distinct pubchem_cid, {folded('title')} as title_key from cid_properties where title is not null",
    "first_xref_hit": """
        with k as (select pubchem_cid, i - 1 as place, lower(synonyms[i]) as lookup_key from (select *, unnest(range(1, len(synonyms) + 1)) as i from (select distinct pubchem_cid, synonyms from cid_properties where synonyms is not null))),
        x as (select lower(title) || 's' as lookup_key, min(pubchem_cid) as uid from cid_properties where title is not null group by 1)
        select pubchem_cid, arg_min(uid, place) as uid, min(place)::int as place from k join x using (lookup_key) group by 1""",
    "cid_cache": """
        with w as (select distinct regexp_replace(xref_id, '[^0-9]', '', 'g') as n from chemical_xrefs where upper(trim(xref_source, ' ')) = 'PCID')
        select distinct pubchem_cid, title, array_to_string(list_filter(synonyms, lambda x: x is not null)[1:5], '|') as synonyms from cid_properties where (pubchem_cid::bigint - 1000000)::varchar in (select n from w)""",
}
