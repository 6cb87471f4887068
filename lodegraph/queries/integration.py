"""Records of several sources brought together, and decisions on their identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.keys import folded_key, publication_year
from lodegraph.functions.values import bare_number
from lodegraph.operators import identity as D
from lodegraph.operators import integration as I
from lodegraph.queries.sql_folding import folded
from lodegraph.runtime import table

C = F.col


def _source(spark, d, name):
    g = table(spark, d, "genes").filter(C("source_name") == name).filter("ensembl_gene_id is not null")
    return g.groupBy("ensembl_gene_id").agg(F.min("symbol").alias("symbol"), F.min("description").alias("description"))


def merged_genes(spark: SparkSession, d: str) -> DataFrame:
    return I.merge_sources(_source(spark, d, "gene_info"), _source(spark, d, "gtf_genes"), "ensembl_gene_id", ["symbol", "description"])


def _ids(spark, d, source):
    x = table(spark, d, "chemical_xrefs").filter((F.upper(F.trim("xref_source")) == source) & (C("xref_type") == "exact"))
    return x.select("chemical_uid", F.upper(F.trim("xref_id")).alias("id")).filter("id rlike '[0-9]'").distinct()


def propagated_links(spark: SparkSession, d: str) -> DataFrame:
    a, b = _ids(spark, d, "CHX"), _ids(spark, d, "PCID")
    links = a.join(b.withColumnRenamed("id", "right"), "chemical_uid").select(C("id").alias("left"), "right")
    anchors = a.select(C("id").alias("key"), C("chemical_uid").alias("uid")).filter("key like '%7%'").unionByName(b.select(C("id").alias("key"), C("chemical_uid").alias("uid")).filter("key like '%3%'"))
    return I.propagate_links(links, anchors)


def fallback_uids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_partkey").distinct()
    known = table(spark, d, "part").filter("p_size <= 25").select("p_partkey", F.concat(F.lit("part:"), "p_partkey").alias("u"))
    return I.uid_or_hash(rows, "l_partkey", known, "p_partkey", "u", "part")


def unversioned_ids(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "chemical_xrefs").filter("xref_id is not null").select(I.strip_version(C("xref_id")).alias("accession"))
    return x.groupBy("accession").agg(F.count("*").alias("n_rows"))


def reaction_components(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "cid_properties").filter("formula is not null and title is not null").select("pubchem_cid", F.concat("formula", F.lit(".H2O>>"), "title", F.lit("."), "formula").alias("smiles")).distinct()
    return I.reaction_components(t, "pubchem_cid", "smiles")


def bridged_identities(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "metabolite_gold_labels")
    index = labels.select(F.lit("INCHIKEY").alias("namespace"), C("inchikey").alias("id"), C("metabolite_uid").alias("uid")).unionByName(
        labels.select(F.lit("NAME").alias("namespace"), F.lower("label").alias("id"), C("metabolite_uid").alias("uid"))
    ).filter("id is not null")
    cases = table(spark, d, "name_only_cases").select("case_id", "input_name").distinct()
    keyed = cases.join(labels.select(C("label_id").alias("case_id"), "inchikey"), "case_id", "left").withColumn("inchikey", F.when(C("case_id") % 3 == 0, C("inchikey")))
    return I.bridge_identities(keyed.withColumn("name", F.lower(F.trim("input_name"))), "case_id", index, [("inchikey", "INCHIKEY"), ("name", "NAME")])


def inherited_edges(spark: SparkSession, d: str) -> DataFrame:
    related = table(spark, d, "chemical_xrefs").filter("xref_type = 'class'").select("chemical_uid", F.upper(F.trim("xref_source")).alias("predicate"), F.trim("xref_id").alias("object")).filter("object rlike '[0-9]'")
    # chemicals of one identifier are the same as its first one, so that links grow with the rows
    a = _ids(spark, d, "PCID").unionByName(_ids(spark, d, "MDB"))
    first = a.join(a.groupBy("id").agg(F.min("chemical_uid").alias("first")), "id").filter("chemical_uid <> first").select("chemical_uid", "first")
    same = first.select(C("chemical_uid").alias("uid"), C("first").alias("other")).unionByName(first.select(C("first").alias("uid"), C("chemical_uid").alias("other")))
    return I.inherit_edges(same, related, "chemical_uid")


def article_years(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "sentence_mentions").select("article_uid", bare_number(C("pmid")).alias("pmid")).filter("article_uid is not null").groupBy("article_uid").agg(F.min("pmid").alias("pmid"))
    docs = table(spark, d, "documents").select("article_uid", bare_number(C("pmid")).cast("string").alias("pmid"), publication_year(C("pub_date")).alias("year")).filter("year is not null")
    index = docs.select(C("article_uid").alias("token"), "year").unionByName(docs.select(C("pmid").alias("token"), "year")).filter("token is not null")
    return I.lookup_by_any(m, "article_uid", ["article_uid", "pmid"], index, "year")


def regrouped_features(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "cid_properties").select("pubchem_cid", "metabolite_uids").dropDuplicates(["pubchem_cid"])
    f = table(spark, d, "sentence_mentions").groupBy("entity_uid").agg(F.max("resolution_confidence").alias("score"))
    out = I.regroup_features(t, "pubchem_cid", "metabolite_uids", f, "entity_uid", "score")
    return out.withColumn("mean", F.round("mean", 6))


def _name(c):
    """Printable ASCII in lower case with its inner blanks as they are, as the SQL reads it; other texts folded."""
    return F.when(c.rlike("[^ -~]"), folded_key(c)).otherwise(F.lower(F.trim(c)))


def _named_cases(spark, d):
    """case_id, k: the names of the cases that have one."""
    return table(spark, d, "name_only_cases").select("case_id", _name(C("input_name")).alias("k")).distinct().filter("k <> ''")


def trait_kinds(spark: SparkSession, d: str) -> DataFrame:
    n = _named_cases(spark, d)
    return n.select("case_id", D.trait_kind(C("k")).alias("kind"), D.granularity(D.trait_kind(C("k"))).alias("granularity"))


def _candidates(spark, d):
    n = _named_cases(spark, d).withColumn("kind", D.trait_kind(C("k")))
    labels = table(spark, d, "metabolite_gold_labels").select("metabolite_uid", "inchikey", F.explode(D.name_variants(_name(C("label")))).alias("k"))
    hits = n.join(labels, "k", "left")
    return hits.groupBy("case_id", "kind").agg(F.count_distinct("metabolite_uid").alias("n_candidates"), F.min("metabolite_uid").alias("uid"))


def identity_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Features of the typed names; the entity of each kind is the one that a name alone has."""
    c = _candidates(spark, d)
    feature = F.when(C("kind") == "ratio", "ratio").when(C("kind").isin("sum", "class"), "lipid_class").when(C("case_id") % 7 == 0, "trait_score").otherwise("unknown_peak")
    uid = F.when(C("n_candidates") == 1, C("uid"))
    out = c.withColumn("feature", feature).withColumn("d", D.decide(feature, uid, uid, uid))
    return out.select("case_id", "feature", "n_candidates", "d.*", F.when(C("d.review") != "auto", D.review_bucket(C("kind"), C("n_candidates"), F.lit(0))).alias("bucket"))


def name_variants(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "metabolite_gold_labels").select("label_id", F.explode(D.name_variants(C("label"))).alias("variant"))


def group_decisions(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "sentence_mentions").select("mention_uid", "normalized_surface", "entity_uid").distinct().filter("normalized_surface is not null").withColumn("one", F.lit(1))
    out = D.group_decisions(m, "normalized_surface", "entity_uid", "one")
    return out.withColumn("share", F.round("share", 6))


QUERIES = {f.__name__: f for f in (
    merged_genes, propagated_links, fallback_uids, unversioned_ids, reaction_components, bridged_identities, inherited_edges, article_years, regrouped_features,
    trait_kinds, identity_decisions, name_variants, group_decisions,
)}

_IDS = "select distinct chemical_uid as u, upper(trim(xref_id, ' ')) as i from chemical_xrefs where upper(trim(xref_source, ' ')) = '{s}' and xref_type = 'exact' and regexp_matches(xref_id, '[0-9]')"
_NAMES = f"n as (select distinct case_id, case when regexp_matches(input_name, '[^ -~]') then {folded('input_name')} else lower(trim(input_name, ' ')) end as k from name_only_cases), n0 as (select * from n where k <> '')"
_KIND = "case " + " ".join(f"when regexp_matches(k, '{p}') then '{n}'" for n, p in D.TRAIT_KINDS) + " else 'compound' end"
_VAR = """
    v0 as (select label_id, metabolite_uid, inchikey, lower(trim(label, ' ')) as k from metabolite_gold_labels),
    v as (select * from v0 union select label_id, metabolite_uid, inchikey, regexp_replace(k, 'ic acid$', 'ate') from v0 where k like '%ic acid' union select label_id, metabolite_uid, inchikey, regexp_replace(k, 'ate$', 'ic acid') from v0 where k like '%ate'
      union select label_id, metabolite_uid, inchikey, regexp_replace(k, '^(d|l|alpha|beta)-', '') from v0 where regexp_matches(k, '^(d|l|alpha|beta)-') union select label_id, metabolite_uid, inchikey, regexp_replace(k, ' ([0-9]{1,2}:[0-9]{1,2})$', '(\\1)') from v0 where regexp_matches(k, ' [0-9]{1,2}:[0-9]{1,2}$'))"""
_YEAR = "nullif(regexp_extract(pub_date, '\\b(18[0-9]{2}|19[0-9]{2}|20[0-9]{2}|2100)\\b', 1), '')::int"
_PMID = "nullif(regexp_extract(pmid, '0*([1-9][0-9]*)', 1), '')"

ORACLES = {
    "merged_genes": """
        with a as (select ensembl_gene_id, min(symbol) as s, min(description) as t from genes where source_name = 'gene_info' and ensembl_gene_id is not null group by 1),
        b as (select ensembl_gene_id, min(symbol) as s, min(description) as t from genes where source_name = 'gtf_genes' and ensembl_gene_id is not null group by 1)
        select coalesce(a.ensembl_gene_id, b.ensembl_gene_id) as ensembl_gene_id, coalesce(a.s, b.s) as symbol, coalesce(a.t, b.t) as description,
          case when b.ensembl_gene_id is null then 'first' when a.ensembl_gene_id is null then 'second' else 'both' end as origin from a full join b on a.ensembl_gene_id = b.ensembl_gene_id""",
    "propagated_links": f"""
        with a as ({_IDS.format(s="CHX")}), b as ({_IDS.format(s="PCID")}), l as (select distinct a.i as l, b.i as r from a join b using (u)),
        k as (select i, min(u) as u from (select i, u from a where i like '%7%' union all select i, u from b where i like '%3%') group by 1)
        select l as "left", r as "right", case when x.u is null or y.u is null or x.u = y.u then coalesce(x.u, y.u) end as uid,
          case when x.u is null and y.u is null then 'open' when x.u is null or y.u is null then 'propagated' when x.u = y.u then 'agreed' else 'conflict' end as status
        from l left join k x on l.l = x.i left join k y on l.r = y.i""",
    "fallback_uids": """
        select l_partkey, case when p_size <= 25 then 'part:' || l_partkey else 'part_' || left(sha1(l_partkey::varchar), 20) end as uid from (select distinct l_partkey from lineitem) left join part on l_partkey = p_partkey""",
    "unversioned_ids": "select regexp_replace(trim(xref_id, ' '), '\\.[0-9]+$', '') as accession, count(*) as n_rows from chemical_xrefs where xref_id is not null group by 1",
    "reaction_components": """
        with t as (select distinct pubchem_cid, formula, title from cid_properties where formula is not null and title is not null)
        select pubchem_cid, 'substrate' as role, 0 as position, formula as component from t union all select pubchem_cid, 'substrate', 1, 'H2O' from t
        union all select pubchem_cid, 'product', 0, title from t union all select pubchem_cid, 'product', 1, formula from t""",
    "bridged_identities": """
        with c as (select distinct case_id, lower(trim(input_name, ' ')) as n from name_only_cases), k as (select case_id, n, case when case_id % 3 = 0 then inchikey end as ik from c left join metabolite_gold_labels on label_id = case_id),
        h as (select case_id, 0 as w, metabolite_uid as uid, 'INCHIKEY' as via from k join metabolite_gold_labels on ik = inchikey union all select case_id, 1, metabolite_uid, 'NAME' from k join metabolite_gold_labels on n = lower(label))
        select case_id, arg_min(uid, (w, uid)) as uid, arg_min(via, (w, uid)) as via from h group by 1""",
    "inherited_edges": f"""
        with x as ({_IDS.format(s="PCID")} union {_IDS.format(s="MDB")}), q as (select u, min(u) over (partition by i) as f from x), r as (select distinct chemical_uid as u, upper(trim(xref_source, ' ')) as p, trim(xref_id, ' ') as o from chemical_xrefs where xref_type = 'class' and regexp_matches(xref_id, '[0-9]')),
        s as (select u, f as v from q where u <> f union select f, u from q where u <> f)
        select distinct s.u as chemical_uid, p as predicate, o as object from s join r on s.v = r.u where not exists (select 1 from r x where x.u = s.u and x.p = r.p and x.o = r.o)""",
    "article_years": f"""
        with m as (select article_uid, min({_PMID}::bigint)::varchar as pmid from sentence_mentions where article_uid is not null group by 1),
        i as (select article_uid as t, {_YEAR} as y from documents union all select {_PMID}, {_YEAR} from documents)
        select m.article_uid, min(y) as year from m left join i on (t = m.article_uid or t = m.pmid) and y is not null group by 1""",
    "regrouped_features": """
        with t as (select distinct pubchem_cid, metabolite_uids from cid_properties), e as (select distinct pubchem_cid, unnest(metabolite_uids) as uid from t), f as (select entity_uid as uid, max(resolution_confidence) as s from sentence_mentions group by 1),
        g as (select pubchem_cid, count(uid) as n_items, count(s) as n_scored, max(s) as best, round(avg(s), 6) as mean from e left join f using (uid) group by 1)
        select t.pubchem_cid, coalesce(n_items, 0) as n_items, coalesce(n_scored, 0) as n_scored, best, mean from t left join g using (pubchem_cid)""",
    "trait_kinds": f"""
        with {_NAMES}, q as (select case_id, {_KIND} as kind from n0)
        select case_id, kind, case when kind = 'compound' then 'molecule' when kind = 'lipid_species' then 'species' when kind in ('sum', 'class') then 'class' else 'composite' end as granularity from q""",
    "identity_decisions": f"""
        with {_NAMES}, {_VAR}, q as (select n.case_id, {_KIND.replace("matches(k", "matches(n.k")} as kind, count(distinct metabolite_uid) as n_candidates, min(metabolite_uid) as uid from n0 n left join v on n.k = v.k group by 1, 2),
        f as (select *, n_candidates = 1 as one, case when kind = 'ratio' then 'ratio' when kind in ('sum', 'class') then 'lipid_class' when case_id % 7 = 0 then 'trait_score' else 'unknown_peak' end as feature from q)
        select case_id, feature, n_candidates, case when one then case feature when 'ratio' then 'accepted_trait' when 'lipid_class' then 'accepted_class' when 'trait_score' then 'accepted_trait' else 'accepted_exact' end
            when feature = 'unknown_peak' then 'unmatched' else 'ambiguous' end as decision, case when one then uid else '' end as entity_uid,
          case when one then case feature when 'ratio' then 'trait' when 'lipid_class' then 'class' when 'trait_score' then 'trait' else 'chemical' end else '' end as entity_kind,
          case feature when 'ratio' then 'ratio_not_exact_abundance' || case when one then '' else ';missing_trait_entity' end when 'lipid_class' then 'class_name_not_exact_identity'
            when 'trait_score' then case when one then 'trait_score_not_direct_abundance' else 'trait_score_without_registered_trait' end else case when one then 'stable_source_entity' else 'no_candidate_entity' end end as reason,
          (case when not one then 0 else case feature when 'ratio' then 0.8 when 'lipid_class' then 0.65 when 'trait_score' then 0.7 else 0.9 end end)::double as confidence, case when one and feature = 'unknown_peak' then 'auto' else 'needs_review' end as review,
          case when not (one and feature = 'unknown_peak') then case when kind = 'ratio' then 'ratio_components' when kind in ('sum', 'class') then 'class_or_pool' when n_candidates > 1 then 'ambiguous_candidates' when n_candidates = 1 then 'single_unconfirmed' else 'no_candidate' end end as bucket from f""",
    "name_variants": f"with {_VAR} select distinct label_id, k as variant from v",
    "group_decisions": """
        with m as (select distinct mention_uid, normalized_surface, entity_uid from sentence_mentions where normalized_surface is not null and entity_uid is not null), n as (select normalized_surface, entity_uid, count(*) as n from m group by 1, 2),
        t as (select normalized_surface, arg_min(entity_uid, (-n, entity_uid)) as entity_uid, max(n) as m, sum(n) as t from n group by 1)
        select normalized_surface, entity_uid, round(m / t, 6) as share, m * 3 >= t * 2 as agreed from t""",
}
