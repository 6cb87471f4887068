"""Selections, samples and summaries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions import text as X
from lodegraph.functions.keys import folded_key
from lodegraph.operators import curation as U
from lodegraph.queries.sql_folding import folded
from lodegraph.runtime import table, widen

C = F.col


def surface_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on the names, in words and as they are joined by signs, that the mentions' entities show."""
    m = table(spark, d, "sentence_mentions").select("display_name", "entity_type", "matched_field").distinct()
    verdict = U.surface_verdict(C("display_name"), C("entity_type"), C("display_name"), C("matched_field"))
    return m.groupBy("entity_type", verdict.alias("verdict")).agg(F.count("*").alias("n"))


def graph_limited_customers(spark: SparkSession, d: str) -> DataFrame:
    return U.limited_to(table(spark, d, "customer"), "c_custkey", table(spark, d, "orders").filter("o_totalprice > 150000").withColumn("other", C("o_custkey") + 1), ["o_custkey", "other"]).select("c_custkey", "c_name")


def known_pairs(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem")
    asked = i.select("l_partkey", (F.pmod(C("l_suppkey"), F.lit(20)) + 1).alias("l_suppkey")).distinct()
    return U.known_pairs(asked, i, ["l_partkey", "l_suppkey"])


def merged_overlay(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "genes").filter("symbol is not null").select("gene_uid", "symbol", "source_name", "record_id").distinct()
    return U.merge_overlay(g.filter("source_name <> 'user_overlay'"), g.filter("source_name = 'user_overlay'"), ["gene_uid", "symbol"], ["record_id"])


def signal_rollup(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "genes").select("record_id", "gene_uid", "source_name", F.transform("aliases", lambda a: F.substring(a, 1, 1)).alias("tags"))
    return U.signal_rollup(g.withColumn("severity", F.pmod("record_id", F.lit(5))), "source_name", "gene_uid", "tags", "severity")


def name_statistics(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "cid_properties").select("pubchem_cid", F.explode("synonyms").alias("s")).filter("s is not null").distinct()
    i = t.select(folded_key(C("s")).alias("name"), "pubchem_cid", F.length("s").alias("rank"), F.when(C("s").contains(" "), "phrase").otherwise("word").alias("field"))
    out = U.name_statistics(i, "name", "pubchem_cid", "rank", "field")
    return out.withColumns({"fields": F.array_join("fields", ";"), "examples": F.array_join("examples", ";")})


def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return U.hash_sample(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderpriority", "o_orderkey", 40)


def rank_fractions(spark: SparkSession, d: str) -> DataFrame:
    out = U.rank_fractions(table(spark, d, "customer"), "c_custkey", "c_acctbal")
    return out.withColumn("fraction", F.round("fraction", 6))


def holdout_specs(spark: SparkSession, d: str) -> DataFrame:
    return U.holdout_specs(table(spark, d, "documents").withColumn("kind", F.when(C("source").isin("forum_threads"), "threads").otherwise("texts")), "kind", "source")


def ratio_components(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "metabolite_gold_labels").select("label_id", F.concat("label", F.lit(" / "), "entity_type", F.lit(" ratio")).alias("name"), (C("label_id") % 7 - 3).cast("double").alias("effect"))
    return U.ratio_components(t, "label_id", "name", "effect")


def forbidden_text(spark: SparkSession, d: str) -> DataFrame:
    return U.forbidden_text(table(spark, d, "documents"), "doc_id", "text", ["nothing to worry about", "the next visit", "principal determinant"])


def prediction_rows(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("prediction_id", F.concat(F.lit("o"), "o_orderkey"))
    label = F.when(C("o_orderstatus") == "F", 2).when(C("o_orderstatus") == "P", 1).otherwise(0)
    return U.prediction_rows(o, label, {"price": F.round(C("o_totalprice") / 1000, 3), "missing": F.lit(None)}, C("o_custkey").cast("string"))


def token_offsets(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "metabolite_gold_labels").select("label_id", F.concat("label", F.lit(" in "), "label").alias("t"))
    return t.select("label_id", F.posexplode(X.tokens_with_offsets(C("t"))).alias("pos", "x")).select("label_id", "pos", "x.token", "x.start", "x.end")


def sentence_spans(spark: SparkSession, d: str) -> DataFrame:
    t = widen(table(spark, d, "documents").select("doc_id", "text").filter("text is not null"))
    s = t.select("doc_id", "text", F.posexplode(X.sentence_offsets(C("text"))).alias("pos", "x"))
    # the span is the sentence, whatever the text before it
    return s.select("doc_id", "pos", C("x.start").alias("start"), C("x.end").alias("end"), F.trim(F.expr("substring(text, x.start + 1, x.end - x.start)")).alias("sentence"))


def parts_outside_parentheses(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "name_only_cases").select("case_id", "input_name").distinct()
    return t.select("case_id", F.posexplode(X.split_outside_parentheses(C("input_name"))).alias("pos", "part"))


QUERIES = {f.__name__: f for f in (
    surface_verdicts, graph_limited_customers, known_pairs, merged_overlay, signal_rollup, name_statistics, hash_sample, rank_fractions, holdout_specs, ratio_components,
    forbidden_text, prediction_rows, token_offsets, sentence_spans, parts_outside_parentheses,
)}

# Fixed values of the SQL: its own copy of the lists and of the pattern.
_GENERIC = """
    'acid', 'activation', 'activity', 'analysis', 'assay', 'background', 'binding', 'body', 'cancer', 'cell', 'cells', 'control', 'controls', 'data',
    'disease', 'effect', 'effects', 'expression', 'factor', 'family', 'growth', 'group', 'human', 'level', 'levels', 'line', 'lines', 'metabolism',
    'method', 'model', 'models', 'pathway', 'patient', 'patients', 'protein', 'response', 'results', 'role', 'sample', 'samples', 'study', 'target',
    'therapy', 'tissue', 'tissues', 'tumor', 'tumors'
"""
_LOW = """
    'abnormal', 'angiogenesis', 'braf', 'breast cancer cell', 'c myc', 'cafs', 'cancer cell', 'cancer immunotherapy', 'cancer progression', 'cancer
    risk', 'cancer therapy', 'cancer treatment', 'carcinogenesis', 'ccnd1', 'central', 'chemotherapy', 'chemo', 'chip', 'cyclin d1', 'decreasing',
    'erbb2', 'expansion', 'favorable', 'gastric', 'gli1', 'grade', 'her2', 'high risk', 'igf2bp2', 'igf2bp3', 'intestinal', 'intratumoral',
    'invasion', 'irradiation', 'kras', 'ldha', 'lkb1', 'many', 'measured', 'mixed', 'moderate', 'negative', 'normal', 'oncogene', 'oncogenesis',
    'oncology', 'ovary', 'pcos', 'pfkfb3', 'positive', 'poor', 'primary', 'radiation', 'radiotherapy', 'recurrent', 'runx1', 'screening', 'site',
    'stage', 'targeting', 'tcga', 'tet1', 'the cancer genome atlas', 'tumor cell', 'tumor expansion', 'tumor immunity', 'tumor necrosis', 'tumor
    microenvironment', 'tumor necrosis factor', 'tumor progression', 'tumor regression', 'tumor suppression', 'tumor suppressor', 'tumor tissue',
    'tumorigenesis', 'with tumor', 'ythdf2', 'brca1', 'tp53', 'cell cycle arrest', 'cancer metastasis', 'tumor metastasis', 'metastases', 'cancer
    related', 'early stage', 'interact', 'deep'
"""
_SYMBOLS = """
    'ACE', 'ALL', 'AND', 'ARE', 'AS', 'AT', 'CAT', 'COX', 'DNA', 'FOR', 'GAP', 'HAD', 'HAS', 'IN', 'INH', 'ITS', 'MAP', 'MET', 'NO', 'NOT', 'OR',
    'PR', 'RAN', 'SET', 'WAS'
"""
_LABEL = r"\b(agent|therapeutic procedure|therapy agent|chemotherapy|radiation therapy|radiotherapy|immunotherapy|screening|measurement|assay|test|criteria|risk group|gene mutation|wt allele|allele|oncogene|gene|protein|receptor|ligand|factor|kinase|antigen|enzyme|pathway|process|route of administration|microenvironment|immunity|angiogenesis|invasion|carcinogenesis|tumou?rigenesis|progression|regression|suppression|regulation|fibroblast|question|consortium|atlas)\b"
_BUCKET = "('0x' || left(sha256({x}::varchar), {k}))::bigint % 100"

ORACLES = {
    "surface_verdicts": f"""
        with m as (select distinct display_name, entity_type, matched_field, trim(regexp_replace(regexp_replace(lower(display_name), '[\u2010-\u2015_/-]+', ' ', 'g'), '\\s+', ' ', 'g')) as flat from sentence_mentions),
        t as (select *, regexp_extract_all(flat, '[a-z0-9]+') as toks, array_to_string(regexp_extract_all(flat, '[a-z0-9]+'), ' ') as key, entity_type in ('gene', 'target') as gene from m)
        select entity_type, case when display_name is null or flat = '' or len(toks) = 0 then 'empty' when length(flat) > 96 then 'too_long' when len(toks) > 10 then 'many_tokens' when not regexp_matches(key, '[a-z]') then 'no_letters'
          when flat in ({_GENERIC}) then 'generic' when not gene and len(toks) = 1 and length(toks[1]) < 4 then 'short' when gene and upper(trim(display_name, ' ')) in ({_SYMBOLS}) then 'blocked_symbol'
          when gene and len(toks) = 1 and length(toks[1]) < 3 then 'short'
          when entity_type = 'disease' and (key in ({_LOW}) or regexp_matches(flat, '{_LABEL}') or (coalesce(matched_field, '') = 'alias' and key in ({_GENERIC}))) then 'low_precision' else 'keep' end as verdict, count(*) as n
        from t group by 1, 2""",
    "graph_limited_customers": "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 150000 union select o_custkey + 1 from orders where o_totalprice > 150000)",
    "known_pairs": """
        with a as (select distinct l_partkey, l_suppkey % 20 + 1 as l_suppkey from lineitem), k as (select distinct l_partkey, l_suppkey from lineitem)
        select a.l_partkey, a.l_suppkey, k.l_partkey is not null as is_known from a left join k on a.l_partkey = k.l_partkey and a.l_suppkey = k.l_suppkey""",
    "merged_overlay": """
        with g as (select distinct gene_uid, symbol, source_name, record_id, (source_name = 'user_overlay')::int as side from genes where symbol is not null and source_name is not null)
        select gene_uid, symbol, arg_min(source_name, (side, record_id)) as source_name, arg_min(record_id, (side, record_id)) as record_id from g group by 1, 2""",
    "signal_rollup": """
        with g as (select source_name, gene_uid, record_id % 5 as severity, aliases from genes), e as (select source_name, gene_uid, severity, unnest(case when len(aliases) > 0 then aliases else [null] end)[1:1] as tag from g),
        u as (select distinct * from e) select source_name, tag, count(*) as n_signals, count(distinct gene_uid) as n_cases, max(severity) as worst from u group by 1, 2""",
    "name_statistics": """
        with t as (select distinct pubchem_cid, s from (select pubchem_cid, unnest(synonyms) as s from cid_properties) where s is not null),
        i as (select """ + folded("s") + """ as name, pubchem_cid, length(s)::int as rank, case when contains(s, ' ') then 'phrase' else 'word' end as field from t)
        select name, count(*) as n_rows, count(distinct pubchem_cid) as n_uids, max(rank) as best_rank, min(rank) as worst_rank, string_agg(distinct field, ';' order by field) as fields, array_to_string(list_sort(list(distinct pubchem_cid))[1:5], ';') as examples from i group by 1""",
    "hash_sample": f"""
        select o_orderkey, o_orderpriority, o_totalprice from (select *, row_number() over (partition by o_orderpriority order by {_BUCKET.format(x="o_orderkey", k=12)}, o_orderkey) as rn from orders) where rn <= 40""",
    "rank_fractions": """
        select c_custkey, row_number() over (order by c_acctbal desc, c_custkey) as rank, round(1 - (row_number() over (order by c_acctbal desc, c_custkey) - 1) / greatest(count(*) over () - 1, 1), 6) as fraction from customer""",
    "holdout_specs": """
        with n as (select case when source = 'forum_threads' then 'threads' else 'texts' end as source_kind, source, count(*) as n from documents where source is not null group by 1, 2), j as (select *, count(*) over (partition by source_kind) as k from n),
        o as (select source_kind, source, null::int as part, n from j where k >= 2 union all select source_kind, source, p::int, n from j, range(3) t(p) where k < 2)
        select *, concat_ws(':', source_kind, source, part::varchar) as spec from o""",
    "ratio_components": """
        select label_id, 0 as position, lower(label) as component, (label_id % 7 - 3)::double as effect from metabolite_gold_labels union all select label_id, 1, lower(entity_type), -(label_id % 7 - 3)::double from metabolite_gold_labels""",
    "forbidden_text": " union all ".join(
        f"select doc_id, '{p}' as phrase from documents where regexp_matches(lower(text), '(^|[^a-z0-9]){p}($|[^a-z0-9])')" for p in ("nothing to worry about", "the next visit", "principal determinant")
    ),
    "prediction_rows": f"""
        select 'o' || o_orderkey as prediction_id, case o_orderstatus when 'F' then 2 when 'P' then 1 else 0 end as label, round(o_totalprice / 1000, 3) as price, 0.0::double as missing,
          case when {_BUCKET.format(x="o_custkey", k=8)} < 15 then 'test' when {_BUCKET.format(x="o_custkey", k=8)} < 30 then 'validation' else 'train' end as split from orders""",
    "token_offsets": """
        with t as (select label_id, label || ' in ' || label as t from metabolite_gold_labels), c as (select label_id, t, i, regexp_matches(t[i], '[A-Za-z0-9]') as inside, i = 1 or not regexp_matches(t[i - 1], '[A-Za-z0-9]') as first from t, range(1, 200) r(i) where i <= length(t)),
        s as (select label_id, t, i - 1 as "start", length(regexp_extract(t[i:], '^[A-Za-z0-9]+')) as n from c where inside and first)
        select label_id, (row_number() over (partition by label_id order by "start") - 1)::int as pos, t["start" + 1:"start" + n] as token, "start"::int as "start", ("start" + n)::int as "end" from s""",
    "sentence_spans": """
        with s as (select doc_id, text, regexp_extract_all(text, '[^.!?\\n]+(?:[.!?]+|$)') as ss from documents where text is not null)
        select doc_id, (i - 1)::int as pos, trim(ss[i], ' ') as sentence, "start", "end" from (select doc_id, ss, unnest(range(1, len(ss) + 1)) as i from s) join
          (with recursive w as (select doc_id as d, text, ss as q, 1 as k, position(ss[1] in text) - 1 as "start", position(ss[1] in text) - 1 + length(ss[1]) as "end" from s where len(ss) > 0
             union all select d, text, q, k + 1, "end" + position(q[k + 1] in text["end" + 1:]) - 1, "end" + position(q[k + 1] in text["end" + 1:]) - 1 + length(q[k + 1]) from w where k < len(q))
           select d, k, "start"::int as "start", "end"::int as "end" from w) on d = doc_id and k = i""",
}
