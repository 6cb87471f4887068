"""Overlays, enrichment and release checks over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators import enrichment as E
from lodegraph.operators import overlays as O
from lodegraph.operators import release as R
from lodegraph.runtime import table

C = F.col


def _genes(spark, d):
    return table(spark, d, "genes").select("record_id", "gene_uid", "ensembl_gene_id", "entrez_gene_id", "symbol", "aliases", "source_name").dropDuplicates(["record_id"])


def any_key_join(spark: SparkSession, d: str) -> DataFrame:
    g = _genes(spark, d)
    board = g.filter("source_name = 'nomenclature_board'")
    left = g.filter("source_name = 'user_overlay'").withColumn("upper_symbol", F.upper("symbol"))
    return O.any_key_join(left, "record_id", [("ensembl_gene_id", "ensembl_gene_id"), ("entrez_gene_id", "entrez_gene_id"), ("upper_symbol", "symbol")], board, "gene_uid")


def symbol_targets(spark: SparkSession, d: str) -> DataFrame:
    g = _genes(spark, d)
    asked = g.select("record_id", F.explode("aliases").alias("alias")).filter("trim(alias) <> ''").distinct()
    return O.attach_targets(asked, "alias", O.symbol_targets(g, "symbol", "gene_uid"))


def top_dependencies(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "embeddings").select("vec_id", *[C("embedding")[i].cast("double").alias(f"g{i}") for i in range(64)])
    out = O.top_dependencies(O.wide_to_long(wide, "vec_id", [f"g{i}" for i in range(64)], "gene", "effect"), "vec_id", "gene", "effect", -0.1, 3)
    return out.withColumn("confidence", F.round("confidence", 6))


def source_confidence(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem")
    kind = F.when(C("l_returnflag") == "A", "curated").when(C("l_returnflag") == "N", "clinical").when(C("l_linestatus") == "F", "interaction").otherwise("mechanism")
    c = O.source_confidence(kind, C("l_linestatus") == "F", C("l_quantity") > 25, C("l_quantity") / 5, C("l_linenumber") % 5, C("l_linenumber"))
    return i.select("l_orderkey", "l_linenumber", F.round(c, 6).alias("confidence"))


def marker_signatures(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "sentence_mentions").filter("section is not null and entity_type = 'gene'")
    out = O.marker_signatures(m, "section", "entity_uid", "resolution_confidence", "license_id")
    return out.withColumn("symbols", F.sha2(F.array_join("symbols", ";"), 256))


def best_markers(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "sentence_mentions").filter("section is not null")
    out = O.best_markers(m, "section", "entity_uid", "resolution_confidence", "matched_field")
    return out.withColumn("tissues", F.array_join("tissues", ";"))


def context_fit(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "cell_type_signatures").dropDuplicates(["signature_id"])
    return t.select("signature_id", F.round(O.context_match(F.concat_ws(" ", "context_terms", "cell_state"), ["late", "hypoxic", "Cycling", "adult"]), 6).alias("context_fit"))


def excluded_terms(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "metabolite_gold_labels").select("label_id", "label", "formula")
    return O.exclude_terms(t, ["acid", "alpha-", "N2O"])


def appendix_policy(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "cell_type_signatures").select("signature_id", "pathway_terms", "confidence").dropDuplicates(["signature_id"])
    out = O.appendix_policy(t, "pathway_terms", "confidence", ["degradation", "shunt"], ["transport"])
    return out.select("signature_id", "in_appendix", "policy_score")


def merged_scores(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").filter("s_suppkey % 3 <> 0").select("s_suppkey", (F.pmod("s_suppkey", F.lit(50)) / 50).alias("score"))
    m = table(spark, d, "supplier").filter("s_suppkey % 4 <> 0").select("s_suppkey", (F.pmod("s_suppkey", F.lit(37)) / 37).alias("score"))
    out = O.merge_learned(s, m, "s_suppkey")
    return out.withColumn("score", F.round("score", 6))


def source_registry(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("source is not null").select("source", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return R.source_registry(t, "source", "n_chars", "digest")


def upsert(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    delta = base.filter("c_custkey % 10 = 0").withColumn("c_acctbal", C("c_acctbal") + 1)
    new = base.filter("c_custkey % 50 = 0").select((C("c_custkey") + 1000000).alias("c_custkey"), "c_name", "c_acctbal")
    return R.upsert(base, delta.unionByName(new), ["c_custkey"])


def field_audit(spark: SparkSession, d: str) -> DataFrame:
    return R.field_audit(table(spark, d, "genes"), ["symbol", "description", "biotype", "entrez_gene_id", "updated_at", "chromosome"])


def coverage_matrix(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("lang", "source")
    return R.coverage_matrix(t, "lang", "source", R.requirements(t, "lang", "source"))


def regression_compare(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("metric", C("o_orderpriority"))
    early = o.filter("year(o_orderdate) = 1995").groupBy("metric").agg(F.count("*").cast("double").alias("value"))
    late = o.filter("year(o_orderdate) = 1997").groupBy("metric").agg(F.count("*").cast("double").alias("value"))
    return R.compare_runs(early, late.filter("metric not like '1%'"), 5.0, ["2-HIGH"])


def release_gates(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return R.gate_rows(t, [("documents", F.count("*"), 500), ("with_text", F.avg((F.length("text") > 0).cast("double")), 0.9), ("sources", F.count_distinct("source"), 50)])


def contract_failures(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "chemical_xrefs").select(F.concat_ws("|", "chemical_uid", "xref_source", "xref_id").alias("k"), "source_record_uid", "xref_id").distinct()
    return R.contract_failures(t, "k", [("has_record", C("source_record_uid").isNotNull()), ("has_digit", C("xref_id").rlike("[0-9]"))])


def gold_recall(spark: SparkSession, d: str) -> DataFrame:
    sold = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    ranked = E.top_in_group(sold, ["l_suppkey"], [F.desc("q"), F.asc("l_partkey")], 20, "r")
    gold = table(spark, d, "lineitem").filter("l_discount >= 0.1").select("l_suppkey", "l_partkey")
    out = R.gold_recall(ranked, gold, "l_suppkey", "l_partkey", "r", 20)
    return out.withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


def unsourced_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of a document that no other document of its article has."""
    t = table(spark, d, "documents").select("doc_id", "article_uid", "text")
    said = t.filter("text is not null and article_uid is not null").select("article_uid", "doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([0-9]+(?:[.][0-9]+)?)"), 1))).alias("number"))
    shared = said.groupBy("article_uid", "number").agg(F.count("*").alias("n")).filter("n > 1")
    allowed = said.join(shared, ["article_uid", "number"], "left_semi").select("doc_id", "number")
    return R.numbers_without_source(t.drop("article_uid"), "doc_id", "text", allowed)


def oriented_effects(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem")
    e = E.orient(C("l_discount") - 0.05, C("l_returnflag"), C("l_linestatus"), "F")
    return i.select("l_orderkey", "l_linenumber", F.round(e, 4).alias("effect")).filter("effect is not null")


def _differential(spark, d):
    return table(spark, d, "lineitem").groupBy(F.pmod("l_suppkey", F.lit(10)).alias("g"), "l_partkey").agg((F.max("l_discount") - 0.05).alias("effect"), F.max("l_tax").alias("q"))


def differential_selection(spark: SparkSession, d: str) -> DataFrame:
    out = E.select_differential(_differential(spark, d), "g", "l_partkey", "effect", "q", 0.05, 0.02, 25)
    return out.withColumn("effect", F.round("effect", 4))


def differential_rejected(spark: SparkSession, d: str) -> DataFrame:
    return E.rejected_counts(_differential(spark, d), "g", "effect", "q", 0.05, 0.02)


def over_representation(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    m = table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    out = E.over_representation(m, "l_suppkey", "l_partkey", p.filter("p_size <= 10").select(C("p_partkey").alias("l_partkey")), p.count())
    return out.withColumns({c: F.round(c, 6) for c in ("coverage", "p_value", "fdr")})


QUERIES = {f.__name__: f for f in (
    any_key_join, symbol_targets, top_dependencies, source_confidence, marker_signatures, best_markers, context_fit, excluded_terms, appendix_policy, merged_scores,
    source_registry, upsert, field_audit, coverage_matrix, regression_compare, release_gates, contract_failures, gold_recall, unsourced_numbers,
    oriented_effects, differential_selection, differential_rejected, over_representation,
)}

_G = "g as (select distinct record_id, gene_uid, ensembl_gene_id, entrez_gene_id, symbol, aliases, source_name from genes)"
_DIFF = "x as (select l_suppkey % 10 as g, l_partkey, max(l_discount) - 0.05::double as effect, max(l_tax) as q from lineitem group by 1, 2)"
_NUM = "'([0-9]+(?:[.][0-9]+)?)'"
_LNC = "(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"
lnc = lambda n, k: _LNC.format(n=f"({n})", k=f"({k})")

ORACLES = {
    "any_key_join": f"""
        with {_G}, b as (select * from g where source_name = 'nomenclature_board'), u as (select * from g where source_name = 'user_overlay'),
        p as (select u.record_id, b.gene_uid, 0 as i, 'ensembl_gene_id' as via from u join b using (ensembl_gene_id) union all select u.record_id, b.gene_uid, 1, 'entrez_gene_id' from u join b using (entrez_gene_id)
          union all select u.record_id, b.gene_uid, 2, 'upper_symbol' from u join b on upper(u.symbol) = b.symbol)
        select record_id, gene_uid, arg_min(via, i) as via from p group by 1, 2""",
    "symbol_targets": f"""
        with {_G}, a as (select distinct record_id, alias from (select record_id, unnest(aliases) as alias from g) where trim(alias, ' ') <> ''),
        t as (select upper(trim(symbol, ' ')) as symbol, min(gene_uid) as uid from g where trim(symbol, ' ') <> '' and gene_uid is not null group by 1)
        select record_id, alias, uid from a left join t on upper(trim(alias, ' ')) = symbol""",
    "top_dependencies": """
        with l as (select vec_id, 'g' || i as gene, embedding[i + 1]::double as effect from embeddings, range(64) t(i)),
        r as (select *, (row_number() over (partition by vec_id order by effect, gene))::int as rank from l where effect <= -0.1)
        select vec_id, gene, effect, rank, round(greatest(0, least(1, 0.55::double + 0.18::double * least(abs(effect), 1.5) + 0.002::double * least(count(*) over (partition by vec_id), 50))), 6) as confidence from r where rank <= 3""",
    "source_confidence": """
        select l_orderkey, l_linenumber, round(greatest(0, least(1, case when l_returnflag = 'A' then 0.35::double + 0.25::double * (l_linestatus = 'F')::int + 0.15::double * (l_quantity > 25)::int + 0.2::double * (l_quantity / 5 / 10)
          when l_returnflag = 'N' then (case when ph >= 4 then 0.95 when ph >= 3 then 0.86 when ph >= 2 then 0.74 when ph >= 1 then 0.62 else 0.5 end)::double + least(0.05::double, 0.01::double * l_linenumber)
          when l_linestatus = 'F' then 0.42::double + 0.25::double + 0.15::double * (least(l_linenumber, 10) / 10) + 0.08::double * (ph >= 4)::int
          else 0.55::double + 0.1::double * (l_quantity > 25)::int + 0.1::double * (l_linestatus = 'F')::int + 0.15::double * (ph / 4) end)), 6) as confidence from (select *, l_linenumber % 5 as ph from lineitem)""",
    "marker_signatures": """
        select section, sha256(string_agg(distinct entity_uid, ';' order by entity_uid)) as symbols, count(distinct entity_uid) as n_symbols, max(resolution_confidence) as confidence, min(license_id) as licence
        from sentence_mentions where section is not null and entity_type = 'gene' group by 1""",
    "best_markers": """
        select section, entity_uid, max(resolution_confidence) as score, string_agg(distinct matched_field, ';' order by matched_field) as tissues from sentence_mentions where section is not null group by 1, 2""",
    "context_fit": """
        select distinct signature_id, round((contains(t, 'late')::int + contains(t, 'hypoxic')::int + contains(t, 'cycling')::int + contains(t, 'adult')::int) / 4, 6) as context_fit
        from (select signature_id, lower(concat_ws(' ', context_terms, cell_state)) as t from cell_type_signatures)""",
    "excluded_terms": """
        select label_id, label, formula from metabolite_gold_labels where not (contains(lower(label), 'acid') or contains(lower(label), 'alpha-') or contains(lower(coalesce(label, '')), 'n2o') or contains(lower(coalesce(formula, '')), 'acid') or contains(lower(coalesce(formula, '')), 'alpha-') or contains(lower(coalesce(formula, '')), 'n2o'))""",
    "appendix_policy": """
        with t as (select distinct signature_id, lower(coalesce(pathway_terms, '')) as t, confidence from cell_type_signatures), a as (select *, regexp_matches(t, 'degradation|shunt') and not regexp_matches(t, 'transport') as in_appendix from t)
        select signature_id, in_appendix, case when in_appendix then least(0.25, confidence) else confidence end as policy_score from a""",
    "merged_scores": """
        with s as (select s_suppkey, (s_suppkey % 50) / 50 as s from supplier where s_suppkey % 3 <> 0), m as (select s_suppkey, (s_suppkey % 37) / 37 as m from supplier where s_suppkey % 4 <> 0)
        select s_suppkey, round(case when s is null then least(0.34, 0.5 * m) else 0.8::double * s + 0.2::double * coalesce(m, 0) end, 6) as score, case when s is null then 'learned' when m is null then 'service' else 'both' end as origin from s full join m using (s_suppkey)""",
    "source_registry": """
        select source, count(*) as n_files, sum(n_chars)::bigint as total_bytes, sha256(string_agg(h, '' order by h)) as digest from (select source, n_chars, sha256(coalesce(text, '')) as h from documents where source is not null) group by 1""",
    "upsert": """
        select c_custkey, c_name, case when c_custkey % 10 = 0 then c_acctbal + 1 else c_acctbal end as c_acctbal from customer
        union all select c_custkey + 1000000, c_name, c_acctbal from customer where c_custkey % 50 = 0""",
    "field_audit": " union all ".join(
        f"select '{c}' as field, count(*) as n_rows, count(*) filter ({c} is null) as n_null, count(*) filter (trim({c}::varchar, ' ') = '') as n_blank, count(distinct {c}) as n_distinct from genes"
        for c in ("symbol", "description", "biotype", "entrez_gene_id", "updated_at", "chromosome")
    ),
    "coverage_matrix": """
        with l as (select distinct lang from documents where lang is not null), s as (select distinct source from documents where source is not null)
        select lang, source, (select count(*) from documents d where d.lang = l.lang and d.source = s.source) as n, (select count(*) from documents d where d.lang = l.lang and d.source = s.source) > 0 as covered from l, s""",
    "regression_compare": """
        with a as (select o_orderpriority as metric, count(*)::double as before from orders where year(o_orderdate) = 1995 group by 1), b as (select o_orderpriority as metric, count(*)::double as after from orders where year(o_orderdate) = 1997 and o_orderpriority not like '1%' group by 1)
        select metric, before, after, after - before as change, case when before is null then 'added' when after is null then 'removed' when (after - before) * (case when metric = '2-HIGH' then -1 else 1 end) > 5 then 'improved'
          when (after - before) * (case when metric = '2-HIGH' then -1 else 1 end) < -5 then 'regressed' else 'same' end as verdict from a full join b using (metric)""",
    "release_gates": """
        with v as (select 'documents' as "check", count(*)::double as value, 500.0::double as least from documents union all select 'with_text', avg((length(text) > 0)::int), 0.9::double from documents union all select 'sources', count(distinct source), 50.0::double from documents)
        select *, value >= least as passed from v""",
    "contract_failures": """
        with t as (select distinct concat_ws('|', chemical_uid, xref_source, xref_id) as k, source_record_uid, xref_id from chemical_xrefs)
        select k, 'has_record' as rule from t where source_record_uid is null union all select k, 'has_digit' from t where not coalesce(regexp_matches(xref_id, '[0-9]'), false)""",
    "gold_recall": """
        with r as (select l_suppkey, l_partkey, row_number() over (partition by l_suppkey order by sum(l_quantity) desc, l_partkey) as r from lineitem group by 1, 2), g as (select distinct l_suppkey, l_partkey from lineitem where l_discount >= 0.1),
        f as (select l_suppkey, count(*) as n_found from r join g using (l_suppkey, l_partkey) where r <= 20 group by 1), n as (select l_suppkey, count(*) as n from r where r <= 20 group by 1)
        select l_suppkey, count(*) as n_expected, coalesce(max(n_found), 0) as n_found, round(coalesce(max(n_found), 0) / max(n), 6) as precision, round(coalesce(max(n_found), 0) / count(*), 6) as recall from g left join f using (l_suppkey) left join n using (l_suppkey) group by 1""",
    "unsourced_numbers": f"""
        with s as (select distinct doc_id, article_uid, unnest(regexp_extract_all(text, {_NUM})) as number from documents)
        select doc_id, number from s where not exists (select 1 from s o where o.article_uid = s.article_uid and o.number = s.number and o.doc_id <> s.doc_id)""",
    "oriented_effects": """
        select l_orderkey, l_linenumber, round(case when l_returnflag = 'F' then l_discount - 0.05::double else -(l_discount - 0.05::double) end, 4) as effect from lineitem where l_returnflag = 'F' or l_linestatus = 'F'""",
    "differential_selection": f"""
        with {_DIFF}, r as (select *, (row_number() over (partition by g order by q, abs(effect) desc, l_partkey))::int as rank from x where q <= 0.05 and abs(effect) >= 0.02)
        select g, l_partkey, round(effect, 4) as effect, q, rank, case when effect > 0 then 'up' else 'down' end as direction from r where rank <= 25""",
    "differential_rejected": f"""
        with {_DIFF} select g, count(*) as n_rows, count(*) filter (q is null or effect is null) as n_missing, count(*) filter (q > 0.05) as n_not_significant, count(*) filter (q <= 0.05 and abs(effect) < 0.02) as n_small from x group by 1""",
    "over_representation": f"""
        with m as (select distinct l_suppkey, l_partkey from lineitem), c as (select p_partkey as l_partkey from part where p_size <= 10), u as (select count(*) as nn from part),
        k as (select count(*) as n from c where l_partkey in (select l_partkey from m)),
        s as (select l_suppkey, count(*) as size, count(c.l_partkey) as overlap from m left join c using (l_partkey) group by 1),
        p as (select l_suppkey, size, overlap, overlap / size as coverage, case when overlap = 0 then 1 else least(1, (select sum(exp({lnc("size", "i")} + {lnc("nn - size", "n - i")} - {lnc("nn", "n")})) from range(0, 2001) t(i) where i >= overlap and i <= least(size, n) and n - i <= nn - size)) end as p_value from s, u, k),
        r as (select *, rank() over (order by p_value) + count(*) over (partition by p_value) - 1 as r, count(*) over () as nn from p)
        select l_suppkey, size, overlap, round(coverage, 6) as coverage, round(p_value, 6) as p_value, round(min(least(1, p_value * nn / r)) over (order by p_value desc), 6) as fdr from r""",
}
