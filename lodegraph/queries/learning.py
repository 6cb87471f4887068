"""Candidate relations of parts and suppliers: labels, splits, features, scores and their measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.keys import hash_bucket
from lodegraph.operators import learning as L
from lodegraph.operators import metrics as M
from lodegraph.runtime import table

C = F.col


def _candidates(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(
        F.count("*").alias("sentences"), F.count_distinct("l_orderkey").alias("articles"), F.max("l_discount").alias("best"), F.max(F.year("l_shipdate")).alias("year")
    )
    uid = F.concat(F.lit("p"), "l_partkey", F.lit("-s"), "l_suppkey")
    c = c.withColumn("uid", uid).withColumn("p", F.least(F.lit(0.99), 0.25 * C("sentences") + 6 * C("best")))
    c, b = c.withColumn("_b", hash_bucket(C("uid"), 8, 10)), C("_b")  # a column of its own, so that it is worked out once
    c = c.withColumn("known", hash_bucket(C("l_partkey").cast("string"), 8, 5) < 2).withColumn(
        "support_class",
        F.when(b == 0, "refute").when(b == 1, "background_candidate").when(b == 2, "unresolved").when(b <= 4, "confirm").when(b == 5, "support_direction").otherwise("novel_candidate"),
    )
    return c.drop("_b")


def _labelled(spark, d):
    return _with_labels(_candidates(spark, d))


def _with_labels(c):
    label = L.weak_label(C("support_class"), C("p"), C("articles"), C("sentences"), C("known").cast("int"))
    return c.select("*", label.alias("_l")).select(*c.columns, "_l.weak_label", "_l.label_score", "_l.label_reason")


def weak_labels(spark: SparkSession, d: str) -> DataFrame:
    c = _labelled(spark, d)
    return c.select("uid", "weak_label", "label_score", "label_reason", L.five_class(C("weak_label"), C("label_reason")).alias("weak_label_class"))


def label_summary(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).groupBy("support_class", "weak_label").agg(F.count("*").alias("n"), F.max("p").alias("max_p"))


def group_splits(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d)
    return c.select("uid", L.split_of(C("l_partkey").cast("string"), C("year"), C("l_suppkey").cast("string"), 1998).alias("split"))


def temporal_holdout(spark: SparkSession, d: str) -> DataFrame:
    c = _labelled(spark, d).withColumn("held_out", C("year") >= 1998)
    return c.groupBy("held_out", "weak_label").agg(F.count("*").alias("n"))


def hashed_negatives(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d).filter("known").select(F.concat(F.lit("p"), "l_partkey").alias("subject"), F.lit("supplied_by").alias("predicate"), F.concat(F.lit("s"), "l_suppkey").alias("object"), F.lit("supplier").alias("object_type"))
    pool = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("entity"), F.lit("supplier").alias("type"))
    return L.hashed_negatives(c, pool)


def pair_features(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem")
    by_part = i.groupBy("l_partkey").agg(F.collect_set(F.pmod("l_suppkey", F.lit(13))).alias("a"), F.count("*").alias("deg_p"))
    by_supp = i.groupBy("l_suppkey").agg(F.collect_set(F.pmod("l_partkey", F.lit(13))).alias("b"), F.count("*").alias("deg_s"))
    c = _candidates(spark, d).join(by_part, "l_partkey").join(by_supp, "l_suppkey")
    j = L.jaccard(C("a"), C("b"))
    low = F.log1p(F.least("deg_p", "deg_s"))
    pr = L.prior(F.log1p("sentences"), low, j, j / 5, C("known").cast("double"), F.lit(0.0), (C("year") >= 1998).cast("double"))
    return c.select("uid", F.round(j, 6).alias("jaccard"), F.round(low, 6).alias("degree_min_log"), F.round(pr, 6).alias("prior"))


def sample_weights(spark: SparkSession, d: str) -> DataFrame:
    c = _labelled(spark, d).filter("weak_label <> 'abstain'")
    out = L.sample_weights(c, ["support_class", "weak_label"], C("weak_label") == "strong_positive")
    return out.groupBy("support_class", "weak_label").agg(F.count("*").alias("n"), F.round(F.max("weight"), 6).alias("weight"))


def capped_scores(spark: SparkSession, d: str) -> DataFrame:
    c = _labelled(spark, d)
    return c.select("uid", L.capped(C("p"), C("weak_label")).alias("score"))


def debiased_ranking(spark: SparkSession, d: str) -> DataFrame:
    c = _labelled(spark, d).groupBy(C("l_suppkey").alias("supplier")).agg(
        F.max("p").alias("raw"), F.count_if(C("weak_label").endswith("positive")).alias("pos"), F.count("*").alias("cand"), F.sum("sentences").alias("support"), F.sum("articles").alias("deg"), F.count_if("known").alias("ment")
    )
    out = L.debias(c, "raw", "pos", "cand", "support", "deg", "ment", F.pmod("supplier", F.lit(7)) == 0, F.pmod("supplier", F.lit(11)) == 0)
    return out.select("supplier", F.round("debiased", 6).alias("debiased"))


def contextual_scores(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d).withColumn("r", hash_bucket(C("uid"), 8, 40))
    evidence = L.evidence_strength(C("p"), C("articles"))
    score = L.contextual(C("r"), C("best"), C("sentences"), evidence, C("p"), F.pow(F.lit(10.0), -C("r") / 4), C("known").cast("double"))
    return c.select("uid", F.round(score, 6).alias("score"), L.evidence_tier(F.round(score, 6), F.round(evidence, 6), C("p")).alias("tier"))


def entity_rollup(spark: SparkSession, d: str) -> DataFrame:
    out = L.entity_rollup(_candidates(spark, d), "l_partkey", "p", "l_suppkey")
    return out.withColumn("mean", F.round(C("mean") + 1e-9, 6))


def signal_entities(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "sentence_mentions").select("mention_uid", "entity_uid", "article_uid", "section").dropDuplicates(["mention_uid"])
    c = m.groupBy("entity_uid").agg(F.count("*").alias("mentions"), F.count_distinct("article_uid").alias("degree"), F.count_if(C("section") == "results").alias("support"))
    s = c.select("entity_uid", F.round(L.signal_score(C("degree"), C("mentions"), C("support"), F.lit(0)), 6).alias("signal"))
    return s.orderBy(F.desc("signal"), F.asc("entity_uid")).limit(300)


def top_terms(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "sentence_mentions").select("mention_uid", "article_uid", "entity_uid").dropDuplicates(["mention_uid"])
    return L.top_terms(m, "article_uid", "entity_uid")


def _scored(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", "o_custkey", (F.floor(C("o_totalprice") / 1000) / 600).alias("score"), (C("o_orderstatus") == "F").cast("int").alias("y"), F.when(C("o_orderstatus") == "F", 2).when(C("o_orderstatus") == "P", 1).otherwise(0).alias("label"), F.pmod("o_orderkey", F.lit(97)).alias("other"))


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.roc_auc(_scored(spark, d), "score", "y"))


def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.average_precision(_scored(spark, d), "score", "y"))


def best_f1(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.best_f1(_scored(spark, d), "score", "y"))


def precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.precision_at(_scored(spark, d), "score", "y", "o_orderkey", [5, 20, 100, 500]))


def ranking_quality(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.ranking_metrics(_scored(spark, d), "o_custkey", "score", "label", "o_orderkey"))


def calibration_error(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.calibration(_scored(spark, d), "score", "label"))


def spearman(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.spearman(_scored(spark, d), "score", "other"))


def top_overlap(spark: SparkSession, d: str) -> DataFrame:
    return M.top_overlap(_scored(spark, d), "o_orderkey", "score", "other", 200)


def pairwise_accuracy(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d).withColumn("g", F.pmod("o_custkey", F.lit(25)))
    return _rounded(M.pairwise_accuracy(s.filter("y = 1"), s.filter("y = 0"), ["g"], "score"))


def distribution_audit(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.distribution_audit(table(spark, d, "documents"), ["lang", "source", "section"]))


QUERIES = {f.__name__: f for f in (
    weak_labels, label_summary, group_splits, temporal_holdout, hashed_negatives, pair_features, sample_weights, capped_scores, debiased_ranking,
    contextual_scores, entity_rollup, signal_entities, top_terms, roc_auc, average_precision, best_f1, precision_at_k, ranking_quality,
    calibration_error, spearman, top_overlap, pairwise_accuracy, distribution_audit,
)}

_B = "('0x' || left(sha256({x}), {k}))::bigint % {n}"
b = lambda x, n, k=8: _B.format(x=x, n=n, k=k)
_CAND = f"""
    c0 as (select l_partkey, l_suppkey, count(*) as sentences, count(distinct l_orderkey) as articles, max(l_discount) as best, max(year(l_shipdate))::int as year, 'p' || l_partkey || '-s' || l_suppkey as uid from lineitem group by 1, 2),
    c as (select *, least(0.99::double, 0.25::double * sentences + 6 * best) as p, {b("l_partkey::varchar", 5)} < 2 as known,
      case {b("uid", 10)} when 0 then 'refute' when 1 then 'background_candidate' when 2 then 'unresolved' when 3 then 'confirm' when 4 then 'confirm' when 5 then 'support_direction' else 'novel_candidate' end as support_class from c0),
    lab as (select *, case when support_class = 'refute' then 'negative_refute' when support_class in ('confirm', 'support_direction') and p >= 0.85 and articles >= 2 and known then 'strong_positive'
      when support_class in ('confirm', 'support_direction') and p >= 0.7 and sentences >= 2 then 'medium_positive' when support_class = 'novel_candidate' and p >= 0.75 and articles >= 2 then 'weak_positive'
      when p >= 0.9 and articles >= 3 then 'weak_positive' else 'abstain' end as weak_label from c)"""
_SCORED = "s as (select o_orderkey, o_custkey, floor(o_totalprice / 1000) / 600 as score, (o_orderstatus = 'F')::int as y, case o_orderstatus when 'F' then 2 when 'P' then 1 else 0 end as label, o_orderkey % 97 as other from orders)"
_CUM = f"{_SCORED}, g as (select score, sum(y) as pos, sum(1 - y) as neg from s group by 1), cum as (select *, sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp, sum(pos) over () as p, sum(neg) over () as n from g)"

ORACLES = {
    "weak_labels": f"""
        with {_CAND}, r as (select uid, weak_label, case weak_label when 'strong_positive' then 'curated_and_literature' when 'medium_positive' then 'literature_support' when 'negative_refute' then 'literature_refute'
          when 'abstain' then 'insufficient_or_context_only' else case when support_class = 'novel_candidate' and p >= 0.75 and articles >= 2 then 'novel_literature_candidate' else 'high_literature_probability' end end as label_reason from lab)
        select uid, weak_label, (case label_reason when 'curated_and_literature' then 1 when 'literature_support' then 0.78 when 'novel_literature_candidate' then 0.58 when 'high_literature_probability' then 0.55 else 0 end)::double as label_score, label_reason,
          case when weak_label = 'negative_refute' then 'contradicted' when weak_label = 'abstain' then 'insufficient_evidence' else 'supported' end as weak_label_class from r""",
    "label_summary": f"with {_CAND} select support_class, weak_label, count(*) as n, max(p) as max_p from lab group by 1, 2",
    "group_splits": f"""
        with {_CAND} select uid, case when year >= 1998 then 'temporal_holdout' when {b("l_suppkey::varchar", 20, 12)} = 0 then 'context_holdout' when {b("l_partkey::varchar", 100, 12)} < 15 then 'test'
          when {b("l_partkey::varchar", 100, 12)} < 30 then 'validation' else 'train' end as split from c""",
    "temporal_holdout": f"with {_CAND} select year >= 1998 as held_out, weak_label, count(*) as n from lab group by 1, 2",
    "hashed_negatives": f"""
        with {_CAND}, k as (select 'p' || l_partkey as subject, 's' || l_suppkey as object from c where known),
        pool as (select row_number() over (order by 's' || s_suppkey) - 1 as pos, 's' || s_suppkey as entity, count(*) over () as size from supplier),
        dr as (select subject, object, draw, step, (('0x' || left(sha256(subject || '|supplied_by|' || object || '|' || draw), 12))::bigint % 1000000000 + step) % (select max(size) from pool) as pos from k, range(2) w(draw), range(100) t(step)),
        h as (select dr.subject, dr.object, draw, step, entity from dr join pool using (pos) where not exists (select 1 from k where k.subject = dr.subject and k.object = entity))
        select distinct subject, 'supplied_by' as predicate, arg_min(entity, step) as object, 'supplier' as object_type from h group by subject, h.object, draw""",
    "pair_features": f"""
        with {_CAND}, bp as (select l_partkey, list(distinct l_suppkey % 13) as a, count(*) as deg_p from lineitem group by 1), bs as (select l_suppkey, list(distinct l_partkey % 13) as b, count(*) as deg_s from lineitem group by 1),
        f as (select c.*, len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) as j, ln(1 + least(deg_p, deg_s)) as low from c join bp using (l_partkey) join bs using (l_suppkey))
        select uid, round(j, 6) as jaccard, round(low, 6) as degree_min_log, round(least(1, 0.18::double * least(1, ln(1 + sentences) / 5) + 0.16::double * least(1, low / 5) + 0.16::double * least(1, 2.5::double * j) + 0.18::double * least(1, j) + 0.12::double * known::int + 0.1::double * (year >= 1998)::int), 6) as prior from f""",
    "sample_weights": f"""
        with {_CAND}, g as (select support_class, weak_label, count(*) as n from lab where weak_label <> 'abstain' group by 1, 2)
        select support_class, weak_label, n, round((case when weak_label = 'strong_positive' then 1.5 else 1 end)::double * greatest(0.35, least(6, sqrt((sum(n) over ())::double / (count(*) over ()) / n))), 6) as weight from g""",
    "capped_scores": f"with {_CAND} select uid, least(p, (case weak_label when 'strong_positive' then 1 when 'medium_positive' then 0.82 when 'weak_positive' then 0.62 when 'negative_refute' then 0.05 else 0.25 end)::double) as score from lab",
    "debiased_ranking": f"""
        with {_CAND}, g as (select l_suppkey as supplier, max(p) as raw, count(*) filter (weak_label like '%positive') as pos, count(*) as cand, sum(sentences) as support, sum(articles) as deg, count(*) filter (known) as ment from lab group by 1),
        h as (select *, pos / sqrt(greatest(cand, 1)) as den from g)
        select supplier, round(raw * (0.55::double + 0.45::double * den / max(den) over ()) * (0.85::double + 0.15::double * support / max(support) over ()) * (case when supplier % 7 = 0 then 0.65 else 1 end)::double * (case when supplier % 11 = 0 then 0.72 * 0.82 else 1 end)::double
          / (1 + 0.1::double * ln(1 + cand) + 0.04::double * ln(1 + deg) + 0.05::double * ln(1 + ment)), 6) as debiased from h""",
    "contextual_scores": f"""
        with {_CAND}, r as (select *, {b("uid", 40)} as r, least(1, p * (0.65::double + 0.08::double * ln(1 + articles))) as ev from c),
        q as (select uid, round(0.3::double / log2(r + 2) + 0.18::double * least(1, best + 0.08::double * sentences) + 0.16::double * ev + 0.16::double * p + 0.1::double * least(1, (r / 4) / 8) + 0.1::double * known::int, 6) as score, round(ev, 6) as ev, p from r)
        select uid, score, case when score >= 0.75 and ev >= 0.65 then 'strong' when score >= 0.45 and (ev >= 0.35 or p >= 0.5) then 'medium' else 'exploratory' end as tier from q""",
    "entity_rollup": f"""
        with {_CAND} select l_partkey, max(p) as best, round(avg(p) + 1e-9::double, 6) as mean, count(*) as n, count(*) filter (p >= 0.5) as n_high, arg_min(l_suppkey, (-p, l_suppkey)) as best_partner from c group by 1""",
    "signal_entities": """
        with m as (select distinct mention_uid, entity_uid, article_uid, section from sentence_mentions),
        g as (select entity_uid, count(*) as mentions, count(distinct article_uid) as degree, count(*) filter (section = 'results') as support from m group by 1)
        select entity_uid, round(ln(1 + degree) + 2 * ln(1 + mentions) + 3 * ln(1 + support), 6) as signal from g order by signal desc, entity_uid limit 300""",
    "top_terms": """
        with m as (select distinct mention_uid, article_uid, entity_uid from sentence_mentions),
        c as (select article_uid, entity_uid, count(*) as n, row_number() over (partition by article_uid order by count(*) desc, entity_uid) as r from m group by 1, 2),
        t as (select article_uid, r, trim(repeat(entity_uid || ' ', least(3, floor(ln(1 + n)) + 1)::int)) as t from c where r <= 24)
        select article_uid, string_agg(t, ' ' order by r) as document from t group by 1""",
    "roc_auc": f"with {_CUM} select round(1 - sum(pos * (fp - neg / 2)) / (max(p) * max(n)), 6) as auc, max(p)::bigint as positives, max(n)::bigint as negatives from cum",
    "average_precision": f"with {_CUM} select round(sum(pos * tp / (tp + fp)) / max(p), 6) as average_precision from cum",
    "best_f1": f"with {_CUM} select round(score, 6) as threshold, round(2 * tp / (tp + fp + p), 6) as f1 from cum order by round(2 * tp / (tp + fp + p), 9) desc, score desc limit 1",
    "precision_at_k": f"""
        with {_SCORED}, r as (select *, row_number() over (order by score desc, o_orderkey) as r from s)
        select k::int as k, round(avg(y), 6) as precision, round(avg(y) / (select avg(y) from s), 6) as lift from r, (values (5), (20), (100), (500)) v(k) where r <= k group by 1""",
    "ranking_quality": f"""
        with {_SCORED}, r as (select *, row_number() over (partition by o_custkey order by score desc, o_orderkey) as r, row_number() over (partition by o_custkey order by label desc) as i from s)
        select o_custkey, round(avg((label = 2)::int) filter (r <= 5), 6) as precision,
          round(coalesce(sum((pow(2, label) - 1) / log2(r + 1)) filter (r <= 10) / nullif(sum((pow(2, label) - 1) / log2(i + 1)) filter (i <= 10), 0), 0), 6) as ndcg,
          round(coalesce(1 / min(r) filter (label = 2), 0), 6) as reciprocal_rank from r group by 1""",
    "calibration_error": f"""
        with {_SCORED}, q as (select *, least(9, floor(score * 10)) as b from s),
        g as (select b, count(*) as n, avg(score) as x, avg((label = 2)::int) as y, sum((score - (label = 2)::int) ** 2) as sq, sum(abs(score - label / 2)) as ab, count(*) filter (label = 0 and score >= 0.45) as o from q group by 1)
        select round(sum(n * abs(x - y)) / sum(n), 6) as ece, round(sum(sq) / sum(n), 6) as brier, round(sum(ab) / sum(n), 6) as mae, round(sum(o) / sum(n), 6) as overclaim_rate from g""",
    "spearman": f"""
        with {_SCORED}, r as (select rank() over (order by score) + (count(*) over (partition by score) - 1) / 2 as ra, rank() over (order by other) + (count(*) over (partition by other) - 1) / 2 as rb from s)
        select round(corr(ra, rb), 6) as spearman from r""",
    "top_overlap": f"""
        with {_SCORED}, a as (select o_orderkey from s order by score desc, o_orderkey limit 200), q as (select o_orderkey from s order by other desc, o_orderkey limit 200)
        select count(*) / 200 as overlap from a join q using (o_orderkey)""",
    "pairwise_accuracy": f"""
        with {_SCORED}, t as (select *, o_custkey % 25 as g from s)
        select count(*) as pairs, round(avg(case when a.score > z.score then 1.0 when a.score = z.score then 0.5 else 0 end), 6) as accuracy from t a join t z on a.g = z.g and a.y = 1 and z.y = 0""",
    "distribution_audit": " union all ".join(f"select '{c}' as \"column\", {c} as value, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from documents group by {c}" for c in ("lang", "source", "section")),
}
