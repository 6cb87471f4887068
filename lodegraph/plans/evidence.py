"""An evidence run: documents to sentences, mentions, relations and supported edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions import text as X
from lodegraph.operators import literature as L
from lodegraph.runtime import Scratch, widen
from lodegraph.sources.sinks import write_table

SCHEMAS = {
    "sentences": "doc_id long, sentence_no int, sentence string, n_tokens int",
    "mentions": "doc_id long, sentence_no int, entity_uid string, entity_type string, token_from int, token_to int, confidence double",
    "relations": "doc_id long, sentence_no int, subject_uid string, object_uid string, predicate string, polarity string, status string, p double",
    "support": "subject_uid string, predicate string, object_uid string, probability double, n_articles long, support_class string",
}


def relations_of(sentences: DataFrame, mentions: DataFrame, pairs: DataFrame, families: dict[str, str], minimum: float = 0.20) -> DataFrame:
    """doc_id, sentence_no, subject_uid, object_uid, predicate, polarity, status, p of the pairs in sentences with a trigger.

    families: predicate -> family of triggers.  Distances are in signs of the
    sentence, from the offsets of the mentions' tokens.  sentences may have a
    section; without one it is full_text.
    """
    keys = ["doc_id", "sentence_no"]
    section = F.coalesce("section", F.lit("full_text")) if "section" in sentences.columns else F.lit("full_text")
    said = sentences.select(*keys, "sentence", section.alias("section"))
    placed = said.join(mentions.select(*keys).distinct(), keys, "left_semi").select(*keys, X.tokens_with_offsets(F.col("sentence")).alias("t"))
    m = mentions.join(placed, keys).select(*keys, "entity_uid", "entity_type", F.col("t")[F.col("token_from")]["start"].alias("start"), F.col("t")[F.col("token_to") - 1]["end"].alias("end"), "confidence")
    found = L.relation_pairs(m, keys, pairs, 240)
    counts = mentions.groupBy(*keys).agg(F.count("*").alias("n_mentions"), F.bool_or(F.col("entity_type") == "disease").alias("has_disease"))
    j = found.join(said, keys).join(counts, keys)
    hit = F.coalesce(*[F.when(F.col("predicate") == p, X.trigger(F.col("sentence"), f)) for p, f in families.items()])
    j = j.withColumn("hit", hit).filter("hit is not null").withColumn("status", X.assertion_status(X.cues(F.col("sentence"), F.col("section"))))
    signed = F.col("hit.polarity") != "association"
    p = L.relation_probability(
        F.col("hit.score"), F.col("section"), F.col("min_confidence"), X.oncology_weight(F.col("sentence"), F.col("has_disease")), signed, F.col("distance"), F.col("n_mentions"), X.certainty_weight(F.col("sentence"), F.col("status"))
    )
    return j.select(*keys, "subject_uid", "object_uid", "predicate", F.col("hit.polarity").alias("polarity"), "status", p.alias("p")).filter(F.col("p") >= minimum)


def build_evidence(spark: SparkSession, documents: DataFrame, lexicon: DataFrame, pairs: DataFrame, families: dict[str, str], known: DataFrame, out_dir: str) -> DataFrame:
    """Write the run's tables and their manifest; returns the manifest.

    documents: doc_id, text; lexicon: as made by ``build_lexicon``; pairs:
    subject_type, object_type, predicate; known: subject_uid, predicate, object_uid.
    """
    scratch = Scratch(spark, "evidence")
    sentences = scratch.save(L.split_sentences(widen(documents.select("doc_id", "text")), "doc_id", "text"))
    keys = ["doc_id", "sentence_no"]
    mentions = scratch.save(L.longest_matches(L.match_phrases(sentences, keys, "sentence", lexicon), keys))
    relations = scratch.save(relations_of(sentences, mentions, pairs, families))
    support = L.edge_support(relations.withColumn("article", F.col("doc_id").cast("string")), known)
    manifest = None
    for name, df in {"sentences": sentences, "mentions": mentions, "relations": relations, "support": support}.items():
        row = write_table(df, f"{out_dir}/{name}", SCHEMAS[name]).withColumn("table", F.lit(name))
        manifest = row if manifest is None else manifest.unionByName(row)
    manifest.write.mode("overwrite").parquet(f"{out_dir}/manifest")
    return spark.read.parquet(f"{out_dir}/manifest")
