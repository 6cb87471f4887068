"""Queries of the training-data operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.values import bare_number, is_missing, usable
from lodegraph.llm import canonical, components, mixing, packing, reading, spelling, term_counts, truth
from lodegraph.llm.oracles import ORACLES  # noqa: F401
from lodegraph.llm.tokens import token_count
from lodegraph.runtime import Scratch, table, widen


# 1: the reference entry of a freely typed name


def _named_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, labels = table(spark, sf_dir, "name_only_cases"), table(spark, sf_dir, "metabolite_gold_labels")
    return canonical.match_names(cases, "case_id", "input_name", labels, "label_id", "label", "short_code")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named_cases(spark, sf_dir).select("case_id", F.col("entry").alias("label_id"))


def p1_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the typed names are from their entries, and how many stay unmatched or tied."""
    ties = F.least("ties", F.lit(2)).alias("entries_up_to_2")
    return _named_cases(spark, sf_dir).groupBy("distance", ties).agg(F.count("*").alias("n_cases"))


# 2: one gene from the records that share a gene_uid


def _gene_claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(records, claims) of genes; a record sent again counts once."""
    columns = ("record_id", "gene_uid", "symbol", "description", "aliases", "source_name", "updated_at")
    genes = table(spark, sf_dir, "genes").select(*columns).dropDuplicates(["record_id"])
    names = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.when(usable(a), F.lower(F.trim(a))))
    known = F.array_sort(F.array_distinct(F.array_compact(names)))
    zero = F.lit(0)
    fields = {
        "symbol": (F.trim("symbol"), usable(F.col("symbol")), zero),
        "description": (F.trim("description"), usable(F.col("description")), zero),
        "aliases": (F.array_join(known, "|"), F.size(known) > 0, F.size(known)),
    }
    claims = truth.claims_of(genes, F.col("gene_uid"), F.col("source_name"), F.col("record_id"), F.col("updated_at"), fields)
    return genes, claims


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes, claims = _gene_claims(spark, sf_dir)
    ranks = table(spark, sf_dir, "source_trust").select(F.col("source_name").alias("source"), F.col("trust_rank").alias("rank"))
    truths, _ = truth.discover(claims, ranks)
    several = genes.filter("gene_uid is not null").groupBy("gene_uid").agg(F.count_distinct("record_id").alias("n")).filter("n >= 2").select("gene_uid")
    names = ("symbol", "description", "aliases")
    won = truths.groupBy(F.col("object").alias("gene_uid")).agg(
        *[F.max(F.when(F.col("field") == n, F.col("record"))).alias(f"{n}_record_id") for n in names]
    )
    return several.join(won, "gene_uid", "left").select(
        "gene_uid", *[F.coalesce(f"{n}_record_id", F.lit(0).cast("long")).alias(f"{n}_record_id") for n in names]
    )


def p2_free_truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The truths without the ranks of source_trust."""
    return truth.discover(_gene_claims(spark, sf_dir)[1])[0]


def p2_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.discover(_gene_claims(spark, sf_dir)[1])[1]


# 4: how often every term occurs


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = widen(table(spark, sf_dir, "sentence_mentions").select("mention_uid", "normalized_surface", "pmid"))
    pmid = bare_number(F.col("pmid"))
    total = mentions.select(pmid.alias("pmid")).agg(F.count_distinct("pmid")).head()[0]
    counts = term_counts.term_frequencies(mentions, spelling.consistent(F.col("normalized_surface")), pmid, F.col("mention_uid"))
    mark = term_counts.frequency_mark(F.col("records"), total)
    marked = counts.select("term", mark.alias("freq_mark"), F.col("occurrences").alias("mention_count"), F.col("records").alias("pmid_count"))
    return marked.filter("freq_mark is not null")


# 5: one group identifier for chemicals that share identifiers


def _with_identifier(rows: DataFrame, source: str, xref: str) -> DataFrame:
    """rows with identifier: `SOURCE:id` in one spelling (no case, blanks, source prefix, `.0` or leading zeros); null for a stand-in.

    Each step is a column of its own, so that it is worked out once.
    """
    flat = lambda c: F.upper(F.translate(c, " \t\n\x0b\x0c\r", ""))
    out = rows.withColumn("_name", flat(source)).withColumn("_bare", flat(xref))
    for _ in range(2):  # as in `MDB:MDB0001`
        rest = F.ltrim(F.substring("_bare", F.length("_name") + 1, F.length("_bare")), F.lit(":_#-"))
        out = out.withColumn("_bare", F.when((F.col("_name") != "") & F.col("_bare").startswith(F.col("_name")), rest).otherwise(F.col("_bare")))
    out = out.withColumn("_bare", F.when(F.col("_bare").contains("."), F.regexp_replace("_bare", r"^([0-9]+)\.0+$", "$1")).otherwise(F.col("_bare")))
    out = out.withColumn("_bare", F.when(F.col("_bare").contains("0"), F.regexp_replace("_bare", r"^([A-Z]*)0+(?=[0-9])", "$1")).otherwise(F.col("_bare")))
    missing = F.col("_name").isNull() | (F.col("_name") == "") | (F.rtrim(F.col("_bare"), F.lit("0")) == "") | is_missing(F.col(xref))
    return out.withColumn("identifier", F.when(~missing, F.concat("_name", F.lit(":"), "_bare"))).drop("_name", "_bare")


def _chemical_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "chemical_xrefs").filter("xref_type = 'exact'").select("chemical_uid", "xref_source", "xref_id")
    rows = _with_identifier(rows, "xref_source", "xref_id").select("chemical_uid", "identifier")
    return components.group_by_identifier(rows, "chemical_uid", "identifier")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chemical_groups(spark, sf_dir).filter("n_records >= 2").select("chemical_uid", "group_uid")


def p5_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _chemical_groups(spark, sf_dir).groupBy("group_uid").agg(F.max("n_records").alias("n_records"))
    return groups.groupBy("n_records").agg(F.count("*").alias("n_groups"))


# 6: one form of texts that look the same


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = spelling.inconsistent_texts(
        table(spark, sf_dir, "sentence_mentions"), "mention_uid", ("surface", "normalized_surface"), (), "sentence_mentions"
    )
    synonyms = spelling.inconsistent_texts(table(spark, sf_dir, "cid_properties"), "pubchem_cid", (), ("synonyms",), "cid_properties")
    return mentions.unionByName(synonyms).drop("text")


def p6_token_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each kind over all the fields of p6_found."""
    both = spelling.token_kinds(table(spark, sf_dir, "sentence_mentions"), ("surface", "normalized_surface"))
    both = both.unionByName(spelling.token_kinds(table(spark, sf_dir, "cid_properties"), (), ("synonyms",)))
    return both.groupBy("token_kind").agg(F.sum("n_tokens").alias("n_tokens"))


# 7: containers of 2,048 tokens


def _document_tokens(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents with their size in tokens, worked out once."""
    documents = widen(table(spark, sf_dir, "documents").select("doc_id", *columns, "text"))
    sized = documents.select("doc_id", *columns, token_count(F.col("text")).alias("n_tokens"))
    return Scratch(spark, "tokens").save(sized)


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_document_tokens(spark, sf_dir), "doc_id", "n_tokens", 2048)


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _packed(spark, sf_dir).withColumnsRenamed({"n_units": "n_tokens", "first_unit": "first_token"})
    return out.withColumn("n_tokens", F.col("n_tokens").cast("long"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, their room that stays unused, and the least number that the tokens need."""
    used = _packed(spark, sf_dir).groupBy("container_id").agg(F.sum("n_units").alias("used"), F.count("*").alias("pieces"))
    out = used.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.sum("pieces").alias("pieces"), F.max("used").alias("fullest"))
    return out.withColumn("least_containers", F.ceil(F.col("tokens") / 2048)).withColumn("unused_share", 1 - F.col("tokens") / (F.col("containers") * 2048))


# 8: sources at target shares of all tokens


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(_document_tokens(spark, sf_dir, "source"), "doc_id", "source", "n_tokens", table(spark, sf_dir, "mix_targets"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[0].withColumnRenamed("size", "n_tokens")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[1].withColumnsRenamed({"available": "tokens_available", "used": "tokens_used"})


# 9: reading level


def _reading_model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, reading.Model]:
    documents = widen(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return documents, reading.train(documents, table(spark, sf_dir, "reading_labels"), "doc_id", "text", "reading_level", "lang")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, model = _reading_model(spark, sf_dir)
    return reading.reading_levels(documents, "doc_id", "text", model).select("doc_id", "reading_level")


def p9_word_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The acquisition grade of each known word."""
    _, model = _reading_model(spark, sf_dir)
    return spark.createDataFrame([(w, round(g, 6)) for w, g in model.word_grade.items()], "word string, grade double")


QUERIES = {
    "p5_found": p5_found,
    "p5_group_sizes": p5_group_sizes,
    "p1_found": p1_found,
    "p1_distances": p1_distances,
    "p2_found": p2_found,
    "p2_free_truths": p2_free_truths,
    "p2_reliability": p2_reliability,
    "p4_found": p4_found,
    "p6_found": p6_found,
    "p6_token_kinds": p6_token_kinds,
    "p7_packed": p7_packed,
    "p7_fill": p7_fill,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_word_grades": p9_word_grades,
}

