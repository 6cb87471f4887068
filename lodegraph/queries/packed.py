"""Packed fields of cell_type_signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators.packed import unpack_fields
from lodegraph.runtime import table

TERMS, SYMBOLS = ("pathway_terms", "metabolite_terms", "context_terms"), ("target_symbols",)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = unpack_fields(table(spark, sf_dir, "cell_type_signatures"), "signature_id", TERMS, SYMBOLS)
    return rows.select("signature_id", "field_name", F.col("item_pos").cast("long").alias("item_pos"), "item_value")


def p3_notations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the values of each field are written, with the malformed ones."""
    rows = unpack_fields(table(spark, sf_dir, "cell_type_signatures"), "signature_id", TERMS, SYMBOLS)
    return rows.groupBy("field_name", "item_flag").agg(
        F.count("*").alias("n_values"), F.count_distinct("signature_id").alias("n_signatures")
    )


QUERIES = {"p3_found": p3_found, "p3_notations": p3_notations}
