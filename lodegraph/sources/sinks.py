"""Writers: tables of a declared schema with their manifest rows, CSV and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def conform(df: DataFrame, schema: str) -> DataFrame:
    """df with exactly the columns of a schema, cast to its types; missing columns are null, others are left out."""
    return df.select(*[
        (F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)
    ])


def write_table(df: DataFrame, path: str, schema: str) -> DataFrame:
    """Write Parquet (snappy) of a declared schema, in place of what is there; returns the manifest row.

    An empty table keeps its schema.  Manifest: path, rows, files, bytes, digest
    (of the rows, whatever their order).
    """
    from lodegraph.operators.release import content_digest

    spark = df.sparkSession
    conform(df, schema).write.mode("overwrite").option("compression", "snappy").parquet(path)
    back = spark.read.schema(schema).parquet(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(content_digest(back)).join(one(files), "_one").select(F.lit(path).alias("path"), F.col("n_rows").alias("rows"), "files", "bytes", "digest")


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """CSV parts of fixed columns with headers; lists are joined by `|`."""
    types = dict(df.dtypes)
    flat = [F.array_join(c, "|").alias(c) if types[c].startswith("array") else F.col(c).cast("string").alias(c) for c in columns]
    df.select(*flat).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def markdown(df: DataFrame, order: Sequence, rows: int = 20) -> str:
    """A Markdown table of the first rows in an order."""
    top = df.orderBy(*order).limit(rows).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in top]) + "\n"


def unlisted_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """file, length: files of a folder that a manifest (file) doesn't list."""
    found = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    return found.join(manifest.select("file"), "file", "left_anti")


def write_bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int) -> None:
    """A managed table in buckets of its keys, sorted: joins and aggregates on the keys need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(name)
