"""Delimited files, JSON lines and Parquet, with tolerant headers and optional tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def snake(name: str) -> str:
    """A header in lower case with `_` for runs of other signs; the byte order mark goes."""
    return re.sub(r"[^a-z0-9]+", "_", name.lstrip("\ufeff").strip().casefold()).strip("_")


def unique(names: Sequence[str]) -> list[str]:
    """Names made different by a number: repeated headers keep their columns."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        n = n or "column"
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def read_delimited(spark: SparkSession, path: str, sep: str = ",", fill: bool = False) -> DataFrame:
    """A delimited file with a header (gzip by its ending), headers as snake case, all strings; fill: null as ''."""
    df = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", sep == ",").csv(path)
    df = df.toDF(*unique([snake(c) for c in df.columns]))
    return df.na.fill("") if fill else df


def read_headerless(spark: SparkSession, path: str, columns: Sequence[str], sep: str = "\t") -> DataFrame:
    """A delimited file without a header; missing columns at the end of a line are null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("sep", sep).option("quote", "").csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Objects of a JSON lines file, keys as snake case; lines that aren't objects are dropped."""
    lines = spark.read.text(path).filter(F.trim("value").startswith("{"))
    if schema is None:
        schema = spark.read.option("mode", "DROPMALFORMED").json(path).schema
    # a line that can't be read parses to a struct of nulls only
    parsed = lines.select(F.from_json("value", schema).alias("o")).select("o.*")
    parsed = parsed.dropna("all")
    return parsed.toDF(*unique([snake(c) for c in parsed.columns]))


def read_parquet_tolerant(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet files, those that can't be read left out; audit the number of files with :func:`unreadable_files`."""
    reader = spark.read.option("ignoreCorruptFiles", True)
    return (reader.schema(schema) if schema else reader).parquet(path)


def unreadable_files(spark: SparkSession, path: str) -> DataFrame:
    """file: Parquet files without the closing mark of the format."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.filter(F.expr("length < 12 or decode(substring(content, -4, 4), 'ISO-8859-1') <> 'PAR1'")).select(F.col("path").alias("file"))


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one of the schema where there is none; columns that it lacks are null."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    df = spark.read.parquet(path)
    wanted = T.StructType.fromDDL(schema)
    return df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted])


def infer_input_mode(columns: Sequence[str]) -> str:
    """What a user's table is keyed by: trait, identifier, feature (m/z) or name, in this order."""
    have = {snake(c) for c in columns}
    if have & {"trait", "accession_id", "reported_trait"}:
        return "trait"
    if have & {"hmdb_id", "chebi_id", "hmdb", "chebi", "pubchem_cid", "kegg_id", "inchikey"}:
        return "identifier"
    if have & {"mz", "m_z", "precursor_mz"}:
        return "feature"
    return "name" if have & {"name", "metabolite", "compound", "input_name"} else "unknown"
