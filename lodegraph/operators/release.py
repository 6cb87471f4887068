"""Releases: registry, upsert, audits, gates and comparison of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.runtime import Scratch


def source_registry(files: DataFrame, source: str, size: str, digest: str) -> DataFrame:
    """source, n_files, total_bytes, digest: the SHA-256 of the sorted digests of a source's files."""
    return files.groupBy(source).agg(
        F.count("*").alias("n_files"), F.sum(size).alias("total_bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list(digest)), ""), 256).alias("digest")
    )


def content_digest(df: DataFrame) -> DataFrame:
    """n_rows, digest of a table that doesn't depend on the order of its rows.

    The rows' 64-bit hashes are summed in halves, in parallel.
    """
    h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)])
    low, high = h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32)
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(low), F.lit(0)).alias("low"), F.coalesce(F.sum(high), F.lit(0)).alias("high")).select(
        "n_rows", F.sha2(F.concat_ws("|", "n_rows", "low", "high"), 256).alias("digest")
    )


def upsert(base: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """base with the rows of delta in place of those of the same key. Applying it twice changes nothing more."""
    return base.join(delta.select(*keys).distinct(), list(keys), "left_anti").unionByName(delta)


def write_upsert(spark: SparkSession, path: str, delta: DataFrame, keys: Sequence[str]) -> int:
    """Upsert a Parquet table in place by way of a durable copy; returns its rows. A missing table is made."""
    try:
        base = spark.read.parquet(path)
    except Exception:
        base = delta.limit(0)
    staged = Scratch(spark, "upsert").save(upsert(base, delta, keys))
    staged.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).count()


def build_notes(checks: Sequence[tuple[str, str, DataFrame]], spark: SparkSession) -> DataFrame:
    """severity, component, message: a note for each (severity, component, table of problems) with the number of problems."""
    out = None
    for severity, component, problems in checks:
        n = problems.agg(F.count("*").alias("n"))
        note = n.select(F.lit(severity).alias("severity"), F.lit(component).alias("component"), F.concat(F.col("n").cast("string"), F.lit(" rows")).alias("message")).filter("message <> '0 rows'")
        out = note if out is None else out.unionByName(note)
    return out if out is not None else spark.createDataFrame([], "severity string, component string, message string")


def field_audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """field, n_rows, n_null, n_blank, n_distinct of some columns, in one pass for the counts."""
    cells = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("v")) for c in columns]
    long = df.select(F.inline(F.array(*cells)))
    return long.groupBy("field").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("v").isNull()).alias("n_null"), F.count_if(F.trim("v") == "").alias("n_blank"), F.count_distinct("v").alias("n_distinct")
    )


def coverage_matrix(df: DataFrame, row: str, column: str, required: DataFrame) -> DataFrame:
    """row, column, n, covered for each required cell."""
    n = df.groupBy(row, column).agg(F.count("*").alias("n"))
    out = required.select(row, column).distinct().join(n, [row, column], "left")
    return out.select(row, column, F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.col("n").isNotNull().alias("covered"))


def requirements(df: DataFrame, row: str, column: str) -> DataFrame:
    """Every pair of the values of two columns; both sides are distinct values, joined by a constant."""
    a = df.select(row).filter(F.col(row).isNotNull()).distinct().withColumn("_one", F.lit(1))
    b = df.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("_one", F.lit(1))
    return a.join(b, "_one").drop("_one")


def compare_runs(before: DataFrame, after: DataFrame, tolerance: float, lower_is_better: Sequence[str] = ()) -> DataFrame:
    """metric, before, after, change, verdict (improved, same, regressed, added, removed) of two tables (metric, value)."""
    both = before.select("metric", F.col("value").alias("before")).join(after.select("metric", F.col("value").alias("after")), "metric", "full")
    change = F.col("after") - F.col("before")
    good = F.when(F.col("metric").isin(*lower_is_better) if lower_is_better else F.lit(False), -change).otherwise(change)
    verdict = (
        F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(good > tolerance, "improved").when(good < -tolerance, "regressed").otherwise("same")
    )
    return both.select("metric", "before", "after", change.alias("change"), verdict.alias("verdict"))


def gate_rows(df: DataFrame, checks: Sequence[tuple[str, Column, float]]) -> DataFrame:
    """check, value, least, passed: each (name, aggregate, least value) over a table."""
    named = df.agg(*[c.cast("double").alias(n) for n, c, _ in checks])
    cells = [F.struct(F.lit(n).alias("check"), F.col(n).alias("value"), F.lit(float(least)).alias("least")) for n, _, least in checks]
    return named.select(F.inline(F.array(*cells))).withColumn("passed", F.coalesce(F.col("value") >= F.col("least"), F.lit(False)))


def contract_failures(df: DataFrame, key: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """key, rule: a row for each rule that a row breaks."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), n) for n, ok in rules]))
    return df.select(key, F.explode(broken).alias("rule"))


def gold_recall(found: DataFrame, gold: DataFrame, case: str, entity: str, rank: str, k: int) -> DataFrame:
    """case, n_expected, n_found, precision, recall of the k best entities of each case against its expected ones."""
    top = found.filter(F.col(rank) <= k).select(case, entity).distinct()
    want = gold.select(case, entity).distinct()
    hits = top.join(want, [case, entity]).groupBy(case).agg(F.count("*").alias("n_found"))
    out = want.groupBy(case).agg(F.count("*").alias("n_expected")).join(hits, case, "left").join(top.groupBy(case).agg(F.count("*").alias("_n")), case, "left").na.fill(0)
    return out.select(case, "n_expected", "n_found", F.when(F.col("_n") > 0, F.col("n_found") / F.col("_n")).otherwise(0.0).alias("precision"), (F.col("n_found") / F.col("n_expected")).alias("recall"))


def numbers_without_source(texts: DataFrame, key: str, text: str, allowed: DataFrame) -> DataFrame:
    """key, number: numbers in a text that its sources (key, number as text) don't have."""
    said = texts.select(key, F.explode(F.regexp_extract_all(text, F.lit("([0-9]+(?:[.][0-9]+)?)"), 1)).alias("number")).distinct()
    return said.join(allowed.select(key, "number").distinct(), [key, "number"], "left_anti")
