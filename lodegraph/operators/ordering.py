"""Global order without a single task: dense indexes, top rows of groups, ordered samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.runtime import Scratch, fresh, task_count


def dense_index(df: DataFrame, order: Sequence[Column | str], name: str, rows_per_task: int = 1_000_000) -> DataFrame:
    """df with the place of each row (long, from 0) in a total order.

    Rows are range-sorted in parallel; only the number of rows of each partition
    comes to the driver.  Ties are broken by the order columns alone, which
    should therefore be a key.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "index")
    n = task_count(spark, df.count(), rows_per_task)
    ordered = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ordered = scratch.save(ordered.withColumn(name, F.monotonically_increasing_id()))
    part, place = fresh(df, "_part", "_start")
    ordered = ordered.withColumn(part, F.shiftright(name, 33)).withColumn(name, F.col(name).bitwiseAND((1 << 33) - 1))
    counts = ordered.groupBy(part).agg(F.count("*").alias("n")).collect()
    starts, at = [], 0
    for p, many in sorted((r[0], r.n) for r in counts):
        starts.append((p, at))
        at += many
    # one row for each partition
    lift = F.broadcast(spark.createDataFrame(starts, f"{part} long, {place} long"))
    lifted = ordered.join(lift, part, "left").withColumn(name, F.col(name) + F.col(place))
    return lifted.select(*df.columns, name)


def top_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first n rows of each group. Spark cuts each partition to n rows of a group before the shuffle."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def first_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key, the smallest in the order columns; an aggregation, so hot keys are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    ahead = [c for c in order if c in rest]
    struct = F.struct(*ahead, *[c for c in rest if c not in ahead])
    return df.groupBy(*keys).agg(F.min(struct).alias("_first")).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def staged_queue(df: DataFrame, key: str, stages: Sequence[tuple[str, Column, Sequence[Column], int]]) -> DataFrame:
    """A review queue filled stage by stage: (name, condition, order, quota); a row is used once, by the first stage that takes it."""
    taken = None
    for name, condition, order, quota in stages:
        left = df if taken is None else df.join(taken.select(key), key, "left_anti")
        part = left.filter(condition).orderBy(*order).limit(quota).withColumn("stage", F.lit(name))
        taken = part if taken is None else taken.unionByName(part)
    return taken
