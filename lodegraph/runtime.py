"""Session-level helpers: table access, durable intermediate tables, task counts."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Iterable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast; a side is counted before it is.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master may go
    without: it gets a temporary folder, which a cluster must never have.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    global _local
    if _local is None:
        _local = tempfile.TemporaryDirectory(prefix="lodegraph-")
        atexit.register(_local.cleanup)
    return f"file://{_local.name}"


_local: tempfile.TemporaryDirectory | None = None


class Scratch:
    """Durable intermediate tables of one run, as Parquet in the shared folder.

    A table written here cuts the lineage and survives the loss of executors.
    Tables that a later one replaces are removed with :meth:`drop`; the rest goes
    with the session.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0
        atexit.register(self._remove, self.root)

    def save(self, df: DataFrame, partitions: int | None = None) -> DataFrame:
        """Write df once and return it as read from the shared folder."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        (df if partitions is None else df.coalesce(partitions)).write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, frames: Iterable[DataFrame]) -> None:
        for df in frames:
            if path := getattr(df, "_scratch_path", None):
                self._remove(path)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may be gone; a folder of this machine can still be removed
            if path.startswith(("/", "file:/")):
                shutil.rmtree(urlparse(path).path, ignore_errors=True)


def task_count(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Tasks for row-wise work that the size of the rows doesn't show: at least one for each core."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / rows_per_task))


def spread(df: DataFrame, rows_per_task: int, *keys: str) -> DataFrame:
    """Repartition for heavy row-wise work by a known row count (adaptive execution would merge small bytes)."""
    n = task_count(df.sparkSession, df.count(), rows_per_task)
    return df.repartition(n, *keys) if keys else df.repartition(n)


def widen(df: DataFrame) -> DataFrame:
    """A scanned table in at least as many partitions as there are cores, for heavy work on its rows.

    Only for a plan without shuffles.  A table of many files or blocks has them
    already and isn't moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


#: A key with more than this part of all rows is hot; there are fewer than HOT_PARTS of them.
HOT_PARTS = 500
#: With fewer rows than this a task can take them all, and no key counts as hot.
HOT_LEAST = 100_000


def hot_keys(counts: DataFrame, key: str, n: str = "n") -> DataFrame | None:
    """The hot keys among counted ones (key unique, n rows each): at most HOT_PARTS rows; None without any."""
    total, most = counts.agg(F.sum(n), F.max(n)).head()
    if not total or total <= HOT_LEAST or most * HOT_PARTS <= total:
        return None
    return counts.filter(F.col(n) * HOT_PARTS > total).select(key)


def split_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """left joined to right, which has at most one row for each key, on a key of which some values are hot.

    how: inner, left, left_semi or left_anti.  The rows of hot keys stay where
    they are and meet a broadcast of the right side's rows of these keys, at most
    HOT_PARTS of them; the other rows are shuffled.  A null key is never hot.
    """
    if hot is None:
        return left.join(right, key, how)
    mark = fresh(left, "_hot")[0]
    keys = F.broadcast(hot.select(key))
    heavy = F.broadcast(right.join(keys, key, "left_semi"))
    marked = left.join(F.broadcast(hot.select(key, F.lit(True).alias(mark))), key, "left")
    many = marked.filter(F.col(mark).isNotNull()).drop(mark).join(heavy, key, how)
    rest = marked.filter(F.col(mark).isNull()).drop(mark).join(right, key, how)
    return many.unionByName(rest)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that don't clash with those of df."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        new = name
        while new.lower() in have:
            new = f"_{new}"
        have.add(new.lower())
        out.append(new)
    return out
