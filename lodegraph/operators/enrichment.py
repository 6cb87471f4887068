"""Differential tables and over-representation of sets."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.operators.ordering import dense_index, top_in_group
from lodegraph.runtime import Scratch, fresh


def orient(effect: Column, first: Column, second: Column, primary: str) -> Column:
    """The effect with the primary group first; null where neither group is the primary one."""
    return F.when(first == primary, effect).when(second == primary, -effect)


def select_differential(df: DataFrame, group: str, key: str, effect: str, q: str, most_q: float, least_effect: float, n: int) -> DataFrame:
    """group, key, effect, q, direction, rank of the n rows of each group with the smallest q that pass both thresholds."""
    passed = df.filter((F.col(q) <= most_q) & (F.abs(F.col(effect)) >= least_effect))
    top = top_in_group(passed, [group], [F.asc(q), F.desc(F.abs(F.col(effect))), F.asc(key)], n, "rank")
    return top.withColumn("direction", F.when(F.col(effect) > 0, "up").otherwise("down"))


def rejected_counts(df: DataFrame, group: str, effect: str, q: str, most_q: float, least_effect: float) -> DataFrame:
    """group, n_rows, n_missing, n_not_significant, n_small."""
    missing = F.col(q).isNull() | F.col(effect).isNull()
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return df.groupBy(group).agg(
        F.count("*").alias("n_rows"), count(missing).alias("n_missing"), count(~missing & (F.col(q) > most_q)).alias("n_not_significant"),
        count(~missing & (F.col(q) <= most_q) & (F.abs(F.col(effect)) < least_effect)).alias("n_small"),
    )


def ln_factorial(n: Column) -> Column:
    """ln(n!) of a whole number of any size: a table below 32, Stirling's series from there (to 13 digits)."""
    table = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(32)])
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n < 32, F.get(table, F.greatest(n, F.lit(0)).cast("int"))).otherwise(series)


def ln_choose(n: Column, k: Column) -> Column:
    """ln of n over k."""
    return ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k)


def benjamini_hochberg(df: DataFrame, p: str, keys: Sequence[str], block: int = 10_000) -> DataFrame:
    """df with fdr: the least p * n / rank of the rows from each one on, in the order of p.

    Ranks are a dense index; minima run within blocks of the order and are lowered
    by the least of the blocks after them, so that no task sees all rows.  keys
    make the order of equal p the same in every run and don't change the result.
    """
    scratch = Scratch(df.sparkSession, "fdr")
    at, part, step = fresh(df, "_at", "_part", "_step")
    ranked = scratch.save(dense_index(df, [p, *keys], at))
    n = ranked.count()
    ranked = ranked.withColumn(part, F.floor(F.col(at) / block)).withColumn(step, F.least(F.lit(1.0), F.col(p) * F.lit(float(n)) / (F.col(at) + 1)))
    # one row for each block
    least = ranked.groupBy(part).agg(F.min(step).alias("_least"))
    after = least.withColumn("_after", F.min("_least").over(Window.orderBy(F.desc(part)).rowsBetween(Window.unboundedPreceding, -1))).drop("_least")
    within = ranked.withColumn("fdr", F.min(step).over(Window.partitionBy(part).orderBy(F.desc(at))))
    out = within.join(F.broadcast(after), part).withColumn("fdr", F.least("fdr", F.coalesce("_after", F.lit(1.0))))
    return out.select(*df.columns, "fdr")


def over_representation(members: DataFrame, set_: str, item: str, chosen: DataFrame, universe: int) -> DataFrame:
    """set, size, overlap, coverage, p_value (right tail of the hypergeometric), fdr (Benjamini-Hochberg).

    members: set, item; chosen: item.  Items of sets are the universe's, which may
    be of any size; the time of a set grows with the items chosen of it.
    """
    m = members.select(set_, item).distinct()
    c = chosen.select(item).distinct().withColumn("_c", F.lit(1))
    n = c.join(m.select(item).distinct(), item, "left_semi").count()
    s = m.join(c, item, "left").groupBy(set_).agg(F.count("*").alias("size"), F.count("_c").alias("overlap"))
    big_n, n_ = F.lit(universe), F.lit(n)
    top = F.least(F.col("size"), n_)
    term = lambda k: F.exp(ln_choose(F.col("size"), k) + ln_choose(big_n - F.col("size"), n_ - k) - ln_choose(big_n, n_))
    ks = F.filter(F.sequence(F.col("overlap"), top), lambda k: n_ - k <= big_n - F.col("size"))
    p = F.when(F.col("overlap") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.aggregate(ks, F.lit(0.0), lambda a, k: a + term(k))))
    out = s.select(set_, "size", "overlap", (F.col("overlap") / F.col("size")).alias("coverage"), p.alias("p_value"))
    return benjamini_hochberg(out, "p_value", [set_])
