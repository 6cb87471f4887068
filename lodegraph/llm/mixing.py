"""Mix sources to target weights: pivotal dependent rounding of copy numbers.

Sizes of the sources and targets give every record of a source the same
expected number of copies x.  Each record gets floor(x) copies; the fractional
parts are rounded in pairs: mass (probability times size) moves from one record
of a pair to the other, at random and without changing either expectation, until
one of the two probabilities is 0 or 1.  The mass of a source is the same before
and after, so that its size is met to within one record.

Pairs are formed within partitions first, of records next to each other by size,
in rounds that halve the open records; each partition is left with one open
record for each source.  These residuals are combined by a reduction tree: blocks
of ``fan_in`` partitions in each level, until one record is left and is drawn.
Every meeting has a uniform of its own, a hash of the seed, the level, both
records and the round; the order of records doesn't depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.runtime import BROADCAST_ROWS, Scratch, hot_keys, split_join, task_count


def fight(p: float, w: float, q: float, v: float, u: float) -> tuple[float, float]:
    """The probabilities of two records of sizes w and v after mass moved between them; u is uniform in [0, 1)."""
    up = min((1 - p) * w, q * v)  # mass that can go to the first
    down = min((1 - q) * v, p * w)  # mass that can go to the second
    if u * (up + down) < down:
        return (1.0 if up == (1 - p) * w else p + up / w), (0.0 if up == q * v else q - up / v)
    return (0.0 if down == p * w else p - down / w), (1.0 if down == (1 - q) * v else q + down / v)


def _uniform(a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """A uniform in [0, 1) for each pair of hashes and step, by the finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        z = a.view(np.uint64) ^ (b.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((step + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def pivot(p: np.ndarray, w: np.ndarray, run: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The probabilities after the open records of each run met in pairs until at most one of a run is open.

    run: numbers of the runs, in order; h: a hash of each record, from which every
    meeting draws a uniform of its own.
    """
    p, step = p.copy(), 0
    while True:
        open_ = np.flatnonzero((p > 0) & (p < 1))
        same = run[open_[1:]] == run[open_[:-1]]
        at = np.arange(len(open_))
        first = np.maximum.accumulate(np.where(np.concatenate([[True], ~same])[: len(open_)], at, 0))
        pair = np.flatnonzero(((at - first) % 2 == 0)[:-1] & same) if len(open_) > 1 else at[:0]
        if not len(pair):
            return p
        i, j = open_[pair], open_[pair + 1]
        pi, wi, q, v = p[i], w[i], p[j], w[j]
        up, down = np.minimum((1 - pi) * wi, q * v), np.minimum((1 - q) * v, pi * wi)
        rise = _uniform(h[i], h[j], step) * (up + down) < down
        p[i] = np.where(rise, np.where(up == (1 - pi) * wi, 1.0, pi + up / wi), np.where(down == pi * wi, 0.0, pi - down / wi))
        p[j] = np.where(rise, np.where(up == q * v, 0.0, q - up / v), np.where(down == (1 - q) * v, 1.0, q + down / v))
        step += 1


def _pivot_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (grp, source, item, p, size, h) in runs of grp and source; all come out, with at most one open p for each run."""
    kept: pa.RecordBatch | None = None  # the open record of the last run
    for b in batches:
        t = pa.Table.from_batches([b] if kept is None else [kept, b]).combine_chunks()
        if not t.num_rows:
            continue
        source = t["source"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        grp = t["grp"].to_numpy()
        new = np.concatenate([[True], (grp[1:] != grp[:-1]) | (source[1:] != source[:-1])])
        run = np.cumsum(new)
        p = pivot(t["p"].to_numpy(), t["size"].to_numpy().astype(float), run, t["h"].to_numpy())
        t = t.set_column(t.schema.get_field_index("p"), "p", pa.array(p))
        last = np.flatnonzero((run == run[-1]) & (p > 0) & (p < 1))
        kept = t.take(pa.array(last)).combine_chunks().to_batches()[0] if len(last) else None
        if len(last):
            t = t.filter(pa.array(~np.isin(np.arange(len(p)), last)))
        yield from t.to_batches()
    if kept is not None:
        yield kept


def plan(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, float]:
    """Expected copies of each record by source.

    sizes: size of each source; targets: (share, most copies).  Sources without
    records, share or copies get none, and the shares of the others are scaled
    to 1.  Without a total, the largest one at which every such source reaches
    its share is taken.  With one, a source that its cap keeps below its share
    gives all it may, and the others share the rest in proportion.
    """
    live = {s: (share, cap) for s, (share, cap) in targets.items() if sizes.get(s) and share and share > 0 and cap and cap > 0}
    if not live:
        return {}
    whole = sum(share for share, _ in live.values())
    if total is None:
        total_ = min(sizes[s] * cap * whole / share for s, (share, cap) in live.items())
        return {s: min(float(cap), total_ * share / whole / sizes[s]) for s, (share, cap) in live.items()}
    out: dict[str, float] = {}
    left, open_ = float(total), dict(live)
    while open_:
        whole = sum(share for share, _ in open_.values())
        capped = {s for s, (share, cap) in open_.items() if left * share / whole >= sizes[s] * cap}
        if not capped:
            return out | {s: left * share / whole / sizes[s] for s, (share, _) in open_.items()}
        for s in capped:
            out[s] = float(open_[s][1])
        left -= sum(sizes[s] * open_.pop(s)[1] for s in capped)
    return out


def plan_table(sized: DataFrame, wanted: DataFrame, total: int | None, scratch: Scratch) -> DataFrame:
    """:func:`plan` as a table (source, x), for more sources than the driver should see."""
    live = sized.join(wanted, "source").filter("available > 0 and target_share > 0 and max_repeats > 0")
    live = scratch.save(live.select("source", "available", F.col("target_share").alias("share"), F.col("max_repeats").alias("cap")))
    scaled = lambda left, whole: F.lit(float(left)) * F.col("share") / F.lit(float(whole))
    if total is None:
        whole = live.agg(F.sum("share")).head()[0] or 1.0
        most = live.agg(F.min(F.col("available") * F.col("cap") * F.lit(whole) / F.col("share"))).head()[0] or 0.0
        return live.select("source", F.least(F.col("cap").cast("double"), scaled(most, whole) / F.col("available")).alias("x"))
    left, open_, out = float(total), live, live.limit(0).select("source", F.lit(0.0).alias("x"))
    while True:
        whole = open_.agg(F.sum("share")).head()[0]
        if not whole:
            return out
        is_capped = scaled(left, whole) >= F.col("available") * F.col("cap")
        taken = open_.filter(is_capped).agg(F.sum(F.col("available") * F.col("cap"))).head()[0]
        if not taken:
            return out.union(open_.select("source", scaled(left, whole) / F.col("available")))
        out = scratch.save(out.union(open_.filter(is_capped).select("source", F.col("cap").cast("double"))))
        open_, left = scratch.save(open_.filter(~is_capped)), left - taken


def mix(
    records: DataFrame, item: str, source: str, size: str, targets: DataFrame, total: int | None = None, seed: int = 0, fan_in: int = 64, rows_per_task: int = 200_000
) -> tuple[DataFrame, DataFrame]:
    """(copies, shares) of a mixture of records to target shares of the total size.

    targets: source, target_share, max_repeats (the most copies of a record; a
    source listed twice counts with its sums of shares and its largest cap).

    copies: item, source, size, copies (>= 1).  shares: source, target_share,
    max_repeats, available (size), used, actual_share, copies, records_used; one
    row for each source on either side, null source included.  Records of null
    id, null or non-positive size or of a source without a target have no
    copies; an id sent again counts once.  The same seed gives the same copies.
    """
    spark = records.sparkSession
    scratch = Scratch(spark, "mixing")
    kind = dict(records.dtypes)[item]
    rows = records.select(F.col(item).alias("item"), F.col(source).alias("source"), F.col(size).cast("long").alias("size")).filter("item is not null")
    rows = scratch.save(rows.groupBy("item").agg(F.max(F.struct("size", "source")).alias("r")).select("item", "r.source", "r.size"))
    wanted = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").cast("long").alias("max_repeats"))
    wanted = scratch.save(wanted.filter("source is not null"))
    sized = scratch.save(rows.filter("size > 0").groupBy("source").agg(F.sum("size").alias("available"), F.count("*").alias("n")))
    if wanted.count() <= BROADCAST_ROWS:
        known = {r.source: r for r in sized.join(F.broadcast(wanted), "source").collect()}
        expected = plan({s: r.available for s, r in known.items()}, {s: (r.target_share, r.max_repeats) for s, r in known.items()}, total)
        table = F.broadcast(spark.createDataFrame(list(expected.items()), "source string, x double"))
        hot = None
    else:
        table, hot = plan_table(sized, wanted, total, scratch), hot_keys(sized.select("source", "n"), "source")
    hashed = lambda level, part: F.xxhash64(F.lit(seed), F.lit(level), F.lit(part), "item")
    parts = split_join(rows.filter("size > 0"), table, "source", hot).withColumn("base", F.floor(F.col("x") + 1e-9))
    parts = parts.withColumn("p", F.when(F.col("x") - F.col("base") > 1e-9, F.col("x") - F.col("base")).otherwise(0.0))
    parts = scratch.save(parts.select("item", "source", "size", F.col("base").cast("long").alias("base"), "p"))
    open_ = parts.filter("p > 0")
    n = task_count(spark, parts.count(), rows_per_task)
    schema = f"grp long, source string, item {kind}, p double, size long, h long"
    spread_ = open_.withColumn("grp", F.pmod(F.xxhash64("item"), F.lit(n)))
    decided = None
    groups, number = n, 0
    while True:
        level = spread_.select("grp", "source", "item", "p", "size", hashed(number, 0).alias("h")).repartition(min(n, groups), "grp")
        level = level.sortWithinPartitions("grp", "source", F.desc("size"), hashed(number, 1), "item")
        level = scratch.save(level.mapInArrow(_pivot_stream, schema))
        number += 1
        done = level.filter("p = 0 or p = 1")
        decided = done if decided is None else decided.union(done)
        rest = level.filter("p > 0 and p < 1")
        if groups == 1:
            uniform = F.shiftrightunsigned(hashed(number, 2), 11) / F.lit(float(1 << 53))
            decided = decided.union(rest.withColumn("p", (uniform < F.col("p")).cast("double")))
            break
        groups = -(-groups // fan_in)
        spread_ = rest.withColumn("grp", F.floor(F.col("grp") / fan_in))
    extra = decided.filter("p = 1").select("item", F.lit(1).cast("long").alias("extra"))
    copies = parts.join(extra, "item", "left").withColumn("copies", F.col("base") + F.coalesce("extra", F.lit(0)))
    copies = scratch.save(copies.filter("copies > 0").select("item", "source", "size", "copies"))
    used = copies.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("used"), F.sum("copies").alias("copies"), F.count("*").alias("records_used"))
    overall = used.agg(F.sum("used")).head()[0] or 1
    both = sized.drop("n").join(wanted, sized.source.eqNullSafe(wanted.source), "full")
    both = both.select(F.coalesce(sized.source, wanted.source).alias("source"), "target_share", "max_repeats", "available")
    zero = F.lit(0).cast("long")
    shares = both.join(used, "source", "left").select(
        "source",
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
        "max_repeats",
        F.coalesce("available", zero).alias("available"),
        F.coalesce("used", zero).alias("used"),
        (F.coalesce("used", zero) / F.lit(overall)).alias("actual_share"),
        F.coalesce("copies", zero).alias("copies"),
        F.coalesce("records_used", zero).alias("records_used"),
    )
    return copies.withColumnRenamed("item", item), shares
