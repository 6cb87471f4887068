"""Fill containers of a fixed capacity with items of varying length, best fit first.

Items are range-sorted by size, largest first, so that an item's place in the
order is its rank.  Placement runs in bulk-synchronous steps.  In each step all
items of one size look for their successor among the gaps, the smallest gap that
takes them; items that want the same gaps are served by rank, a gap of g takes
g // size of them, and what finds no gap opens containers.  Then the gaps are
updated and the next smaller size follows.  For items of equal size this gives
the containers of sequential best fit decreasing.

Items and gaps are run-length coded: a run of items is (size, ranks from..to), a
run of gaps (gap, containers from..to).  Sizes and gaps are at most the
capacity, so that a step's state has at most ``capacity`` runs of sizes however
many items there are; only this count of items for each size reaches the driver.
What a step decides is a rule (ranks from..to -> containers from..), and items
find their rule by binary search on their rank in parallel.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.runtime import Scratch, task_count

#: The largest capacity: the number of sizes that the driver sees is at most this.
MAX_CAPACITY = 1_000_000


class Rule(NamedTuple):
    first_rank: int  # in the order of all items
    container: int  # of the first of these items
    each: int  # items for each container
    offset: int  # place in the container of the first of each
    size: int


def place(sizes: list[tuple[int, int]], capacity: int) -> tuple[list[Rule], int]:
    """(rules, containers) for [(size, items of it)]; rules are in the order of ranks."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> [(first container, containers)]
    order: list[int] = []  # the gaps in use
    rules, rank, opened = [], 0, 0

    def add(gap: int, first: int, n: int) -> None:
        if gap > 0 and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, n))

    for size, left in sorted(sizes, reverse=True):
        while left:
            at = bisect_left(order, size)
            if at == len(order):  # no gap takes this size: open as many containers as it needs
                each = capacity // size
                n = -(-left // each)
                first, gap = opened, capacity
                opened += n
            else:
                gap = order[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
                each = gap // size
            full = min(n, left // each)
            if full:
                rules.append(Rule(rank, first, each, capacity - gap, size))
                rank, left = rank + full * each, left - full * each
                add(gap - each * size, first, full)
            if left and full < n:
                rules.append(Rule(rank, first + full, left, capacity - gap, size))
                rank += left
                add(gap - left * size, first + full, 1)
                left, full = 0, full + 1
            add(gap, first + full, n - full)
    return rules, opened


def pack(items: DataFrame, item: str, size: str, capacity: int = 2048, rows_per_task: int = 500_000) -> DataFrame:
    """Every item's container.

    Result: item, piece (from 0), first_unit (of the item), n_units, container_id
    (long, from 0), container_offset.  An item larger than the capacity is split
    into pieces of the capacity and a rest; no other item is.  Items of null, zero
    or negative size need no room and give no row; items sent again under one id
    count once (the largest size); ties go by item id.
    """
    if not 0 < capacity <= MAX_CAPACITY:
        raise ValueError(f"capacity must be from 1 to {MAX_CAPACITY}")
    spark = items.sparkSession
    scratch = Scratch(spark, "packing")
    sized = items.select(F.col(item).alias("item"), F.col(size).cast("long").alias("units")).filter("item is not null and units > 0")
    sized = sized.groupBy("item").agg(F.max("units").alias("units"))
    piece = F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("units") - 1, F.lit(capacity).cast("long"))).alias("piece", "first_unit")
    n_units = F.least(F.lit(capacity), F.col("units") - F.col("first_unit")).cast("int")
    pieces = sized.select("item", "units", piece).select("item", "piece", "first_unit", n_units.alias("n_units"))
    pieces = scratch.save(pieces)
    n = task_count(spark, pieces.count(), rows_per_task)
    keys = (F.desc("n_units"), F.asc("item"), F.asc("piece"))
    ordered = pieces.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    # the place within the partition is the low part of the increasing id
    ordered = ordered.withColumn("id", F.monotonically_increasing_id())
    within = (F.shiftright("id", 33).cast("int").alias("part"), F.col("id").bitwiseAND((1 << 33) - 1).alias("place"))
    ordered = scratch.save(ordered.select("item", "piece", "first_unit", "n_units", *within))
    counts = ordered.groupBy("part", "n_units").agg(F.count("*").alias("n")).collect()  # at most one row for each part and size
    per_part: dict[int, int] = {}
    per_size: dict[int, int] = {}
    for part, units, many in counts:
        per_part[part] = per_part.get(part, 0) + many
        per_size[units] = per_size.get(units, 0) + many
    rules, _ = place(list(per_size.items()), capacity)
    parts = sorted(per_part)
    start = np.zeros(max(parts, default=0) + 1, np.int64)
    start[parts] = np.concatenate([[0], np.cumsum([per_part[p] for p in parts])])[:-1] if parts else []
    shared = spark.sparkContext.broadcast((start, np.array(rules, np.int64).reshape(-1, 5)))
    kind = dict(items.dtypes)[item]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, rules = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            rank = start[b.column("part").to_numpy()] + b.column("place").to_numpy()
            rule = rules[np.searchsorted(rules[:, 0], rank, "right") - 1]
            nth = rank - rule[:, 0]
            container, within = rule[:, 1] + nth // rule[:, 2], rule[:, 3] + nth % rule[:, 2] * rule[:, 4]
            columns = [b.column(c) for c in ("item", "piece", "first_unit", "n_units")]
            names = ["item", "piece", "first_unit", "n_units", "container_id", "container_offset"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(container), pa.array(within)], names=names)

    schema = f"item {kind}, piece int, first_unit long, n_units int, container_id long, container_offset long"
    return ordered.mapInArrow(assign, schema).withColumnRenamed("item", item)
