"""Frequency of every distinct term, by a range-partitioned external sort.

Triples of term, record and occurrence are range-partitioned on all three keys
and sorted within the partitions (Spark's sort spills), so that a hot term is
spread over as many partitions as its rows need.  One scan then counts runs:
an occurrence is a change of any key, a record a change of term or record.  A
term that crosses a partition border gives a part on each side; parts are merged
with the border records compared, one row for each term and partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.runtime import Scratch

_PARTS = "term string, part int, occurrences long, records long, first_record long, last_record long"
_ARROW = pa.schema(
    [("term", pa.string()), ("part", pa.int32()), ("occurrences", pa.int64()), ("records", pa.int64())]
    + [("first_record", pa.int64()), ("last_record", pa.int64())]
)


def _changes(x: pa.Array, before) -> np.ndarray:
    """For each row, whether it differs from the row before it (null equals null)."""
    shifted = pa.concat_arrays([pa.array([before], x.type), x.slice(0, len(x) - 1)])
    same = pc.fill_null(pc.equal(x, shifted), False)
    return ~pc.or_(same, pc.and_(pc.is_null(x), pc.is_null(shifted))).to_numpy(zero_copy_only=False)


def scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count the runs of a sorted stream of (term, record, occurrence); one row for each term."""
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    open_term: list | None = None  # term, occurrences, records, first record, last record
    last = (None, None, None)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        term, record, occurrence = (batch.column(i) for i in range(3))
        new_term = _changes(term, last[0])
        if open_term is None:
            new_term[0] = True
        new_record = new_term | _changes(record, last[1])
        new_occurrence = new_record | _changes(occurrence, last[2])
        known = record.is_valid().to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new_term)
        bounds = np.concatenate([[0], starts]) if not len(starts) or starts[0] else starts
        occurrences = np.add.reduceat(new_occurrence.astype(np.int64), bounds)
        records = np.add.reduceat((new_record & known).astype(np.int64), bounds)
        ends = np.concatenate([bounds[1:], [n]]) - 1
        terms = term.take(pa.array(bounds)).to_pylist()
        firsts, lasts = record.take(pa.array(bounds)).to_pylist(), record.take(pa.array(ends)).to_pylist()
        rows = [list(r) for r in zip(terms, occurrences.tolist(), records.tolist(), firsts, lasts, strict=True)]
        if open_term is not None:
            if not new_term[0]:
                rows[0] = [open_term[0], open_term[1] + rows[0][1], open_term[2] + rows[0][2], open_term[3], rows[0][4]]
            else:
                rows.insert(0, open_term)
        open_term = rows.pop()
        last = (term[n - 1].as_py(), record[n - 1].as_py(), occurrence[n - 1].as_py())
        if rows:
            t, o, r, a, b = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((t, [part] * len(t), o, r, a, b), _ARROW, strict=True)], schema=_ARROW)
    if open_term is not None:
        t, o, r, a, b = open_term
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((t, part, o, r, a, b), _ARROW, strict=True)], schema=_ARROW)


def term_frequencies(
    df: DataFrame, term: Column, record: Column, occurrence: Column, partitions: int | None = None, rows_per_task: int = 2_000_000
) -> DataFrame:
    """Occurrences and distinct records of every term.

    term: string; rows with a null or blank term aren't counted.  record: long; a
    null record counts the occurrence but no record.  occurrence: string; the
    same occurrence sent twice (with the same term and record) counts once, and a
    null occurrence is one occurrence for each term and record.

    Result: term, occurrences, records (long).  An empty table gives no row.
    """
    spark = df.sparkSession
    triples = df.select(term.alias("term"), record.cast("long").alias("record"), occurrence.alias("occurrence"))
    triples = triples.filter(F.trim("term") != "")
    # range partitioning samples its input first; what made the terms must not run for the sample and again for the sort
    triples = Scratch(spark, "terms").save(triples)
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-triples.count() // rows_per_task))
    keys = ("term", "record", "occurrence")
    parts = triples.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(scan_runs, _PARTS)
    borders = F.array_sort(F.collect_list(F.when(F.col("last_record").isNotNull(), F.struct("part", "first_record", "last_record"))))
    merged = parts.groupBy("term").agg(
        F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"), borders.alias("borders")
    )
    shared = F.expr(
        "aggregate(sequence(1, greatest(size(borders) - 1, 1)), 0L, (n, i) -> n + "
        "if(i < size(borders) and borders[i].first_record = borders[i - 1].last_record, 1L, 0L))"
    )
    return merged.select("term", "occurrences", (F.col("records") - shared).alias("records"))


def frequency_mark(records: Column, total: int, rare_below: int = 3, common_share: float = 0.05) -> Column:
    """`rare` below rare_below records, else `common` above common_share of all records, else null."""
    share = Fraction(str(common_share))
    common = records * share.denominator > share.numerator * total
    return F.when(records < rare_below, "rare").when(common, "common")
