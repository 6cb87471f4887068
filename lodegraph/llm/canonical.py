"""Map freely typed names to the entries of a reference list.

Every entry is indexed under its stems in a BK-tree for each kind of name.  Of
all entries within the threshold of a typed name, those count whose marker and
chain agree with what was typed, and of these the ones at the smallest distance;
an entry whose short code was typed comes before all of them, the whole name as
a code before its stem as one.  One entry left is the match; several are a tie.

Up to ``broadcast_entries`` entries (counted) the trees are built once and
broadcast.  Beyond it the entries are cut into shards; each shard's trees are
built once and stored, see every distinct name, and the winners of the shards are
merged.  Both give the same result.
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm import lookalikes
from lodegraph.llm.bktree import BKTree
from lodegraph.llm.names import entries, read
from lodegraph.runtime import Scratch, hot_keys, split_join, spread, task_count

_FOUND = "key long, distance int, entry long, ties long"
_ARROW = pa.schema([("key", pa.int64()), ("distance", pa.int32()), ("entry", pa.int64()), ("ties", pa.int64())])
# The distances of a name that is an entry's code, and of one whose stem is.
CODE, STEM_CODE = -2, -1


class Index:
    """The trees of some reference entries."""

    def __init__(self, rows: list[tuple[int, str, str | None]]):
        forms: dict[str, dict[str, set]] = defaultdict(lambda: defaultdict(set))
        self.codes: dict[str, set] = defaultdict(set)
        for entry, label, code in rows:
            if label and label.strip():
                for kind, marker, chain, stem in entries(label):
                    forms[kind][stem].add((marker, chain, entry))
            if code and (flat := "".join(c for c in code.casefold() if c.isalnum())):
                self.codes[flat].add(entry)
        self.codes = dict(self.codes)
        self.forms = {k: dict(v) for k, v in forms.items()}
        self.trees = {k: BKTree(list(v)) for k, v in self.forms.items()}

    def best(self, names: list[str], radius: int) -> list[tuple[int, set[int]] | None]:
        """For each name (smallest distance of an agreeing entry, the agreeing entries there), None without one."""
        parts = [read(n) for n in names]
        out: list[tuple[int, set[int]] | None] = [None] * len(names)
        todo = defaultdict(list)
        for i, p in enumerate(parts):
            if found := self.codes.get(p.code):
                out[i] = (CODE, found)
            elif found := self.codes.get(p.stem):
                out[i] = (STEM_CODE, found)
            elif p.stem:
                todo[p.kind].append(i)
        for kind, which in todo.items():
            if kind not in self.trees:
                continue
            tree, forms = self.trees[kind], self.forms[kind]

            def agreeing(i: int, at: int) -> set[int]:
                marker, chain = parts[i].marker, parts[i].chain  # noqa: B023
                return {e for m, c, e in forms[tree.texts[at]] if (not marker or m == marker) and (not chain or c == chain)}  # noqa: B023

            found = tree.nearest([parts[i].stem for i in which], radius, lambda k, at: bool(agreeing(which[k], at)))  # noqa: B023
            for i, hits in zip(which, found, strict=True):
                if hits:
                    out[i] = (hits[0][1], set().union(*(agreeing(i, at) for at, _ in hits)))
        return out


def _found(keys: list, names: list[str | None], index: Index, radius: int) -> list[tuple]:
    distinct = list(dict.fromkeys(n for n in names if n is not None and n.strip()))
    best = dict(zip(distinct, index.best(distinct, radius), strict=True))
    none = (None, ())
    hits = [best.get(n) or none for n in names]
    return [(key, d, min(found, default=None), len(found)) for key, (d, found) in zip(keys, hits, strict=True)]


def _by_shards(named: DataFrame, listed: DataFrame, shards: int, radius: int, rows_per_task: int, table: dict[str, str]) -> DataFrame:
    """(key, distance, entry, ties) with the entries in shards, every distinct name searched once in each."""
    spark = named.sparkSession
    scratch = Scratch(spark, "names")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        lookalikes.use(table)
        index = Index([(int(e), x, c) for e, x, c in zip(rows.entry, rows.label, rows.code, strict=True)])
        return pd.DataFrame({"shard": [rows.shard.iloc[0]], "index": [pickle.dumps(index)]})

    placed = listed.withColumn("shard", F.pmod(F.xxhash64("entry"), F.lit(shards)).cast("int"))
    stored = scratch.save(placed.groupBy("shard").applyInPandas(build, "shard int, index binary"))
    counts = scratch.save(named.groupBy("name").agg(F.count("*").alias("n")))
    chunks = task_count(spark, counts.count(), rows_per_task * 8)

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        lookalikes.use(table)
        hits = _found(left.name.tolist(), left.name.tolist(), pickle.loads(right["index"].iloc[0]), radius) if len(right) else []
        return pd.DataFrame(hits, columns=["name", "distance", "entry", "ties"]).astype({"distance": "Int32", "entry": "Int64"})

    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = counts.select("name", F.pmod(F.hash("name"), F.lit(chunks)).alias("chunk"), each(shards).alias("shard"))
    right = stored.withColumn("chunk", each(chunks))
    found = left.groupBy("shard", "chunk").cogroup(right.groupBy("shard", "chunk")).applyInPandas(search, "name string, distance int, entry long, ties long")
    # the shards' winners: those at the smallest distance count together
    tied = found.filter("distance is not null").groupBy("name", "distance").agg(F.sum("ties").alias("ties"), F.min("entry").alias("entry"))
    won = scratch.save(tied.groupBy("name").agg(F.min(F.struct("distance", "ties", "entry")).alias("w")))
    joined = split_join(named, won, "name", hot_keys(counts, "name"), "left")
    return joined.select("key", "w.distance", "w.entry", F.coalesce("w.ties", F.lit(0).cast("long")).alias("ties"))


def match_names(
    cases: DataFrame,
    key: str,
    name: str,
    reference: DataFrame,
    entry: str,
    label: str,
    code: str | None = None,
    radius: int = 2,
    broadcast_entries: int = 50_000,
    rows_per_task: int = 4_000,
) -> DataFrame:
    """The reference entry of each named case.

    Result: key, entry (-1 where none is within the radius or several fit
    equally well), distance (null without an entry in reach, -2 for a code, -1 for
    a code in the stem), ties (entries that fit equally well).  Cases with a null or blank name, and
    with a null key, give no row; a case sent again counts once; entries with a
    null id or label are left out.  Name and label may be of any length; the time
    of an edit distance grows with their length.
    """
    spark = cases.sparkSession
    named = cases.select(F.col(key).cast("long").alias("key"), F.col(name).alias("name")).filter("key is not null and trim(name) <> ''")
    named = spread(named, rows_per_task, "key").dropDuplicates(["key"])
    code_col = F.col(code) if code else F.lit(None).cast("string")
    listed = reference.select(F.col(entry).cast("long").alias("entry"), F.col(label).alias("label"), code_col.alias("code")).filter("entry is not null").distinct()
    n_entries = listed.count()
    table = lookalikes.confusables()
    lookalikes.use(table)
    if n_entries <= broadcast_entries:
        index = spark.sparkContext.broadcast(Index([tuple(r) for r in listed.collect()]))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lookalikes.use(table)
            for b in batches:
                rows = _found(b.column(0).to_pylist(), b.column(1).to_pylist(), index.value, radius)
                columns = zip(*rows, strict=True) if rows else [()] * len(_ARROW)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

        found = named.mapInArrow(search, _FOUND)
    else:
        found = _by_shards(named, listed, math.ceil(n_entries / broadcast_entries), radius, rows_per_task, table)
    one = F.when(F.col("ties") == 1, F.col("entry")).otherwise(F.lit(-1).cast("long"))
    return found.select(F.col("key").alias(key), one.alias("entry"), "distance", "ties")
