"""Groups of records that are linked by pairwise matches, directly or through others.

The links form a graph; every vertex gets the smallest vertex of its component.

1. *Peeling.*  Breadth-first search starts at the vertex of the highest degree;
   the frontier is joined to the links, and the links that it used are taken out
   with an anti join.  A giant component of small diameter is gone after a few
   rounds, and its hub with it.  Where a component is long, the search stops
   after ``peel_rounds``; what it reached is contracted to one vertex and stays
   linked to the rest, so nothing is lost.
2. *Minimum propagation.*  Every remaining vertex takes the smallest label of
   itself and its neighbours, then the label of that label (a jump), and the
   links are rewritten to labels.  A link between a vertex and its label stays a
   link between their labels, so no connection is lost.  Vertices are compared by
   a hash first, so that a chain of any length shrinks by a constant factor in
   each round and the rounds grow with its logarithm.

Links and labels are only ever joined and aggregated; aggregates combine before
the shuffle.  A join on the ends of links would send all links of a hub to one
task: every join on a key that may be hot (ends of links, labels, identifiers)
counts it and splits off the hot values (:func:`lodegraph.runtime.split_join`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.runtime import Scratch, hot_keys, split_join


def _order(c: str):
    return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))


def _named(hot: DataFrame | None, end: str) -> DataFrame | None:
    return None if hot is None else hot.select(F.col("v").alias(end))


def _relabel(links: DataFrame, labels: DataFrame, hot: DataFrame | None, end: str) -> DataFrame:
    """links with `end` replaced by its label; ends without a label stay."""
    out = split_join(links, labels.select(F.col("v").alias(end), F.col("label").alias("_to")), end, _named(hot, end), "left")
    return out.withColumn(end, F.coalesce("_to", end)).drop("_to")


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.inline(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))


def _peel(links: DataFrame, scratch: Scratch, rounds: int) -> tuple[DataFrame | None, str | None, DataFrame]:
    """(vertices reached from the hub, the hub, links that are left)."""
    degrees = scratch.save(_both_ways(links).groupBy(F.col("a").alias("v")).agg(F.count("*").alias("n")))
    top = degrees.agg(F.max(F.struct("n", "v")).alias("top")).head()[0]
    if top is None:
        return None, None, links
    hub, hot = top.v, hot_keys(degrees, "v")
    spark = links.sparkSession
    reached = [spark.createDataFrame([(hub,)], "v string")]
    for r in range(rounds):
        # the links of the frontier: the hub's by comparison, later ones by a join
        if r == 0:
            is_a, is_b = F.col("a") == hub, F.col("b") == hub
            new = links.filter(is_a | is_b).select(F.when(is_a, F.col("b")).otherwise(F.col("a")).alias("v")).filter(F.col("v") != hub).distinct()
            left = links.filter(~(is_a | is_b))
        else:
            ends = {c: reached[-1].withColumnRenamed("v", c) for c in "ab"}
            used = {c: split_join(links, ends[c], c, _named(hot, c), "left_semi") for c in "ab"}
            new = used["a"].select(F.col("b").alias("v")).union(used["b"].select(F.col("a").alias("v"))).distinct()
            new = new.join(reached[-1], "v", "left_anti")
            left = split_join(split_join(links, ends["a"], "a", _named(hot, "a"), "left_anti"), ends["b"], "b", _named(hot, "b"), "left_anti")
        new, left = scratch.save(new), scratch.save(left)
        if r:
            scratch.drop([links])
        links = left
        if new.isEmpty():
            break
        reached.append(new)
    else:
        # the search was cut: the last frontier is contracted into the hub
        mark = reached[-1].select("v", F.lit(hub).alias("label"))
        moved = _relabel(_relabel(links, mark, hot, "a"), mark, hot, "b").filter("a <> b").distinct()
        before, links = links, scratch.save(moved)
        scratch.drop([before])
    out = reached[0]
    for r in reached[1:]:
        out = out.union(r)
    return scratch.save(out.distinct()), hub, links


def connected_components(links: DataFrame, a: str, b: str, peel_rounds: int = 4, max_rounds: int = 60) -> DataFrame:
    """(v, label) for every vertex of the links; equal labels mean one component.

    Links with a null end are left out; a link of a vertex with itself makes it
    a vertex of its own; links may be repeated.  No links give an empty table.
    The label is some vertex of the component, the same one in every run.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "components")
    pairs = links.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).filter("a is not null and b is not null")
    all_links = scratch.save(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    vertices = _both_ways(all_links).select(F.col("a").alias("v")).distinct()
    peeled, hub, rest = _peel(all_links.filter("a <> b"), scratch, peel_rounds)
    layers: list[DataFrame] = []
    for _ in range(max_rounds):
        near = _both_ways(rest).groupBy("a").agg(F.min(_order("b")).alias("least"), F.count("*").alias("n"))
        near = scratch.save(near.select(F.col("a").alias("v"), F.least("least", _order("a"))["v"].alias("label"), "n"))
        if near.isEmpty():
            break
        hot = hot_keys(near, "v")
        # every label gives way to its own label; the labels of many vertices are hot vertices
        own = near.select("v", "label")
        tree = _relabel(own.select("v", F.col("label").alias("end")), own, hot, "end")
        tree = scratch.save(tree.select("v", F.col("end").alias("label")))
        moved = _relabel(_relabel(rest, tree, hot, "a"), tree, hot, "b").filter("a <> b")
        moved = scratch.save(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        scratch.drop([rest, near])
        rest = moved
        layers.append(tree)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # a layer maps every vertex of its round to one of the next round; the last layer is final
    final = None
    for depth, layer in enumerate(reversed(layers)):
        layer = layer.select("v", "label")
        if final is not None:
            often = hot_keys(layer.groupBy("label").agg(F.count("*").alias("n")), "label")
            above = final.select(F.col("v").alias("label"), F.col("label").alias("above"))
            layer = split_join(layer, above, "label", often, "left").select("v", F.coalesce("above", "label").alias("label"))
        final = scratch.save(layer) if depth % 6 == 5 else layer
    if peeled is not None:
        label = hub
        if final is not None:
            final = scratch.save(final)
            if met := final.filter(F.col("v") == hub).head(1):
                label = met[0].label
        peeled = peeled.select("v", F.lit(label).alias("label"))
        final = peeled if final is None else peeled.union(final.join(peeled, "v", "left_anti"))
    if final is None:
        return vertices.select("v", F.col("v").alias("label"))
    return vertices.join(final, "v", "left").select("v", F.coalesce("label", "v").alias("label"))


def group_by_identifier(rows: DataFrame, record: str, identifier: str, **options) -> DataFrame:
    """Groups of records that share an identifier, directly or through others.

    Result: record, group_uid (the smallest record of the group), n_records.
    Records without an identifier are groups of their own and, like null
    records, aren't in the result unless another row links them; repeated rows
    change nothing.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "groups")
    used = rows.select(F.col(record).cast("string").alias("r"), F.concat(F.lit("id\x00"), F.col(identifier)).alias("i"))
    used = scratch.save(used.filter("r is not null and i is not null").distinct())
    # an identifier of one record links nothing
    counts = scratch.save(used.groupBy("i").agg(F.count("*").alias("n")))
    several = counts.filter("n > 1")
    labels = connected_components(split_join(used, several.select("i"), "i", hot_keys(several, "i"), "left_semi"), "r", "i", **options)
    linked = scratch.save(labels.filter(~F.col("v").startswith("id\x00")))
    groups = scratch.save(linked.groupBy("label").agg(F.min("v").alias("group_uid"), F.count("*").alias("n_records")))
    hot = hot_keys(groups.select("label", F.col("n_records").alias("n")), "label")
    members = split_join(linked, groups, "label", hot).select(F.col("v").alias("r"), "group_uid", "n_records")
    alone = used.select("r").distinct().join(members, "r", "left_anti").select("r", F.col("r").alias("group_uid"), F.lit(1).cast("long").alias("n_records"))
    return members.unionByName(alone).withColumnRenamed("r", record)
