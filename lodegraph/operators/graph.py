"""A typed property graph from tables: nodes, edges, context, paths and propagation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.keys import stable_uid_sha1
from lodegraph.operators.ordering import dense_index, first_in_group, top_in_group
from lodegraph.runtime import Scratch


class NodeSpec(NamedTuple):
    table: str
    kind: str
    key: str
    names: tuple[str, ...]  # the first that isn't blank is the display name


class EdgeSpec(NamedTuple):
    table: str
    kind: str
    subject: tuple[str, str]  # kind, column
    object: tuple[str, str]
    predicate: str
    weight: str | None = None  # a column, 1.0 without


def node_uid(kind: Column | str, key: Column | str) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return stable_uid_sha1("node", kind, F.col(key) if isinstance(key, str) else key)


def project_nodes(tables: Mapping[str, DataFrame], specs: Sequence[NodeSpec]) -> DataFrame:
    """node_uid, node_type, display_name, primary_id, spec_order; the first spec that makes a node wins.

    Rows without a key make no node; a node without a name shows its primary id.
    """
    parts = []
    for i, s in enumerate(specs):
        df = tables[s.table].filter(F.col(s.key).isNotNull())
        primary = F.concat(F.lit(f"{s.kind.upper()}:"), F.col(s.key).cast("string"))
        shown = F.coalesce(*[F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in s.names], primary)
        parts.append(df.select(node_uid(s.kind, s.key).alias("node_uid"), F.lit(s.kind).alias("node_type"), shown.alias("display_name"), primary.alias("primary_id"), F.lit(i).alias("spec_order")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return first_in_group(out, ["node_uid"], ["spec_order", "display_name"])


def project_edges(tables: Mapping[str, DataFrame], specs: Sequence[EdgeSpec]) -> DataFrame:
    """edge_type, subject_uid, subject_type, predicate, object_uid, object_type, weight; repeats are kept, null ends left out."""
    parts = []
    for s in specs:
        (st, sc), (ot, oc) = s.subject, s.object
        weight = F.coalesce(F.col(s.weight).cast("double"), F.lit(1.0)) if s.weight else F.lit(1.0)
        parts.append(
            tables[s.table]
            .filter(F.col(sc).isNotNull() & F.col(oc).isNotNull())
            .select(F.lit(s.kind).alias("edge_type"), node_uid(st, sc).alias("subject_uid"), F.lit(st).alias("subject_type"), F.lit(s.predicate).alias("predicate"), node_uid(ot, oc).alias("object_uid"), F.lit(ot).alias("object_type"), weight.alias("weight"))
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def index_nodes(nodes: DataFrame) -> DataFrame:
    """nodes with node_idx (long, from 0) in the order of spec and uid."""
    return dense_index(nodes, ["spec_order", "node_uid"], "node_idx")


def sparse_edges(edges: DataFrame, indexed: DataFrame) -> DataFrame:
    """edge_type, subject_idx, object_idx, weight of the edges whose ends are both nodes."""
    ends = indexed.select("node_uid", "node_idx")
    s = ends.select(F.col("node_uid").alias("subject_uid"), F.col("node_idx").alias("subject_idx"))
    o = ends.select(F.col("node_uid").alias("object_uid"), F.col("node_idx").alias("object_idx"))
    return edges.join(s, "subject_uid").join(o, "object_uid").select("edge_type", "subject_idx", "object_idx", "weight")


def skipped_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of each type that lack a node at either end: edge_type, missing_subject, missing_object, skipped, kept."""
    s = nodes.select(F.col("node_uid").alias("subject_uid"), F.lit(True).alias("s"))
    o = nodes.select(F.col("node_uid").alias("object_uid"), F.lit(True).alias("o"))
    seen = edges.join(s, "subject_uid", "left").join(o, "object_uid", "left")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return seen.groupBy("edge_type").agg(
        count(F.col("s").isNull()).alias("missing_subject"), count(F.col("o").isNull()).alias("missing_object"),
        count(F.col("s").isNull() | F.col("o").isNull()).alias("skipped"), count(F.col("s").isNotNull() & F.col("o").isNotNull()).alias("kept"),
    )


def edge_types(edges: DataFrame, order: Sequence[str]) -> DataFrame:
    """edge_type_id (in the order given, then by name), edge_type, n_edges."""
    place = F.coalesce(*[F.when(F.col("edge_type") == k, F.lit(i)) for i, k in enumerate(order)], F.lit(len(order)))
    counted = edges.groupBy("edge_type").agg(F.count("*").alias("n_edges")).withColumn("place", place)
    return dense_index(counted, ["place", "edge_type"], "edge_type_id").drop("place")


def degree(edges: DataFrame) -> DataFrame:
    """node_uid, degree (both ends), out_degree, in_degree."""
    ends = edges.select(F.inline(F.array(
        F.struct(F.col("subject_uid").alias("node_uid"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("object_uid").alias("node_uid"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )))
    return ends.groupBy("node_uid").agg(F.count("*").alias("degree"), F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def two_hop_context(first: DataFrame, second: DataFrame, start: str, middle: str, end: str) -> DataFrame:
    """start, context (sorted distinct ends), n_context: what lies behind the middles of each start."""
    pairs = first.select(start, middle).distinct().join(second.select(middle, end).distinct(), middle).select(start, end).distinct()
    return pairs.groupBy(start).agg(F.array_sort(F.collect_list(end)).alias("context"), F.count("*").alias("n_context"))


def k_hop(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """node, hops: the nodes within k undirected steps of the seeds. edges: a, b; seeds: node."""
    scratch = Scratch(edges.sparkSession, "khop")
    both = scratch.save(edges.select(F.inline(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).distinct())
    reached = scratch.save(seeds.select("node").distinct().withColumn("hops", F.lit(0)))
    for hop in range(1, k + 1):
        frontier = reached.filter(F.col("hops") == hop - 1).select(F.col("node").alias("a"))
        new = both.join(frontier, "a", "left_semi").select(F.col("b").alias("node")).distinct().join(reached, "node", "left_anti")
        before, reached = reached, scratch.save(reached.unionByName(new.withColumn("hops", F.lit(hop))))
        scratch.drop([before])
    return reached


def closure(parents: DataFrame, child: str, parent: str) -> DataFrame:
    """child, ancestor, depth (the least) over all chains of parents; cycles end at their first repeat.

    Paths are doubled in each round until no pair is new, so that the rounds grow
    with the logarithm of the depth, which has no bound.
    """
    scratch = Scratch(parents.sparkSession, "closure")
    step = parents.select(F.col(child).alias("c"), F.col(parent).alias("p")).filter("c is not null and p is not null and c <> p").distinct()
    known = scratch.save(step.withColumn("d", F.lit(1)))
    count = known.count()
    while True:
        onward = known.select(F.col("c").alias("p"), F.col("p").alias("far"), F.col("d").alias("d2"))
        longer = known.join(onward, "p").filter("c <> far").select("c", F.col("far").alias("p"), (F.col("d") + F.col("d2")).alias("d"))
        before, known = known, scratch.save(known.unionByName(longer).groupBy("c", "p").agg(F.min("d").alias("d")))
        scratch.drop([before])
        now = known.count()
        if now == count:
            break
        count = now
    return known.select(F.col("c").alias(child), F.col("p").alias("ancestor"), F.col("d").alias("depth"))


def strongest_edges(edges: DataFrame, most: int = 160) -> DataFrame:
    """The strongest edges of each subject (subject, object, weight); ties by object."""
    return top_in_group(edges, ["subject"], [F.desc("weight"), F.asc("object")], most)


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, iterations: int = 10, alpha: float = 0.85) -> DataFrame:
    """node, score after a fixed number of steps of pi = (1 - alpha) y + alpha W pi.

    edges: subject, object, weight; mass leaves a node in proportion to the
    weights of its edges, and mass of a node without edges is lost.  seeds: node,
    mass (scaled to 1).
    """
    scratch = Scratch(edges.sparkSession, "pagerank")
    out = edges.groupBy("subject").agg(F.sum("weight").alias("out"))
    flow = scratch.save(edges.groupBy("subject", "object").agg(F.sum("weight").alias("w")).join(out, "subject").select("subject", "object", (F.col("w") / F.col("out")).alias("share")))
    whole = seeds.agg(F.sum("mass")).head()[0] or 1.0
    start = scratch.save(seeds.groupBy("node").agg((F.sum("mass") / F.lit(float(whole))).alias("y")))
    score = start.select("node", F.col("y").alias("score"))
    for i in range(iterations):
        moved = flow.join(score.withColumnRenamed("node", "subject"), "subject").select(F.col("object").alias("node"), (F.col("share") * F.col("score") * alpha).alias("part"))
        base = start.select("node", (F.col("y") * (1 - alpha)).alias("part"))
        new = scratch.save(moved.unionByName(base).groupBy("node").agg(F.sum("part").alias("score")))
        if i:
            scratch.drop([score])
        score = new
    return score


def cheapest_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, hops: int = 3, k: int = 3, beam: int = 160) -> DataFrame:
    """The k paths of 1 to `hops` edges of least -sum(ln p) from each start to each end.

    edges: subject, object, p (0 < p <= 1); starts and ends: node.  Paths don't
    visit a node twice; ties by the path's text.  Each node passes on its `beam`
    strongest edges.  Result: start, end, path (array), cost, rank.
    """
    scratch = Scratch(edges.sparkSession, "paths")
    best = edges.groupBy("subject", "object").agg(F.max("p").alias("weight")).filter("weight > 0")
    strong = scratch.save(strongest_edges(best, beam).select("subject", "object", (-F.log("weight")).alias("c")))
    walk = starts.select(F.col("node").alias("start"), F.array("node").alias("path"), F.lit(0.0).alias("cost")).distinct()
    found = None
    for _ in range(hops):
        step = walk.withColumn("subject", F.element_at("path", -1)).join(strong, "subject").filter(~F.array_contains("path", F.col("object")))
        walk = scratch.save(step.select("start", F.array_append("path", F.col("object")).alias("path"), (F.col("cost") + F.col("c")).alias("cost")))
        done = walk.withColumn("end", F.element_at("path", -1)).join(ends.select(F.col("node").alias("end")).distinct(), "end", "left_semi")
        done = top_in_group(done, ["start", "end"], [F.asc("cost"), F.asc(F.array_join("path", ">"))], k)
        found = done if found is None else found.unionByName(done)
    return top_in_group(found, ["start", "end"], [F.asc("cost"), F.asc(F.array_join("path", ">"))], k, "rank")


def identity_clusters(pairs: DataFrame, record: str, identifier: str, max_rounds: int = 200) -> DataFrame:
    """record, cluster (the smallest record): records that share an identifier, directly or through others.

    The smallest label moves over shared identifiers until nothing changes, and
    jumps along labels in each round.  Null identifiers link nothing.  Without an
    end after max_rounds an error is raised.
    """
    scratch = Scratch(pairs.sparkSession, "clusters")
    links = scratch.save(pairs.select(F.col(record).alias("r"), F.col(identifier).alias("i")).filter("r is not null and i is not null").distinct())
    labels = scratch.save(pairs.filter(F.col(record).isNotNull()).select(F.col(record).alias("r")).distinct().withColumn("label", F.col("r")))
    for _ in range(max_rounds):
        least = links.join(labels, "r").groupBy("i").agg(F.min("label").alias("least"))
        near = links.join(least, "i").groupBy("r").agg(F.min("least").alias("least"))
        new = labels.join(near, "r", "left").select("r", "label", F.least("label", F.coalesce("least", "label")).alias("new"))
        jump = new.select(F.col("r").alias("new"), F.col("new").alias("far"))
        new = scratch.save(new.join(jump, "new", "left").select("r", "label", F.least("new", F.coalesce("far", "new")).alias("next")))
        scratch.drop([labels])
        labels = new.select("r", F.col("next").alias("label"))
        labels._scratch_path = new._scratch_path  # type: ignore[attr-defined]
        if new.filter("label <> next").isEmpty():
            break
    else:
        raise RuntimeError(f"clusters did not settle in {max_rounds} rounds")
    return labels.select(F.col("r").alias(record), F.col("label").alias("cluster"))
