"""Joins that bring records of several sources together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.keys import stable_uid_sha1
from lodegraph.operators.ordering import first_in_group
from lodegraph.operators.resolve import small


def merge_sources(first: DataFrame, second: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key, fields, origin: all keys of both sides, each field from the first side if it has it."""
    a = first.select(key, *[F.col(f).alias(f"_a_{f}") for f in fields], F.lit(True).alias("_a"))
    b = second.select(key, *[F.col(f).alias(f"_b_{f}") for f in fields], F.lit(True).alias("_b"))
    origin = F.when(F.col("_b").isNull(), "first").when(F.col("_a").isNull(), "second").otherwise("both")
    return a.join(b, key, "full").select(key, *[F.coalesce(f"_a_{f}", f"_b_{f}").alias(f) for f in fields], origin.alias("origin"))


def propagate_links(links: DataFrame, anchors: DataFrame) -> DataFrame:
    """left, right, uid, status of identifier links: the uid of whichever end is anchored.

    links: left, right; anchors: key, uid (as they were before; links don't make
    new anchors).  Two ends of different uids are a conflict and propagate
    nothing; without an anchored end the link stays open.
    """
    one = anchors.groupBy("key").agg(F.min("uid").alias("uid"))
    a = one.select(F.col("key").alias("left"), F.col("uid").alias("_l"))
    b = one.select(F.col("key").alias("right"), F.col("uid").alias("_r"))
    j = links.select("left", "right").distinct().join(a, "left", "left").join(b, "right", "left")
    status = (
        F.when(F.col("_l").isNull() & F.col("_r").isNull(), "open").when(F.col("_l").isNull() | F.col("_r").isNull(), "propagated").when(F.col("_l") == F.col("_r"), "agreed").otherwise("conflict")
    )
    return j.withColumn("status", status).select("left", "right", F.when(F.col("status") != "conflict", F.coalesce("_l", "_r")).alias("uid"), "status")


def uid_or_hash(rows: DataFrame, key: str, dim: DataFrame, dim_key: str, dim_uid: str, prefix: str) -> DataFrame:
    """rows with uid: that of the dimension, else a uid made of the key."""
    d = dim.select(F.col(dim_key).alias(key), F.col(dim_uid).alias("_uid")).groupBy(key).agg(F.min("_uid").alias("_uid"))
    return rows.join(small(d), key, "left").withColumn("uid", F.coalesce("_uid", stable_uid_sha1(prefix, F.col(key)))).drop("_uid")


def strip_version(c: Column) -> Column:
    """An accession without its version `.N`."""
    return F.regexp_replace(F.trim(c), r"\.[0-9]+$", "")


def reaction_components(df: DataFrame, key: str, smiles: str) -> DataFrame:
    """key, role, position, component of reactions written `a.b>>c.d`; texts without `>>` and empty components give no row."""
    sides = F.split(F.col(smiles), ">>")
    part = lambda i, role: df.filter(F.col(smiles).contains(">>")).select(key, F.lit(role).alias("role"), F.posexplode(F.split(F.get(sides, i), r"\.")).alias("position", "component"))
    return part(0, "substrate").unionByName(part(1, "product")).filter(F.trim("component") != "")


def bridge_identities(rows: DataFrame, key: str, index: DataFrame, ways: Sequence[tuple[str, str]]) -> DataFrame:
    """key, uid, via: the first of several identifiers by which a row is in the index.

    ways: (column of rows, namespace), best first; index: namespace, id, uid.  A
    row with several uids in its best way takes the smallest.
    """
    cells = [F.struct(F.lit(i).alias("way"), F.lit(n).alias("namespace"), F.col(c).alias("id")) for i, (c, n) in enumerate(ways)]
    asked = rows.select(key, F.inline(F.array(*cells))).filter("id is not null")
    hits = asked.join(index.select("namespace", "id", "uid"), ["namespace", "id"])
    return first_in_group(hits.select(key, "way", "uid", "namespace"), [key], ["way", "uid"]).select(key, "uid", F.col("namespace").alias("via"))


def inherit_edges(same_as: DataFrame, edges: DataFrame, subject: str) -> DataFrame:
    """The edges of linked entities, for the entities that are linked to them and lack them. same_as: uid, other."""
    rest = [c for c in edges.columns if c != subject]
    links = same_as.filter("uid <> other").select("uid", "other").distinct()
    got = edges.distinct().join(links.select(F.col("other").alias(subject), "uid"), subject).select(F.col("uid").alias(subject), *rest).distinct()
    return got.join(edges.distinct(), [subject, *rest], "left_anti")


def lookup_by_any(rows: DataFrame, key: str, tokens: Sequence[str], index: DataFrame, value: str) -> DataFrame:
    """key, value: the smallest value that any of a row's tokens has in the index (token, value); rows without one are null."""
    asked = rows.select(key, F.explode(F.array_compact(F.array(*[F.col(t).cast("string") for t in tokens]))).alias("token")).distinct()
    found = asked.join(index.select("token", value), "token").groupBy(key).agg(F.min(value).alias(value))
    return rows.select(key).distinct().join(found, key, "left")


def regroup_features(rows: DataFrame, key: str, items: str, features: DataFrame, item: str, score: str) -> DataFrame:
    """key, n_items, n_scored, best, mean: features of the items that rows list, joined one by one and put together again."""
    each = rows.select(key, F.explode_outer(items).alias(item)).distinct()
    j = each.join(features.select(item, score), item, "left")
    return j.groupBy(key).agg(F.count(item).alias("n_items"), F.count(score).alias("n_scored"), F.max(score).alias("best"), F.avg(score).alias("mean"))
