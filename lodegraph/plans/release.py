"""A graph release: nodes, edges, sparse edges, edge types, degrees and audit, each with its manifest row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators import graph as G
from lodegraph.runtime import Scratch
from lodegraph.sources.sinks import write_table

SCHEMAS = {
    "nodes": "node_idx long, node_uid string, node_type string, display_name string, primary_id string",
    "edges": "edge_type string, subject_uid string, subject_type string, predicate string, object_uid string, object_type string, weight double",
    "sparse_edges": "edge_type string, subject_idx long, object_idx long, weight double",
    "edge_types": "edge_type_id long, edge_type string, n_edges long",
    "degrees": "node_uid string, degree long, out_degree long, in_degree long",
    "skipped_edges": "edge_type string, missing_subject long, missing_object long, skipped long, kept long",
}


def build_graph_release(
    spark: SparkSession, tables: Mapping[str, DataFrame], nodes: Sequence[G.NodeSpec], edges: Sequence[G.EdgeSpec], out_dir: str
) -> DataFrame:
    """Write the release and its manifest (also as table `manifest`); returns the manifest.

    Nodes and edges are projected once and shared by the other tables.
    """
    scratch = Scratch(spark, "release")
    indexed = scratch.save(G.index_nodes(G.project_nodes(tables, nodes)))
    projected = scratch.save(G.project_edges(tables, edges))
    built = {
        "nodes": indexed,
        "edges": projected,
        "sparse_edges": G.sparse_edges(projected, indexed),
        "edge_types": G.edge_types(projected, [e.kind for e in edges]),
        "degrees": G.degree(projected),
        "skipped_edges": G.skipped_edges(projected, indexed),
    }
    manifest = None
    for name, df in built.items():
        row = write_table(df, f"{out_dir}/{name}", SCHEMAS[name]).withColumn("table", F.lit(name))
        manifest = row if manifest is None else manifest.unionByName(row)
    manifest.write.mode("overwrite").parquet(f"{out_dir}/manifest")
    return spark.read.parquet(f"{out_dir}/manifest")


def verify_release(spark: SparkSession, out_dir: str) -> DataFrame:
    """table, passed: whether each table still has the rows and the digest of its manifest."""
    from lodegraph.operators.release import content_digest

    manifest = spark.read.parquet(f"{out_dir}/manifest")
    out = None
    for name, schema in SCHEMAS.items():
        now = content_digest(spark.read.schema(schema).parquet(f"{out_dir}/{name}")).withColumn("table", F.lit(name))
        out = now if out is None else out.unionByName(now)
    return manifest.join(out.withColumnRenamed("digest", "now"), "table").select("table", (F.col("digest") == F.col("now")).alias("passed"))
