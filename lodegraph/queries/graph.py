"""The graph of customers, suppliers, parts, orders and places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators import graph as G
from lodegraph.operators.graph import EdgeSpec, NodeSpec
from lodegraph.runtime import table

C = F.col
NODES = (
    NodeSpec("region", "region", "r_regionkey", ("r_name",)),
    NodeSpec("nation", "nation", "n_nationkey", ("n_name",)),
    NodeSpec("customer", "customer", "c_custkey", ("c_name",)),
    NodeSpec("supplier", "supplier", "s_suppkey", ("s_name",)),
    NodeSpec("part", "part", "p_partkey", ("p_name", "p_brand")),
)
EDGES = (
    EdgeSpec("nation", "nation_region", ("nation", "n_nationkey"), ("region", "n_regionkey"), "part_of"),
    EdgeSpec("customer", "customer_nation", ("customer", "c_custkey"), ("nation", "c_nationkey"), "located_in"),
    EdgeSpec("supplier", "supplier_nation", ("supplier", "s_suppkey"), ("nation", "s_nationkey"), "located_in"),
    EdgeSpec("orders", "order_customer", ("order", "o_orderkey"), ("customer", "o_custkey"), "placed_by", "o_totalprice"),
    EdgeSpec("lineitem", "part_supplier", ("part", "l_partkey"), ("supplier", "l_suppkey"), "supplied_by", "l_quantity"),
)
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _tables(spark, d):
    return {t: table(spark, d, t) for t in TABLES}


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.index_nodes(G.project_nodes(_tables(spark, d), NODES)).select("node_idx", "node_uid", "node_type", "display_name", "primary_id")


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = G.project_edges(_tables(spark, d), EDGES)
    return edges.groupBy("edge_type", "subject_uid", "predicate", "object_uid").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 2).alias("weight"))


def graph_sparse_edges(spark: SparkSession, d: str) -> DataFrame:
    t = _tables(spark, d)
    return G.sparse_edges(G.project_edges(t, EDGES), G.index_nodes(G.project_nodes(t, NODES)))


def graph_skipped_edges(spark: SparkSession, d: str) -> DataFrame:
    t = _tables(spark, d)
    return G.skipped_edges(G.project_edges(t, EDGES), G.project_nodes(t, NODES))


def graph_edge_types(spark: SparkSession, d: str) -> DataFrame:
    return G.edge_types(G.project_edges(_tables(spark, d), EDGES), [e.kind for e in EDGES])


def graph_degree(spark: SparkSession, d: str) -> DataFrame:
    return G.degree(G.project_edges(_tables(spark, d), EDGES))


def graph_two_hop_context(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select("l_partkey", C("l_suppkey").alias("s_suppkey"))
    out = G.two_hop_context(items, table(spark, d, "supplier"), "l_partkey", "s_suppkey", "s_nationkey")
    return out.select("l_partkey", "n_context", F.array_join("context", ",").alias("context"))


def _nation_edges(spark, d):
    people = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("a"), F.concat(F.lit("n"), "c_nationkey").alias("b"))
    places = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("a"), F.concat(F.lit("r"), "n_regionkey").alias("b"))
    return people.unionByName(places)


def graph_k_hop(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "region").filter("r_regionkey = 1").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    return G.k_hop(_nation_edges(spark, d), seeds, 3)


def graph_closure(spark: SparkSession, d: str) -> DataFrame:
    halves = table(spark, d, "part").filter("p_partkey > 1").select(C("p_partkey").alias("child"), F.floor(C("p_partkey") / 2).cast("long").alias("parent"))
    return G.closure(halves, "child", "parent")


def graph_strongest_edges(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").groupBy(C("l_suppkey").alias("subject"), C("l_partkey").alias("object")).agg(F.sum("l_quantity").alias("weight"))
    return G.strongest_edges(e)


def _supply(spark, d):
    sold = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("weight"))
    p, s = F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")
    return sold.select(p.alias("subject"), s.alias("object"), "weight").unionByName(sold.select(s.alias("subject"), p.alias("object"), "weight"))


def graph_pagerank(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "supplier").filter("s_nationkey = 3").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.lit(1.0).alias("mass"))
    return G.personalised_pagerank(_supply(spark, d), seeds, 30).select("node", F.round("score", 8).alias("score"))


def graph_cheapest_paths(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("subject"), F.concat(F.lit("r"), "n_regionkey").alias("object"), (1 / (2 + C("n_nationkey"))).alias("p"))
    back = n.select(C("object").alias("subject"), C("subject").alias("object"), (C("p") * 0.5).alias("p"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("subject"), F.concat(F.lit("n"), "s_nationkey").alias("object"), (1 / (3 + F.pmod("s_suppkey", F.lit(5)))).alias("p"))
    ends = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    out = G.cheapest_paths(n.unionByName(back).unionByName(s), s.select(C("subject").alias("node")), ends, 3, 2)
    return out.select("start", "end", "rank", F.array_join("path", ">").alias("path"), F.round("cost", 6).alias("cost"))


def identity_clusters(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "chemical_xrefs").filter("xref_type = 'related'").select("chemical_uid", F.concat_ws(":", F.upper(F.trim("xref_source")), F.trim("xref_id")).alias("identifier"))
    return G.identity_clusters(x, "chemical_uid", "identifier")


QUERIES = {f.__name__: f for f in (
    graph_nodes, graph_edges, graph_sparse_edges, graph_skipped_edges, graph_edge_types, graph_degree, graph_two_hop_context, graph_k_hop,
    graph_closure, graph_strongest_edges, graph_pagerank, graph_cheapest_paths, identity_clusters,
)}

_UID = "'node_' || left(sha1('{k}|' || {c}), 20)"
uid = lambda k, c: _UID.format(k=k, c=c)
_NODES = " union all ".join(
    f"select {uid(s.kind, s.key)} as node_uid, '{s.kind}' as node_type, {s.names[0]} as display_name, '{s.kind.upper()}:' || {s.key} as primary_id, {i} as spec_order from {s.table}"
    for i, s in enumerate(NODES)
)
_EDGES = " union all ".join(
    f"select '{e.kind}' as edge_type, {i} as place, {uid(*e.subject)} as subject_uid, '{e.predicate}' as predicate, {uid(*e.object)} as object_uid, {e.weight or '1.0'}::double as weight from {e.table}"
    for i, e in enumerate(EDGES)
)
_IDX = "select row_number() over (order by spec_order, node_uid) - 1 as node_idx, * from nodes"
_WALK = """
    e as (select 'n' || n_nationkey as a, 'r' || n_regionkey as b, 1 / (2 + n_nationkey) as p from nation
          union all select 'r' || n_regionkey, 'n' || n_nationkey, 0.5 / (2 + n_nationkey) from nation
          union all select 's' || s_suppkey, 'n' || s_nationkey, 1 / (3 + s_suppkey % 5) from supplier),
    w1 as (select a as start, [a, b] as path, -ln(p) as cost from e where a like 's%'),
    w2 as (select start, list_append(path, b) as path, cost - ln(p) as cost from w1 join e on e.a = path[-1] where not list_contains(path, b)),
    w3 as (select start, list_append(path, b) as path, cost - ln(p) as cost from w2 join e on e.a = path[-1] where not list_contains(path, b)),
    w as (select * from w1 union all select * from w2 union all select * from w3)"""
_PI = """
    f as (select l_partkey, l_suppkey, sum(l_quantity) as w from lineitem group by 1, 2),
    e as (select 'p' || l_partkey as a, 's' || l_suppkey as b, w from f union all select 's' || l_suppkey, 'p' || l_partkey, w from f),
    s as (select a, b, w / sum(w) over (partition by a) as share from e),
    y as (select 's' || s_suppkey as node, 1.0::double / count(*) over () as y from supplier where s_nationkey = 3),
    pi0 as (select node, y as score from y)""" + "".join(
    f""",
    pi{i} as (select node, sum(x) as score from (select b as node, share * score * 0.85::double as x from s join pi{i - 1} on a = node union all select node, y * 0.15::double from y) group by 1)"""
    for i in range(1, 31)
)

ORACLES = {
    "graph_nodes": f"with nodes as ({_NODES}) select node_idx, node_uid, node_type, display_name, primary_id from ({_IDX})",
    "graph_edges": f"select edge_type, subject_uid, predicate, object_uid, count(*) as n, round(sum(weight), 2) as weight from ({_EDGES}) group by 1, 2, 3, 4",
    "graph_sparse_edges": f"""
        with nodes as ({_NODES}), idx as ({_IDX}), edges as ({_EDGES})
        select edge_type, s.node_idx as subject_idx, o.node_idx as object_idx, weight from edges join idx s on subject_uid = s.node_uid join idx o on object_uid = o.node_uid""",
    "graph_skipped_edges": f"""
        with nodes as ({_NODES}), edges as ({_EDGES}), j as (
          select edge_type, s.node_uid is null as ms, o.node_uid is null as mo from edges left join nodes s on subject_uid = s.node_uid left join nodes o on object_uid = o.node_uid)
        select edge_type, count(*) filter (ms) as missing_subject, count(*) filter (mo) as missing_object, count(*) filter (ms or mo) as skipped, count(*) filter (not ms and not mo) as kept from j group by 1""",
    "graph_edge_types": f"select (row_number() over (order by min(place)) - 1) as edge_type_id, edge_type, count(*) as n_edges from ({_EDGES}) group by edge_type",
    "graph_degree": f"""
        with edges as ({_EDGES}), ends as (select subject_uid as node_uid, 1 as o, 0 as i from edges union all select object_uid, 0, 1 from edges)
        select node_uid, count(*) as degree, sum(o)::bigint as out_degree, sum(i)::bigint as in_degree from ends group by 1""",
    "graph_two_hop_context": """
        select l_partkey, count(*) as n_context, string_agg(s_nationkey::varchar, ',' order by s_nationkey) as context
        from (select distinct l_partkey, s_nationkey from lineitem join supplier on l_suppkey = s_suppkey) group by 1""",
    "graph_k_hop": """
        with e0 as (select 'c' || c_custkey as a, 'n' || c_nationkey as b from customer union all select 'n' || n_nationkey, 'r' || n_regionkey from nation),
        e as (select a, b from e0 union select b, a from e0),
        h as (select 'r1' as node, 0 as hops union select b, 1 from e where a = 'r1'),
        h2 as (select * from h union select b, 2 from e join h on a = node and hops = 1 where b not in (select node from h)),
        h3 as (select * from h2 union select b, 3 from e join h2 on a = node and hops = 2 where b not in (select node from h2))
        select node, hops from h3""",
    "graph_closure": """
        with recursive c as (select p_partkey as child, p_partkey // 2 as ancestor, 1 as depth from part where p_partkey > 1
          union all select child, ancestor // 2, depth + 1 from c where ancestor > 1)
        select child, ancestor, depth from c""",
    "graph_strongest_edges": """
        select subject, object, weight from (select l_suppkey as subject, l_partkey as object, sum(l_quantity) as weight,
          row_number() over (partition by l_suppkey order by sum(l_quantity) desc, l_partkey) as rn from lineitem group by 1, 2) where rn <= 160""",
    "graph_pagerank": f"with {_PI} select node, round(score, 8) as score from pi30",
    "graph_cheapest_paths": f"""
        with {_WALK}
        select start, "end", rank, path, cost from (select start, path[-1] as "end", array_to_string(path, '>') as path, round(cost, 6) as cost,
          row_number() over (partition by start, path[-1] order by cost, array_to_string(path, '>'))::int as rank from w where path[-1] like 'r%') where rank <= 2""",
    "identity_clusters": """
        with recursive l as (select distinct chemical_uid as r, concat_ws(':', upper(trim(xref_source)), trim(xref_id, ' ')) as i from chemical_xrefs where xref_type = 'related'),
        e as (select distinct a.r as a, b.r as b from l a join l b using (i)),
        t as (select distinct r as a, r as b from l union select t.a, e.b from t join e on t.b = e.a)
        select a as chemical_uid, min(b) as cluster from t group by 1""",
}
