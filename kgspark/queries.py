"""Registered queries on the graph of the driver's tables, one or more for each operator, and the same in SQL."""

from __future__ import annotations

import io
import json
import tarfile
import uuid
from collections.abc import Callable

from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark import service
from kgspark.functions.terms import decoded, encoded, full_column, is_curie, name_class, readable_bytes, stable_hash
from kgspark.operators import aggregates, metadata, paths, traverse
from kgspark.plans import dsl, message, pattern, report, resolve
from kgspark.sources import archive, release, tables
from kgspark.sources.folders import shared_dir
from kgspark.sources.store import GraphStore, from_triples, variants
from kgspark.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def on_graph(name: str, sql: str | None, island: bool = False) -> Callable:
    """Registers a function of the store; sql follows the graph's common table expressions."""

    def add(f: Callable[[GraphStore], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(tables.graph(spark, sf_dir, island))
        if sql:
            ctes = tables.ISLAND_SQL if island else tables.SQL
            recursive = sql.lstrip().startswith("RECURSIVE")
            ORACLE_SQL[name] = f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{', ' if recursive or sql.lstrip().startswith('AND ') else ' '}{sql.lstrip().removeprefix('RECURSIVE').removeprefix('AND ')}"
        return f

    return add


def ids(store: GraphStore, *values: str) -> DataFrame:
    return store.spark.createDataFrame([(v,) for v in values], "id string")


def walk(store: GraphStore, spec: list, **kw) -> DataFrame:
    return traverse.match_path(store, spec, limit=None, **kw)


def bound(store: GraphStore, graph: dict, columns: list[str], **kw) -> DataFrame:
    return pattern.bindings(store, graph, **kw).select(*columns)


def qgraph(nodes: dict, **edges: tuple) -> dict:
    """nodes by key, edges as (subject, predicates, object) or with a dict of constraints as fourth."""
    return {"nodes": nodes, "edges": {k: {"subject": e[0], "predicates": e[1], "object": e[2]} | (e[3] if len(e) > 3 else {}) for k, e in edges.items()}}


# The showcase shapes


@on_graph("shape01_one_hop_category", "SELECT DISTINCT object AS part FROM t WHERE subject = 'SUPP:1' AND predicate = 'affects'")
def _(g):
    return walk(g, ["SUPP:1", "affects", {"category": "Part"}]).select(F.col("n1").alias("part"))


@on_graph("shape02_one_hop_any", "SELECT predicate, object FROM t WHERE subject = 'PART:1'")
def _(g):
    return walk(g, ["PART:1", None, None]).select(F.col("p0").alias("predicate"), F.col("n1").alias("object"))


TWO_HOP = "SELECT a.object AS n1, b.object AS n2 FROM t a JOIN t b ON b.subject = a.object AND b.predicate = 'contains' WHERE a.subject = 'CUST:1' AND a.predicate = 'places'"


@on_graph("shape03_two_hop", TWO_HOP)
def two_hop(g):
    return walk(g, ["CUST:1", "places", {"category": "Order"}, "contains", {"category": "Part"}]).select("n1", "n2")


@on_graph("shape04_both_pinned", "SELECT subject, object FROM t WHERE subject = 'NATION:1' AND predicate = 'subclass_of' AND object = 'REGION:1'")
def _(g):
    return walk(g, ["NATION:1", "subclass_of", "REGION:1"]).select(F.col("s0").alias("subject"), F.col("o0").alias("object"))


QUALIFIED = {"qualifier_constraints": [{"qualifier_set": [{"qualifier_type_id": "biolink:object_direction_qualifier", "qualifier_value": "R"}, {"qualifier_type_id": "biolink:object_aspect_qualifier", "qualifier_value": "F"}]}]}


@on_graph("shape05_qualifiers", "SELECT DISTINCT object AS part FROM e WHERE subject = 'SUPP:1' AND predicate = 'affects' AND direction = 'R' AND aspect = 'F'")
def _(g):
    return bound(g, qgraph({"a": {"ids": ["SUPP:1"]}, "b": {"categories": ["biolink:Part"]}}, e=("a", ["biolink:affects"], "b", QUALIFIED)), ["n_b"]).withColumnRenamed("n_b", "part")


@on_graph("shape06_shared_object", "SELECT b.subject AS n2 FROM t a JOIN t b ON b.object = a.object AND b.predicate = 'has_brand' WHERE a.subject = 'PART:1' AND a.predicate = 'has_brand'")
def _(g):
    return walk(g, ["PART:1", "has_brand", None, "has_brand", None], hop_directions=[True, False]).select("n2")


@on_graph("shape07_branching", "SELECT a.object AS brand, b.object AS ptype FROM t a JOIN t b ON b.subject = a.subject AND b.predicate = 'subclass_of' WHERE a.subject = 'PART:1' AND a.predicate = 'has_brand'")
def _(g):
    return bound(g, qgraph({"p": {"ids": ["PART:1"]}, "b": {}, "t": {}}, x=("p", ["has_brand"], "b"), y=("p", ["subclass_of"], "t")), ["n_b", "n_t"], node_subclassing=False).toDF("brand", "ptype")


TRIANGLE_NODES = {"a": {"categories": ["Nation"]}, "b": {"categories": ["Nation"]}, "c": {"categories": ["Nation"]}}


@on_graph("shape08_triangle", "SELECT x.subject AS a, x.object AS b, y.object AS c FROM t x JOIN t y ON y.subject = x.object AND y.predicate = 'regulates' JOIN t z ON z.subject = x.subject AND z.object = y.object AND z.predicate = 'regulates' WHERE x.predicate = 'regulates'")
def _(g):
    return bound(g, qgraph(TRIANGLE_NODES, e=("a", ["regulates"], "b"), f=("b", ["regulates"], "c"), h=("a", ["regulates"], "c")), ["n_a", "n_b", "n_c"]).toDF("a", "b", "c")


@on_graph(
    "shape08_triangle_symmetric",
    "AND s AS (SELECT subject AS x, object AS y FROM t WHERE predicate = 'interacts_with' UNION SELECT object, subject FROM t WHERE predicate = 'interacts_with') SELECT p.x AS a, p.y AS b, q.y AS c FROM s p JOIN s q ON q.x = p.y JOIN s r ON r.x = p.x AND r.y = q.y",
)
def _(g):
    return bound(g, qgraph(TRIANGLE_NODES, e=("a", ["interacts_with"], "b"), f=("b", ["interacts_with"], "c"), h=("a", ["interacts_with"], "c")), ["n_a", "n_b", "n_c"]).toDF("a", "b", "c")


@on_graph("shape09_batch_ids", "SELECT subject AS n0, object AS n1 FROM t WHERE subject IN ('SUPP:1', 'SUPP:2') AND predicate = 'affects'")
def _(g):
    return walk(g, [["SUPP:1", "SUPP:2"], "affects", None]).select("n0", "n1")


@on_graph("shape10_any_of_predicates", "SELECT predicate, object FROM t WHERE subject = 'PART:1' AND predicate IN ('has_brand', 'subclass_of')")
def _(g):
    return walk(g, ["PART:1", ("has_brand", "subclass_of"), None]).select(F.col("p0").alias("predicate"), F.col("n1").alias("object"))


@on_graph("shape11_symmetric", "SELECT object AS other FROM t WHERE subject = 'NATION:6' AND predicate = 'interacts_with' UNION SELECT subject FROM t WHERE object = 'NATION:6' AND predicate = 'interacts_with'")
def _(g):
    return walk(g, ["NATION:6", "interacts_with", None], symmetric=True).select(F.col("n1").alias("other"))


@on_graph("shape12_edge_attribute", "SELECT DISTINCT subject FROM e WHERE predicate = 'located_in' AND object = 'NATION:1' AND agent_type = 'BUILDING'")
def _(g):
    return bound(g, qgraph({"a": {}, "b": {"ids": ["NATION:1"]}}, e=("a", ["located_in"], "b", {"attribute_constraints": [{"id": "biolink:agent_type", "operator": "==", "value": "BUILDING"}]})), ["n_a"]).toDF("subject")


@on_graph("shape13_three_hop", TWO_HOP.replace("b.object AS n2", "b.object AS n2, c.object AS n3").replace("WHERE", "JOIN t c ON c.subject = b.object AND c.predicate = 'has_brand' WHERE"))
def _(g):
    return walk(g, ["CUST:1", "places", None, "contains", None, "has_brand", None]).select("n1", "n2", "n3")


@on_graph("shape14_subclass_depth_1", "SELECT x.subject, x.object FROM t x JOIN t h ON h.subject = x.object AND h.predicate = 'subclass_of' AND h.object = 'REGION:1' WHERE x.predicate = 'located_in'")
def _(g):
    return bound(g, qgraph({"a": {}, "b": {"ids": ["REGION:1"]}}, e=("a", ["located_in"], "b")), ["n_a", "n_b"]).toDF("subject", "object")


@on_graph("shape15_open_subject", "SELECT subject FROM t WHERE predicate = 'contains' AND object = 'PART:1'")
def _(g):
    return walk(g, [None, "contains", "PART:1"]).select(F.col("n0").alias("subject"))


@on_graph("A1_predicate_counts", "SELECT predicate, count(*) AS records FROM e GROUP BY predicate")
def _(g):
    return aggregates.predicate_counts(g)


@on_graph("A2_category_counts", "SELECT category, count(DISTINCT id) AS members FROM n GROUP BY category")
def _(g):
    return aggregates.category_counts(g)


@on_graph("A12_top_degree", "SELECT subject AS id, count(DISTINCT object) AS degree FROM e GROUP BY subject ORDER BY degree DESC, id LIMIT 10")
def _(g):
    return aggregates.out_degree(g).orderBy(F.desc("degree"), "id").limit(10)


# Lookups and filters


@on_graph("F1_node", "SELECT id, name, 'biolink:' || category AS category FROM n WHERE id = 'NATION:3'")
def _(g):
    found = metadata.node(g, "NATION:3")
    return g.spark.createDataFrame([(found["id"], found["name"], c) for c in found["category"]], "id string, name string, category string")


@on_graph("F3_edge_variants", "SELECT DISTINCT subject, predicate, object, direction, aspect FROM e WHERE subject = 'SUPP:1' AND predicate = 'affects'")
def _(g):
    return variants(g.edges.where("subject = 'SUPP:1' AND predicate = 'affects'")).select("subject", "predicate", "object", F.col("qualifiers")["object_direction_qualifier"].alias("direction"), F.col("qualifiers")["object_aspect_qualifier"].alias("aspect"))


FINGERPRINT = """substr(sha1('{"object_aspect_qualifier":"' || aspect || '","object_direction_qualifier":"' || direction || '"}'), 1, 10)"""


@on_graph("F2_least_variant", f"SELECT subject, object, min_by(direction, {FINGERPRINT}) AS direction, min_by(aspect, {FINGERPRINT}) AS aspect FROM e WHERE predicate = 'affects' GROUP BY subject, object")
def _(g):
    return metadata.least_variants(g.edges.where("predicate = 'affects'")).select("subject", "object", F.col("qualifiers")["object_direction_qualifier"].alias("direction"), F.col("qualifiers")["object_aspect_qualifier"].alias("aspect"))


@on_graph("F2_edge", f"SELECT direction, aspect FROM e WHERE predicate = 'affects' AND subject = 'SUPP:1' AND object = (SELECT min(object) FROM e WHERE predicate = 'affects' AND subject = 'SUPP:1') ORDER BY {FINGERPRINT} LIMIT 1")
def _(g):
    least = g.edges.where("predicate = 'affects' AND subject = 'SUPP:1'").agg(F.min("object")).first()[0]
    found = metadata.edge(g, "SUPP:1", "biolink:affects", least)
    return g.spark.createDataFrame([(found["object_direction_qualifier"], found["object_aspect_qualifier"])], "direction string, aspect string")


@on_graph("F4_filter_nodes", "SELECT id FROM n WHERE id IN ('PART:1', 'NATION:1', 'PART:2') AND category = 'Part'")
def _(g):
    return metadata.filter_nodes(g, ids(g, "PART:1", "NATION:1", "PART:2", "PART:none"), "biolink:Part")


@on_graph("F5_nodes_by_category", "SELECT id FROM n WHERE category = 'Supplier'")
def _(g):
    return metadata.nodes_by_category(g, "Supplier")


@on_graph("F6_filter_edges", "SELECT DISTINCT subject, predicate, object, agent_type FROM e WHERE predicate = 'located_in' AND knowledge_level = 'assertion' AND agent_type = 'BUILDING'")
def _(g):
    return metadata.filter_edges(g, g.triples.where("predicate = 'located_in'"), "assertion", "BUILDING").select("subject", "predicate", "object", "agent_type")


@on_graph("F7_any_predicate", "SELECT DISTINCT subject, predicate, object FROM e WHERE subject = 'PART:1'")
def _(g):
    wanted = g.pairs.where("subject = 'PART:1'").select("subject", F.lit(None).cast("string").alias("predicate"), "object")
    return metadata.filter_edges(g, wanted).select("subject", "predicate", "object").distinct()


@on_graph("F8_extra_filters", "SELECT DISTINCT subject, object FROM e WHERE predicate = 'affects' AND subject IN ('SUPP:1', 'SUPP:2') AND aspect = 'O'")
def _(g):
    return metadata.filter_edges(g, g.triples.where("predicate = 'affects' AND subject IN ('SUPP:1', 'SUPP:2')"), extra_filters={"object_aspect_qualifier": "O"}).select("subject", "object").distinct()


@on_graph("F11_has_edge", "SELECT count(*) > 0 AS found FROM t WHERE subject = 'NATION:1' AND object = 'REGION:1' AND predicate = 'subclass_of'")
def _(g):
    return g.spark.createDataFrame([(metadata.has_edge(g, "NATION:1", "REGION:1", "biolink:subclass_of"),)], "found boolean")


@on_graph("F12_edges_between", "SELECT 'biolink:' || predicate AS predicate FROM t WHERE subject = 'NATION:0' AND object = 'REGION:0'")
def _(g):
    return metadata.edges_between(g, "NATION:0", "REGION:0")


@on_graph("F14_numeric_constraint", "SELECT DISTINCT 'SUPP:' || CAST(s_suppkey AS VARCHAR) AS subject, 'NATION:' || CAST(s_nationkey AS VARCHAR) AS object FROM supplier WHERE s_acctbal > 4500.5")
def _(g):
    return bound(g, qgraph({"a": {}, "b": {}}, e=("a", ["located_in"], "b", {"attribute_constraints": [{"id": "biolink:balance", "operator": ">", "value": 4500.5}]})), ["n_a", "n_b"]).toDF("subject", "object")


@on_graph("F15_node_constraint", "SELECT t.subject, t.object FROM t JOIN n ON n.id = t.subject WHERE t.predicate = 'located_in' AND t.object = 'NATION:2' AND regexp_matches(lower(n.name), 'supp.*1')")
def _(g):
    return bound(g, qgraph({"a": {"constraints": [{"id": "biolink:name", "operator": "matches", "value": "/SUPP.*1/i"}]}, "b": {"ids": ["NATION:2"]}}, e=("a", ["located_in"], "b")), ["n_a", "n_b"]).toDF("subject", "object")


@on_graph("F16_negated_constraint", "SELECT DISTINCT subject, object FROM e WHERE predicate = 'located_in' AND object = 'NATION:1' AND coalesce(agent_type, '') <> 'BUILDING'")
def _(g):
    return bound(g, qgraph({"a": {}, "b": {"ids": ["NATION:1"]}}, e=("a", ["located_in"], "b", {"attribute_constraints": [{"id": "agent_type", "operator": "==", "value": "BUILDING", "not": True}]})), ["n_a", "n_b"]).toDF("subject", "object")


@on_graph("F17_qualifier_sets", "SELECT DISTINCT subject, object FROM e WHERE predicate = 'affects' AND ((direction = 'R' AND aspect = 'F') OR (direction = 'N' AND aspect = 'O'))")
def _(g):
    sets = [{"qualifier_set": [{"qualifier_type_id": "biolink:object_direction_qualifier", "qualifier_value": d}, {"qualifier_type_id": "biolink:object_aspect_qualifier", "qualifier_value": a}]} for d, a in (("R", "F"), ("N", "O"))]
    return bound(g, qgraph({"a": {"categories": ["Supplier"]}, "b": {}}, e=("a", ["affects"], "b", {"qualifier_constraints": sets})), ["n_a", "n_b"]).toDF("subject", "object")


@on_graph("F18_conformance", "SELECT x.subject, x.object FROM t x JOIN t h ON h.subject = x.object AND h.predicate = 'subclass_of' AND h.object = 'REGION:2' JOIN n ON n.id = x.object AND n.category = 'Nation' WHERE x.predicate = 'located_in'")
def _(g):
    return bound(g, qgraph({"a": {}, "b": {"ids": ["REGION:2"], "categories": ["Nation"]}}, e=("a", ["located_in"], "b")), ["n_a", "n_b"]).toDF("subject", "object")


# Joins


@on_graph("J1_neighbors", "SELECT DISTINCT object AS id FROM t WHERE subject = 'CUST:7'")
def _(g):
    return traverse.neighbors(g, "CUST:7")


@on_graph("J1_neighbors_subclassing", "SELECT DISTINCT object AS id FROM t WHERE predicate = 'interacts_with' AND subject IN (SELECT subject FROM t WHERE predicate = 'subclass_of' AND object = 'REGION:3' UNION SELECT 'REGION:3')")
def _(g):
    return traverse.neighbors(g, "REGION:3", "interacts_with", node_subclassing=True)


@on_graph("J2_expansion", "SELECT a.subject AS n0, b.object AS n2 FROM t a JOIN t b ON b.subject = a.object AND b.predicate = 'subclass_of' WHERE a.predicate = 'located_in'")
def _(g):
    return walk(g, [None, "located_in", None, "subclass_of", None]).select("n0", "n2")


@on_graph("J3_reverse", "SELECT DISTINCT subject AS n1 FROM t WHERE object = 'BRAND:Brand#11' AND predicate = 'has_brand'")
def _(g):
    return walk(g, ["BRAND:Brand#11", "has_brand", None], hop_directions=[False]).select("n1")


@on_graph("J4_symmetric_all", "SELECT subject AS here, object AS there FROM t WHERE predicate = 'interacts_with' UNION SELECT object, subject FROM t WHERE predicate = 'interacts_with'")
def _(g):
    return traverse.hop(g, "interacts_with", both_if_symmetric=True).select("here", "there")


@on_graph("J6_metadata_hop", "SELECT DISTINCT subject AS n0, object AS n1 FROM e WHERE predicate = 'located_in' AND agent_type = 'manual'")
def _(g):
    return walk(g, [None, {"predicate": "located_in", "agent_type": "manual"}, None]).select("n0", "n1")


@on_graph("J10_verify_pairs", "SELECT subject, object, predicate FROM t WHERE split_part(subject, ':', 1) = 'NATION' AND (subject, object) IN (SELECT subject, object FROM t WHERE predicate = 'interacts_with')")
def _(g):
    return metadata.predicates_of(g, g.triples.where("predicate = 'interacts_with'"))


@on_graph("J11_multiway", "SELECT a.object AS part FROM t a JOIN t b ON b.object = a.object AND b.predicate = 'affects' AND b.subject = 'SUPP:2' JOIN t c ON c.subject = a.object AND c.predicate = 'has_brand' WHERE a.predicate = 'affects' AND a.subject = 'SUPP:1'")
def _(g):
    return bound(g, qgraph({"a": {"ids": ["SUPP:1"]}, "b": {"ids": ["SUPP:2"]}, "p": {}, "x": {}}, e=("a", ["affects"], "p"), f=("b", ["affects"], "p"), h=("p", ["has_brand"], "x")), ["n_p"], node_subclassing=False).toDF("part")


@on_graph("J15_anti", "AND d AS (SELECT object FROM t WHERE subject = 'SUPP:1') SELECT DISTINCT b.object AS id FROM t a JOIN t b ON b.subject = a.object WHERE a.subject = 'SUPP:1' AND b.object NOT IN (SELECT object FROM d)")
def _(g):
    direct = traverse.neighbors(g, "SUPP:1")
    return walk(g, ["SUPP:1", None, None, None, None]).select(F.col("n2").alias("id")).distinct().join(direct, "id", "left_anti")


#: Pairs of ends and how many ways round they are linked.
WAYS = "AND u AS (SELECT predicate, least(subject, object) AS a, greatest(subject, object) AS b, count(*) AS ways FROM t GROUP BY 1, 2, 3)"


@on_graph("J18_mutual", f"{WAYS} SELECT predicate, a AS subject, b AS object FROM u WHERE ways = 2 OR a = b UNION SELECT predicate, b, a FROM u WHERE ways = 2 OR a = b")
def _(g):
    return aggregates.mutual(g)


# Paths


@on_graph("N1_descendants", "RECURSIVE d(id, depth) AS (SELECT 'REGION:1', 0 UNION SELECT t.subject, d.depth + 1 FROM t JOIN d ON t.object = d.id WHERE t.predicate = 'subclass_of' AND d.depth < 5) SELECT id, min(depth) AS depth FROM d GROUP BY id")
def _(g):
    return traverse.descendants(g, ["REGION:1"]).select("id", "depth")


@on_graph("N2_shortest_length", "RECURSIVE d(id, depth) AS (SELECT 'CUST:1', 0 UNION SELECT t.object, d.depth + 1 FROM t JOIN d ON t.subject = d.id WHERE d.depth < 3) SELECT min(depth) AS hops FROM d WHERE id = 'BRAND:Brand#11'")
def _(g):
    found = paths.shortest_path(g, "CUST:1", "BRAND:Brand#11")
    return g.spark.createDataFrame([(None if found is None else len(found),)], "hops int")


@on_graph("N3_all_shortest", "SELECT a.subject || '>' || a.object || '>' || b.object || '>' || c.object AS path FROM (SELECT DISTINCT subject, object FROM t) a JOIN (SELECT DISTINCT subject, object FROM t) b ON b.subject = a.object JOIN (SELECT DISTINCT subject, object FROM t) c ON c.subject = b.object WHERE a.subject = 'CUST:1' AND c.object = 'BRAND:Brand#11'")
def _(g):
    rows = paths.all_shortest_paths(g, "CUST:1", "BRAND:Brand#11")
    return rows.select(F.concat(F.col("path")[0]["subject"], F.lit(">"), F.array_join(F.transform("path", lambda e: e["object"]), ">")).alias("path"))


@on_graph(
    "N4_simple_paths",
    "RECURSIVE w(id, path, depth) AS (SELECT 'NATION:0', 'NATION:0', 0 UNION ALL SELECT t.object, w.path || '>' || t.object, w.depth + 1 FROM t JOIN w ON t.subject = w.id WHERE w.depth < 4 AND w.id <> 'REGION:0' AND position('>' || t.object || '>' IN '>' || w.path || '>') = 0) SELECT path FROM w WHERE id = 'REGION:0'",
)
def _(g):
    rows = paths.all_paths(g, "NATION:0", "REGION:0", max_depth=4)
    return rows.select(F.concat(F.col("path")[0]["subject"], F.lit(">"), F.array_join(F.transform("path", lambda e: e["object"]), ">")).alias("path"))


@on_graph("N5_predicate_sequence", "SELECT a.subject AS n0, a.object AS n1, b.object AS n2 FROM t a JOIN t b ON b.subject = a.object AND b.predicate = 'subclass_of' WHERE a.predicate = 'located_in' AND a.subject = 'CUST:5' AND b.object LIKE 'REGION:%' AND b.object = (SELECT max(object) FROM t WHERE predicate = 'subclass_of' AND subject = a.object)")
def _(g):
    nation = g.triples.where("subject = 'CUST:5' AND predicate = 'located_in'").first().object
    region = g.triples.where((F.col("subject") == nation) & (F.col("predicate") == "subclass_of")).first().object
    return paths.paths_by_predicates(g, "CUST:5", region, ["located_in", "subclass_of"])


@on_graph("N6_pinned_ends", TWO_HOP.replace("b.object AS n2", "b.object AS n2, c.object AS n3").replace("WHERE", "JOIN t c ON c.subject = b.object AND c.predicate = 'subclass_of' AND c.object = 'PTYPE:ECONOMY' WHERE"))
def _(g):
    return walk(g, ["CUST:1", "places", None, "contains", None, "subclass_of", "PTYPE:ECONOMY"]).select("n1", "n2", "n3")


@on_graph("N9_ordered_limit", "SELECT subject AS n0, predicate AS p0, subject AS s0, object AS o0, object AS n1 FROM t WHERE predicate = 'affects' ORDER BY n0, p0, s0, o0, n1 LIMIT 25")
def _(g):
    return traverse.match_path(g, [{"category": "Supplier"}, "affects", None], limit=25)


@on_graph("N12_components", "SELECT CASE WHEN subject LIKE 'USER:%' THEN 'island' ELSE 'main' END AS part, count(DISTINCT id) AS nodes FROM (SELECT subject, subject AS id FROM t UNION ALL SELECT subject, object FROM t) GROUP BY 1", island=True)
def _(g):
    sizes = paths.components(g).groupBy("component").agg(F.count("*").alias("nodes"), F.max("id").alias("last"))
    return sizes.select(F.when(F.col("last").startswith("USER:"), "island").otherwise("main").alias("part"), "nodes")


@on_graph("N12_relation_components", "SELECT min(o.n_nationkey) AS least, count(*) AS nodes FROM nation o GROUP BY o.n_regionkey")
def _(g):
    return paths.components(g, "interacts_with").groupBy("component").agg(F.min(F.split_part("id", F.lit(":"), F.lit(2)).cast("int")).alias("least"), F.count("*").alias("nodes")).select("least", "nodes")


@on_graph("N13_associations", "SELECT a.object AS n1, b.object AS n2 FROM t a JOIN t b ON b.subject = a.object JOIN n ON n.id = b.object AND n.category = 'Brand' WHERE a.subject = 'SUPP:4'")
def _(g):
    return traverse.associations(g, "SUPP:4", "Brand", 2, None, node_subclassing=False).select("n1", "n2")


@on_graph("N_levels", "RECURSIVE d(id, depth) AS (SELECT 'CUST:2', 0 UNION SELECT t.object, d.depth + 1 FROM t JOIN d ON t.subject = d.id WHERE d.depth < 6) SELECT depth, count(*) AS nodes FROM (SELECT id, min(depth) AS depth FROM d GROUP BY id) GROUP BY depth")
def _(g):
    return paths.reachable(g, "CUST:2").groupBy("depth").agg(F.count("*").alias("nodes"))


# Query graphs


@on_graph("T5_per_predicate", "SELECT a.subject AS a, a.object AS b, a.predicate AS p FROM t a WHERE a.subject IN ('PART:1', 'PART:2')")
def _(g):
    return bound(g, qgraph({"a": {"ids": ["PART:1", "PART:2"]}, "b": {}}, e=("a", [], "b")), ["n_a", "n_b", "p_e"], node_subclassing=False).toDF("a", "b", "p")


@on_graph("T5_collapsed", "SELECT subject AS a, object AS b, min(predicate) AS p FROM t WHERE subject = 'NATION:0' GROUP BY subject, object")
def _(g):
    return bound(g, qgraph({"a": {"ids": ["NATION:0"]}, "b": {}}, e=("a", [], "b")), ["n_a", "n_b", "p_e"], node_subclassing=False, collapse_predicates=True).toDF("a", "b", "p")


@on_graph("T12_query_ids", "SELECT x.subject AS a, x.object AS b, CASE WHEN x.object = 'REGION:1' THEN NULL ELSE 'REGION:1' END AS query_id FROM t x WHERE x.predicate = 'located_in' AND x.object IN (SELECT subject FROM t WHERE predicate = 'subclass_of' AND object = 'REGION:1' UNION SELECT 'REGION:1')")
def _(g):
    return bound(g, qgraph({"a": {}, "b": {"ids": ["REGION:1"]}}, e=("a", ["located_in"], "b")), ["n_a", "n_b", "q_b"]).toDF("a", "b", "query_id")


# Aggregates


@on_graph("A5_sizes", "SELECT (SELECT count(*) FROM e) AS records, (SELECT count(*) FROM t) AS triples, (SELECT count(*) FROM (SELECT DISTINCT subject, object FROM t)) AS pairs, (SELECT count(*) FROM (SELECT DISTINCT subject, predicate, object, direction, aspect FROM e)) AS variants, (SELECT count(DISTINCT predicate) FROM t) AS predicates, (SELECT count(*) FROM n) AS node_records, (SELECT count(*) FROM (SELECT subject FROM t UNION SELECT object FROM t)) AS graph_nodes")
def _(g):
    return aggregates.sizes(g)


STATS = f"{WAYS}, s AS (SELECT predicate, CAST(sum(ways) AS BIGINT) AS directed, count(*) FILTER (a = b) AS self_loops, count(*) FILTER (a <> b AND ways = 2) AS mutual_pairs, 2 * count(*) FILTER (a <> b AND ways = 2) + count(*) FILTER (a = b) AS recip_directed, predicate = 'interacts_with' AS symmetric FROM u GROUP BY predicate)"


@on_graph("A6_audit", f"{STATS} SELECT * FROM s")
def _(g):
    return aggregates.audit(g)


@on_graph(
    "A7_findings",
    f"{STATS} SELECT * FROM (SELECT CASE WHEN s.symmetric THEN CASE WHEN recip_directed < 0.999 * directed THEN 'info' END WHEN self_loops = 0 AND mutual_pairs = 0 THEN NULL WHEN predicate IN ('subclass_of', 'located_in', 'part_of') THEN 'high' "
    "WHEN predicate IN ('affects', 'regulates') THEN CASE WHEN mutual_pairs > 0 THEN 'low' ELSE 'medium' END WHEN mutual_pairs > 0 THEN 'medium' ELSE 'low' END AS severity, predicate, self_loops, mutual_pairs FROM s) WHERE severity IS NOT NULL",
)
def _(g):
    return aggregates.findings(g).select("severity", "predicate", "self_loops", "mutual_pairs")


@on_graph("A8_examples", f"{WAYS} SELECT predicate, a, b FROM (SELECT *, row_number() OVER (PARTITION BY predicate ORDER BY a = b, a, b) AS k FROM u WHERE ways = 2 OR a = b) WHERE k <= 10")
def _(g):
    return aggregates.examples(g)


@on_graph("A13_variant_histogram", "SELECT variants, count(*) AS triples FROM (SELECT subject, predicate, object, count(DISTINCT coalesce(direction, '') || coalesce(aspect, '')) AS variants FROM e GROUP BY subject, predicate, object) GROUP BY variants")
def _(g):
    return aggregates.variant_histogram(g)


@on_graph("A14_answer_sets", f"AND r AS ({TWO_HOP}) SELECT 'n1' AS qnode, n1 AS id FROM r UNION SELECT 'n2', n2 FROM r")
def _(g):
    return aggregates.answer_sets(two_hop(g), ["n1", "n2"])


@on_graph("A14_compare", f"AND r AS ({TWO_HOP}), l AS (SELECT DISTINCT n2 FROM r WHERE n1 < 'ORDER:5') SELECT 'n2' AS qnode, (SELECT count(*) FROM l) AS shared, 0 AS only_left, (SELECT count(DISTINCT n2) FROM r) - (SELECT count(*) FROM l) AS only_right")
def _(g):
    rows = two_hop(g)
    return aggregates.compare_answers(aggregates.answer_sets(rows.where("n1 < 'ORDER:5'"), ["n2"]), aggregates.answer_sets(rows, ["n2"]))


@on_graph("D7_representative_whole", "SELECT subject, object, min(predicate) AS predicate FROM t GROUP BY subject, object")
def _(g):
    return g.representative


@on_graph("U4_difference", "SELECT subject AS id FROM t WHERE predicate = 'located_in' AND object = 'NATION:1' EXCEPT SELECT subject FROM t WHERE predicate = 'places'")
def _(g):
    return g.triples.where("predicate = 'located_in' AND object = 'NATION:1'").select(F.col("subject").alias("id")).subtract(g.triples.where("predicate = 'places'").select(F.col("subject").alias("id")))


@on_graph("U3_intersection", "SELECT object AS id FROM t WHERE predicate = 'affects' AND subject = 'SUPP:1' INTERSECT SELECT object FROM t WHERE predicate = 'affects' AND subject = 'SUPP:2'")
def _(g):
    one, two = (g.triples.where((F.col("predicate") == "affects") & (F.col("subject") == s)).select(F.col("object").alias("id")) for s in ("SUPP:1", "SUPP:2"))
    return one.intersect(two)


@on_graph("X9_prefixes", "SELECT DISTINCT 'biolink:' || predicate AS predicate FROM t")
def _(g):
    return g.edges.select(full_column(F.col("predicate")).alias("predicate")).distinct()


@on_graph(
    "X12_groups",
    "SELECT CASE category WHEN 'Part' THEN 'chemical' WHEN 'Nation' THEN 'gene' WHEN 'Region' THEN 'disease' ELSE CASE split_part(id, ':', 1) WHEN 'CUST' THEN 'disease' WHEN 'SUPP' THEN 'anatomy' WHEN 'ORDER' THEN 'clinical' ELSE 'other' END END AS grp, split_part(id, ':', 1) AS prefix, count(*) AS nodes FROM n GROUP BY 1, 2",
)
def _(g):
    """Categories and prefixes are first put in the place of those that have a group."""
    as_category, as_prefix = ({"Part": "Drug", "Nation": "Gene", "Region": "Disease"}, {"CUST": "MONDO", "SUPP": "UBERON", "ORDER": "UMLS"})
    of = lambda known, c: F.coalesce(F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[c], c)
    prefix = F.split_part("id", F.lit(":"), F.lit(1))
    group = name_class(F.concat(of(as_prefix, prefix), F.lit(":1")), F.transform("category", lambda c: of(as_category, c)))
    return g.nodes.select(group.alias("grp"), prefix.alias("prefix")).groupBy("grp", "prefix").agg(F.count("*").alias("nodes"))


@on_graph("X14_resolve", "SELECT id, name, CASE WHEN lower(name) = 'united states' THEN 15.0 WHEN contains(lower(name), 'united states') THEN 5.0 ELSE 0.0 END + len(list_intersect(string_split(lower(name), ' '), ['united', 'states'])) / len(string_split(lower(name), ' ')) AS score FROM n WHERE category = 'Nation' AND (contains(' ' || lower(name) || ' ', ' united ') OR contains(' ' || lower(name) || ' ', ' states '))")
def _(g):
    return resolve.scored(g, "United States", "biolink:Nation").select("id", "name", "score")


# Operators whose answers are short: records, messages, texts and settings. Each is a table of what the operator says.


def table_of(g: GraphStore, rows: list[tuple], schema: str) -> DataFrame:
    return g.spark.createDataFrame(rows, schema)


def text(value: str) -> str:
    """A string as SQL has it."""
    return "'" + value.replace("'", "''") + "'"


def values(columns: str, *rows: tuple) -> str:
    """SQL of some fixed rows."""
    as_sql = lambda v: "NULL" if v is None else str(v) if isinstance(v, (bool, int)) else text(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(as_sql, r)) + ')' for r in rows)}) v({columns})"


@on_graph("J14_ends", "SELECT subject AS id FROM t UNION SELECT object FROM t")
def _(g):
    return g.graph_nodes


@on_graph("N8_hop_fields", "SELECT DISTINCT a.subject AS n0, a.object AS n1, b.object AS n2 FROM e a JOIN t b ON b.subject = a.object AND b.predicate = 'subclass_of' WHERE a.predicate = 'located_in' AND a.agent_type = 'MACHINERY' AND b.object = 'REGION:2'")
def _(g):
    return walk(g, [{"category": "Customer"}, {"predicate": "located_in", "agent_type": "MACHINERY"}, {"category": "Nation"}, "subclass_of", "REGION:2"]).select("n0", "n1", "n2")


@on_graph("N15_neighbors_of_category", "SELECT DISTINCT object AS id FROM t JOIN n ON n.id = t.object AND n.category = 'Nation' WHERE subject = 'CUST:11'")
def _(g):
    return table_of(g, [(i,) for i in service.list_neighbors(g, "CUST:11", category="Nation")["neighbors"]], "id string")


@on_graph("N16_expand_each", "SELECT subject AS n0, predicate AS p0, object AS n1 FROM t WHERE subject IN ('NATION:1', 'NATION:2', 'NATION:3')")
def _(g):
    return walk(g, [["NATION:1", "NATION:2", "NATION:3"], None, None]).select("n0", "p0", "n1")


@on_graph("L2_hop_cap", "AND f AS (SELECT * FROM t WHERE predicate = 'affects' AND subject = 'SUPP:5' ORDER BY object LIMIT 4) SELECT f.object AS n1, b.object AS n2 FROM f JOIN t b ON b.subject = f.object AND b.predicate = 'has_brand'")
def _(g):
    return walk(g, ["SUPP:5", "affects", None, "has_brand", None], hop_cap=4).select("n1", "n2")


@on_graph("L3_truncated", "SELECT least(count(*), 3) AS rows, count(*) > 3 AS truncated FROM t WHERE predicate = 'affects' AND subject = 'SUPP:5' UNION ALL SELECT least(count(*), 30), count(*) > 30 FROM t WHERE predicate = 'subclass_of' AND split_part(subject, ':', 1) = 'NATION'")
def _(g):
    rows = []
    for spec, limit in ((["SUPP:5", "affects", None], 3), ([{"category": "Nation"}, "subclass_of", None], 30)):
        stats = traverse.MatchStats()
        rows.append((traverse.match_path(g, spec, limit=limit, stats=stats).count(), stats.truncated))
    return table_of(g, rows, "rows long, truncated boolean")


@on_graph("L4_limits", values("asked, given", ("null", 1000), ("0", 1), ("7", 7), ("1000000", 10000)))
def _(g):
    return table_of(g, [(json.dumps(v), service.clamped(v)) for v in (None, 0, 7, 1_000_000)], "asked string, given int")


@on_graph("L5_ceilings", values("asked, refused", (1, False), (3, False), (4, True)))
def _(g):
    return table_of(g, [(n, "error" in service.find_associations(g, "CUST:1", "Nation", n, 1)) for n in (1, 3, 4)], "asked int, refused boolean")


def constraint_rows(g: GraphStore, operator: str, value: object) -> DataFrame:
    return bound(g, qgraph({"a": {}, "b": {"ids": ["NATION:4"]}}, e=("a", ["located_in"], "b", {"attribute_constraints": [{"id": "agent_type", "operator": operator, "value": value}]})), ["n_a"]).toDF("subject")


@on_graph("X2_strict_equality", "SELECT DISTINCT subject FROM e WHERE predicate = 'located_in' AND object = 'NATION:4' AND agent_type = 'HOUSEHOLD'")
def _(g):
    return constraint_rows(g, "===", "HOUSEHOLD")


@on_graph("X5_in", "SELECT DISTINCT subject FROM e WHERE predicate = 'located_in' AND object = 'NATION:4' AND agent_type IN ('HOUSEHOLD', 'manual')")
def _(g):
    return constraint_rows(g, "in", ["HOUSEHOLD", "manual"])


@on_graph("X5_in_text", "SELECT DISTINCT subject FROM e WHERE predicate = 'located_in' AND object = 'NATION:4' AND contains('BUILDING or MACHINERY', agent_type)")
def _(g):
    return constraint_rows(g, "in", "BUILDING or MACHINERY")


@on_graph("X11_stable_hash", "SELECT count(DISTINCT id) AS hashes FROM n")
def _(g):
    return g.nodes.select(stable_hash(F.col("id")).alias("h")).distinct().agg(F.count("*").alias("hashes"))


@on_graph("X17_json", """SELECT DISTINCT '{"object_direction_qualifier":"' || direction || '","object_aspect_qualifier":"' || aspect || '"}' AS text, direction FROM e WHERE predicate = 'affects'""")
def _(g):
    rows = g.edges.where("predicate = 'affects'").select(encoded(F.col("qualifiers")).alias("text")).distinct()
    return rows.select("text", decoded(F.col("text"))["object_direction_qualifier"].alias("direction"))


@on_graph("X18_readable_bytes", values("n, text", (0, "0.0 B"), (1536, "1.5 KB"), (5 << 20, "5.0 MB")))
def _(g):
    return table_of(g, [(n, readable_bytes(n)) for n in (0, 1536, 5 << 20)], "n int, text string")


@on_graph("X13_curies", values("term, curie", ("PART:1", True), ("biolink:Part", False), ("part one", False), ("rdfs:label", True)))
def _(g):
    return table_of(g, [(t, is_curie(t)) for t in ("PART:1", "biolink:Part", "part one", "rdfs:label")], "term string, curie boolean")


@on_graph("X15_names", "SELECT id, coalesce(name, id) AS name FROM n WHERE id IN ('NATION:1', 'REGION:2', 'BRAND:Brand#11') UNION ALL SELECT 'NONE:1', 'NONE:1'")
def _(g):
    return table_of(g, list(resolve.names(g, ["NATION:1", "REGION:2", "BRAND:Brand#11", "NONE:1"]).items()), "id string, name string")


@on_graph("X15_resolve_one", "SELECT 'europe' AS asked, id FROM n WHERE category = 'Region' AND lower(name) = 'europe'")
def _(g):
    return table_of(g, [("europe", resolve.resolve_one(g, "europe", "Region"))], "asked string, id string")


@on_graph("X16_path_text", "SELECT a.name || ' -[subclass_of]-> ' || b.name || ' <-[subclass_of]- ' || c.name AS path FROM n a, n b, n c WHERE a.id = 'NATION:0' AND c.id = 'NATION:5' AND b.id = 'REGION:0'")
def _(g):
    walked = [("NATION:0", "subclass_of", "REGION:0"), ("NATION:5", "subclass_of", "REGION:0")]
    return table_of(g, [(resolve.path_text(walked, resolve.names(g, ["NATION:0", "REGION:0", "NATION:5"])),)], "path string")


NATIONS = qgraph({"a": {"categories": ["biolink:Nation"]}, "b": {"ids": ["REGION:3"]}}, e=("a", ["biolink:subclass_of"], "b"))


@on_graph("T2_match", "SELECT subject AS a, object AS b, true AS truncated FROM t WHERE predicate = 'subclass_of' AND object = 'REGION:3' ORDER BY subject LIMIT 3")
def _(g):
    found = pattern.match(g, NATIONS, 3)
    return found.bindings.select(F.col("n_a").alias("a"), F.col("n_b").alias("b"), F.lit(found.truncated).alias("truncated"))


@on_graph("T1_message", "SELECT t.subject, n.name AS subject_name, 'biolink:' || predicate AS predicate, object FROM t JOIN n ON n.id = t.subject WHERE predicate = 'subclass_of' AND object = 'REGION:3'")
def _(g):
    graph = message.query(g, NATIONS)["message"]["knowledge_graph"]
    return table_of(g, [(e["subject"], graph["nodes"][e["subject"]]["name"], e["predicate"], e["object"]) for e in graph["edges"].values()], "subject string, subject_name string, predicate string, object string")


@on_graph("T13_rendered", "SELECT DISTINCT subject, 'biolink:knowledge_level=' || knowledge_level || ' biolink:agent_type=' || agent_type AS attributes FROM e WHERE predicate = 'located_in' AND object = 'NATION:7' AND split_part(subject, ':', 1) = 'CUST'")
def _(g):
    asked = qgraph({"a": {"categories": ["Customer"]}, "b": {"ids": ["NATION:7"]}}, e=("a", ["located_in"], "b"))
    shown = F.transform("attributes", lambda a: F.concat_ws("=", a["attribute_type_id"], a["value"]))
    return message.rendered_edges(g, asked).select("subject", F.concat_ws(" ", shown).alias("attributes")).distinct()


@on_graph("F20_default_predicate", values("predicate", ("biolink:related_to",)))
def _(g):
    return table_of(g, [(message.knowledge_edge(("A:1", None, "B:1"), None)["predicate"],)], "predicate string")


@on_graph("T14_drawing", values("line", ("(a biolink:Nation) --biolink:subclass_of--> (b REGION:3)",)))
def _(g):
    return table_of(g, [(line,) for line in message.drawing(NATIONS).split("\n")], "line string")


PATTERN = [["CUST:1", "places", "?order:Order"], ["?order", "contains", "?part"]]


@on_graph("T15_query_graph", values("subject, predicate, object", ("CUST:1", "biolink:places", "biolink:Order"), ("biolink:Order", "biolink:contains", "*")))
def _(g):
    graph, _ = dsl.to_query_graph(PATTERN)
    shown = {k: (n.get("ids") or n.get("categories") or ["*"])[0] for k, n in graph["nodes"].items()}
    return table_of(g, [(shown[e["subject"]], e["predicates"][0], shown[e["object"]]) for e in graph["edges"].values()], "subject string, predicate string, object string")


@on_graph("T16_run", "SELECT DISTINCT b.object AS part, n.name AS part_name FROM t a JOIN t b ON b.subject = a.object AND b.predicate = 'contains' JOIN n ON n.id = b.object WHERE a.subject = 'CUST:1' AND a.predicate = 'places' ORDER BY part LIMIT 25")
def _(g):
    rows = dsl.run(g, PATTERN, ["?part"], name_lookup=True, node_subclassing=False)["rows"]
    return table_of(g, [(r["part"], r["part_name"]) for r in rows], "part string, part_name string")


@on_graph("T17_terms", values("term", ("biolink:contains",), ("biolink:places",), ("R",)))
def _(g):
    graph, _ = dsl.to_query_graph([*PATTERN, ["SUPP:1", {"predicate": "places", "direction": "R"}, "?part"]])
    return table_of(g, [(t,) for terms in dsl.query_terms(graph) for t in terms], "term string")


@on_graph("T18_errors", values("place", ("triple 0",), ("triple 1 subject",), ("triple 0 predicate",)))
def _(g):
    found = []
    for wrong in ([["A:1", "p"]], [["A:1", "p", "B:1"], ["a name", "p", "B:1"]], [["A:1", {"colour": 1}, "B:1"]]):
        try:
            dsl.to_query_graph(wrong)
        except dsl.PatternError as e:
            found.append((str(e).partition(":")[0],))
    return table_of(g, found, "place string")


@on_graph("F19_validation", values("error", ("query_graph must be an object",), ("query_graph.nodes must be an object",), ("edge 'e' is missing 'subject'",), ("edge 'e' subject 'x' is not a node in the query graph",)))
def _(g):
    found = []
    for wrong in (None, {"nodes": []}, {"nodes": {}, "edges": {"e": {}}}, {"nodes": {}, "edges": {"e": {"subject": "x", "object": "y"}}}):
        try:
            pattern.validated(wrong)
        except ValueError as e:
            found.append((str(e),))
    return table_of(g, found, "error string")


@on_graph("A4_schema", "SELECT 'predicate' AS kind, 'biolink:' || predicate AS term, count(*) AS n FROM e GROUP BY predicate UNION ALL SELECT 'category', 'biolink:' || category, count(DISTINCT id) FROM n GROUP BY category")
def _(g):
    found = service.describe_schema(g)
    return table_of(g, [(kind, term, n) for kind, key in (("predicate", "predicates"), ("category", "categories")) for term, n in found[key].items()], "kind string, term string, n long")


@on_graph("SV1_status", values("status", (200,), (400,), (503,)))
def _(g):
    asked = {"message": {"query_graph": NATIONS}, "limit": 5}
    return table_of(g, [(service.handle(*x)[0],) for x in ((g, asked), (g, {}), (None, asked))], "status int")


@on_graph("SV1_routes", values("request, status", ("GET /health", 200), ("GET /version", 200), ("GET /nothing", 404), ("POST /query", 200), ("POST /query?summary", 200)))
def _(g):
    body = json.dumps({"message": {"query_graph": NATIONS}, "limit": 2}).encode()
    return table_of(g, [(r, service.route(g, *r.split(" "), body)[0]) for r in ("GET /health", "GET /version", "GET /nothing", "POST /query", "POST /query?summary")], "request string, status int")


@on_graph("SV5_cached_loader", values("same", (True,)))
def _(g):
    path = f"{shared_dir(g.spark)}/graph-{uuid.uuid4().hex}"
    from_triples(g.spark, [("A:1", "p", "B:1")]).save(path)
    return table_of(g, [(service.loaded(g.spark, path) is service.loaded(g.spark, path),)], "same boolean")


@on_graph("SV2_connect", "SELECT 'NATION:9 -[subclass_of]-> ' || object AS path FROM t WHERE subject = 'NATION:9' AND predicate = 'subclass_of'")
def _(g):
    region = next(r for r in service.list_neighbors(g, "NATION:9", "subclass_of")["neighbors"])
    return table_of(g, [(p,) for p in service.connect_entities(g, "NATION:9", region)["paths"]], "path string")


@on_graph("SV3_errors", values("tool, failed", ("neighbors", True), ("resolve", False), ("query", True)))
def _(g):
    said = {"neighbors": service.list_neighbors(g, "NONE:1"), "resolve": service.resolve_entity(g, "asia"), "query": service.graph_query(g, [["?a", "p", "?b"]])}
    return table_of(g, [(k, "error" in v) for k, v in said.items()], "tool string, failed boolean")


@on_graph("SV8_association_report", "AND d AS (SELECT DISTINCT t.object FROM t JOIN n ON n.id = t.object AND n.category = 'Nation' WHERE subject = 'NATION:2') SELECT 'direct' AS kind, object AS id FROM d UNION SELECT 'two hops', b.object FROM t a JOIN t b ON b.subject = a.object JOIN n ON n.id = b.object AND n.category = 'Nation' WHERE a.subject = 'NATION:2' AND b.object NOT IN (SELECT object FROM d)")
def _(g):
    found = report.association_report(g, "NATION:2", "Nation")
    return table_of(g, [("direct", r["id"]) for r in found["direct"]] + [("two hops", r["id"]) for r in found["two_hop"]], "kind string, id string").distinct()


@on_graph("S22_audit_page", values("predicate", ("derives_from",), ("interacts_with",), ("part_of",), ("regulates",)))
def _(g):
    found = report.audit_report(g)
    page = report.audit_html(found)
    return table_of(g, [(r["predicate"],) for r in found if r["predicate"] in page], "predicate string")


# Sources


@on_graph("S6_from_triples", "SELECT count(*) AS records, count(DISTINCT object) AS regions FROM t WHERE predicate = 'subclass_of' AND split_part(object, ':', 1) = 'REGION'")
def _(g):
    rows = g.triples.where("predicate = 'subclass_of' AND startswith(object, 'REGION:')").collect()  # 25 nations
    small = from_triples(g.spark, [tuple(r) for r in rows])
    return small.edges.agg(F.count("*").alias("records"), F.count_distinct("object").alias("regions"))


@on_graph("S7_saved_graph", "SELECT predicate, count(*) AS records FROM e GROUP BY predicate")
def _(g):
    path = f"{shared_dir(g.spark)}/graph-{uuid.uuid4().hex}"
    g.save(path)
    return aggregates.predicate_counts(GraphStore.load(g.spark, path))


def small_archive(g: GraphStore) -> str:
    """The nations and regions as an archive in the shared folder."""
    wanted = g.nodes.where("array_contains(category, 'Nation') OR array_contains(category, 'Region')").collect()
    edges = g.triples.where("predicate = 'subclass_of' AND startswith(object, 'REGION:')").collect()
    members = {"nodes.jsonl": [{"id": r.id, "name": r.name, "category": r.category} for r in wanted], "edges.jsonl": [r.asDict() for r in edges]}
    path = f"{shared_dir(g.spark)}/archive-{uuid.uuid4().hex}.tar.gz"
    fs, at = FileSystem.from_uri(path)
    with fs.open_output_stream(at, compression=None) as out, tarfile.open(fileobj=out, mode="w|gz") as tar:
        for name, rows in members.items():
            raw = "\n".join(map(json.dumps, rows)).encode()
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            tar.addfile(info, io.BytesIO(raw))
    return path


@on_graph("S8_held_graph", "SELECT predicate, count(*) AS records FROM e WHERE predicate IN ('located_in', 'subclass_of') GROUP BY predicate")
def _(g):
    small = GraphStore(g.nodes, g.edges.where("predicate IN ('located_in', 'subclass_of')")).hold()
    return aggregates.predicate_counts(small)


@on_graph("S9_sizes", values("name, known", ("nodes", True), ("edges", True)))
def _(g):
    return table_of(g, [(name, n > 0) for name, n in g.bytes_by_table().items()], "name string, known boolean")


@on_graph("S1_archive", "SELECT 'edge' AS kind, count(*) AS records FROM nation UNION ALL SELECT 'node', (SELECT count(*) FROM nation) + (SELECT count(*) FROM region)")
def _(g):
    store = archive.load(g.spark, small_archive(g))
    return store.edges.select(F.lit("edge").alias("kind")).unionByName(store.nodes.select(F.lit("node").alias("kind"))).groupBy("kind").agg(F.count("*").alias("records"))


@on_graph("S4_archive_predicates", "SELECT count(*) AS edges, 0 AS others FROM nation")
def _(g):
    rows = archive.read_once(g.spark, small_archive(g))
    kept = archive.graph_of(rows, "archive", predicates=["biolink:subclass_of"])
    return kept.edges.agg(F.count("*").alias("edges"), F.count_if(F.col("predicate") != "subclass_of").alias("others"))


@on_graph("S16_release", "SELECT count(*) AS records, count(*) AS triples, count(*) + (SELECT count(*) FROM region) AS nodes, true AS same_digest FROM nation")
def _(g):
    target = f"{shared_dir(g.spark)}/release-{uuid.uuid4().hex}"
    made = release.build(g.spark, small_archive(g), target)
    same = release.tree_digest(g.spark, f"{target}/edges") == made["artifacts"]["edges"]
    return table_of(g, [(made["source_record_count"], made["edge_count"], made["node_count"], same)], "records long, triples long, nodes long, same_digest boolean")


@on_graph("S20_format_gate", values("refused", (True,)))
def _(g):
    path = f"{shared_dir(g.spark)}/graph-{uuid.uuid4().hex}"
    g.spark.createDataFrame([('{"store_format_version": 1}',)], "value string").write.text(f"{path}/manifest")
    try:
        GraphStore.load(g.spark, path)
    except ValueError:
        return table_of(g, [(True,)], "refused boolean")
    return table_of(g, [(False,)], "refused boolean")


def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and hour, as a stream that is read to its end."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.drained(ingest.counted(events, "event_type", "ts")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "records")


QUERIES["ST1_windowed_counts"] = windowed
ORACLE_SQL["ST1_windowed_counts"] = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS records FROM events GROUP BY 1, 2"
