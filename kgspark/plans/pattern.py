"""Query graphs as one tree of joins.

A query graph has nodes (ids, categories, constraints) and edges (subject, object, predicates, attribute_constraints, qualifier_constraints).
Every shape is compiled alike: edges are ordered so that each joins what is bound already, most selective first; a node's ids and categories
become semi-joins on the edge tables before they are joined; an edge between bound nodes joins on both ends. Constraints come before any limit.
Bindings are homomorphisms: nodes may coincide. Of a symmetric predicate both directions fit, and ends are kept as stored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.terms import QUALIFIERS, SYMMETRIC, attribute_test, bare, is_symmetric
from kgspark.operators.traverse import MatchStats, as_list, descendants, limited
from kgspark.plans.expand import expand_query_graph
from kgspark.sources.store import GraphStore, variants


@dataclass
class QNode:
    key: str
    ids: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    constraints: list[dict] = field(default_factory=list)


@dataclass
class QEdge:
    key: str
    subject: str
    object: str
    predicates: list[str] = field(default_factory=list)
    attributes: list[dict] = field(default_factory=list)
    qualifiers: list[list[dict]] = field(default_factory=list)


def validated(query_graph: dict) -> tuple[dict[str, QNode], list[QEdge]]:
    """The graph's nodes and edges; a ValueError says what is wrong with its shape."""
    if not isinstance(query_graph, dict):
        raise ValueError("query_graph must be an object")
    nodes, edges = query_graph.get("nodes"), query_graph.get("edges")
    if not isinstance(nodes, dict):
        raise ValueError("query_graph.nodes must be an object")
    if not isinstance(edges, dict):
        raise ValueError("query_graph uses 'paths' (Pathfinder); only 'edges' is supported" if "paths" in query_graph else "query_graph.edges must be an object")
    qnodes = {k: QNode(k, as_list((n or {}).get("ids")), [bare(c) for c in as_list((n or {}).get("categories"))], list((n or {}).get("constraints") or [])) for k, n in nodes.items()}
    qedges = []
    for k, e in edges.items():
        if not isinstance(e, dict):
            raise ValueError(f"edge {k!r} must be an object")
        for end in ("subject", "object"):
            if e.get(end) is None:
                raise ValueError(f"edge {k!r} is missing {end!r}")
            if e[end] not in nodes:
                raise ValueError(f"edge {k!r} {end} {e[end]!r} is not a node in the query graph")
        sets = [list(c.get("qualifier_set") or []) for c in e.get("qualifier_constraints") or []]
        qedges.append(QEdge(k, e["subject"], e["object"], [bare(p) for p in as_list(e.get("predicates"))], list(e.get("attribute_constraints") or []), sets))
    return qnodes, qedges


def node_constraint(constraint: dict) -> Column:
    name = constraint["id"].replace("biolink:", "")
    single = F.col(name) if name in ("id", "name") else F.array_join("category", " ") if name == "category" else F.get_json_object("extra", f"$['{name}']")
    several = F.col("category") if name == "category" else F.from_json(single, "array<string>") if name != "id" and name != "name" else None
    return attribute_test(single, several, constraint.get("operator", "=="), constraint.get("value"), bool(constraint.get("not")))


def edge_constraint(constraint: dict) -> Column:
    name = constraint["id"].replace("biolink:", "")
    if name in ("knowledge_level", "agent_type", "subject", "predicate", "object"):
        single, several = F.col(name), None
    else:
        single = F.coalesce(F.try_element_at("qualifiers", F.lit(name)), F.get_json_object("extra", f"$['{name}']"))
        several = F.from_json(single, "array<string>")
    return attribute_test(single, several, constraint.get("operator", "=="), constraint.get("value"), bool(constraint.get("not")))


def qualifier_test(sets: list[list[dict]]) -> Column:
    """Any of the sets, of which all must hold on one record; an unknown qualifier never holds, an empty set always."""
    def one(q: dict) -> Column:
        name = bare(q.get("qualifier_type_id", ""))
        return F.coalesce(F.try_element_at("qualifiers", F.lit(name)) == str(q.get("qualifier_value")), F.lit(False)) if name in QUALIFIERS else F.lit(False)

    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, map(one, s), F.lit(True)) for s in sets])


def edge_table(store: GraphStore, e: QEdge) -> DataFrame:
    """Distinct from, to, subject, predicate, object of the records that fit an edge; symmetric predicates both ways round."""
    rows = store.edges
    if e.predicates:
        rows = rows.where(F.col("predicate").isin(e.predicates))
    if e.qualifiers:
        rows = rows.where(qualifier_test(e.qualifiers))  # all records of a variant have the same qualifiers, so this may come before it is chosen
    if e.attributes:
        rows = variants(rows)  # one record must satisfy all constraints together
        for c in e.attributes:
            rows = rows.where(edge_constraint(c))
    rows = rows.select("subject", "predicate", "object").distinct()
    ahead = rows.select(F.col("subject").alias("from"), F.col("object").alias("to"), "subject", "predicate", "object")
    if not SYMMETRIC.intersection(e.predicates):
        return ahead  # an open edge, too, is read as it is stored
    back = rows.where(is_symmetric(F.col("predicate"))).select(F.col("object").alias("from"), F.col("subject").alias("to"), "subject", "predicate", "object")
    ranked = ahead.withColumn("rank", F.lit(0)).unionByName(back.withColumn("rank", F.lit(1)))
    return ranked.groupBy("from", "to", "predicate").agg(F.min(F.struct("rank", "subject", "object")).alias("m")).select("from", "to", "m.subject", "predicate", "m.object")


def node_table(store: GraphStore, n: QNode, subclassing: bool, depth: int | None) -> DataFrame | None:
    """id, query_id of the nodes that fit; query_id is the asked-for id that an expanded node stands for. None where all fit.

    Asked-for ids are not held against the categories, nodes that only the hierarchy brought in are.
    """
    asked = None
    if n.ids:
        rows = descendants(store, n.ids, depth if subclassing else 0)
        order = F.array_position(F.array(*map(F.lit, n.ids)), F.col("root"))
        asked = rows.groupBy("id").agg(F.min(F.struct("depth", order.alias("k"), "root")).alias("m")).select("id", F.when(F.col("m.depth") > 0, F.col("m.root")).alias("query_id"))
    if n.categories:
        members = store.nodes.where(F.arrays_overlap("category", F.array(*map(F.lit, n.categories)))).select("id").distinct()
        if asked is None:
            asked = members.withColumn("query_id", F.lit(None).cast("string"))
        else:
            fits = members.withColumn("member", F.lit(True))
            asked = asked.join(fits, "id", "left").where("query_id IS NULL OR member").drop("member")
    if n.constraints:
        rows = store.nodes.where(reduce(lambda a, b: a & b, map(node_constraint, n.constraints))).select("id").distinct()
        asked = rows.withColumn("query_id", F.lit(None).cast("string")) if asked is None else asked.join(rows, "id", "left_semi")
    return asked


def order_edges(nodes: dict[str, QNode], edges: list[QEdge], counts: dict[str, int] | None = None) -> list[QEdge]:
    """Greedy: edges with most ends bound, then with pinned ends, then with ends of a category, then with the fewest records first."""
    left, bound, out = list(edges), set(), []

    def cost(e: QEdge) -> tuple:
        ends = {e.subject, e.object}
        records = sum((counts or {}).get(p, 0) for p in e.predicates) if e.predicates else sum((counts or {"": 1}).values())
        return (-len(ends & bound) if out else 0, -sum(bool(nodes[x].ids) for x in ends), -sum(bool(nodes[x].categories) for x in ends), records)

    while left:
        best = min(left, key=cost)
        left.remove(best)
        out.append(best)
        bound |= {best.subject, best.object}
    return out


def bindings(store: GraphStore, query_graph: dict, node_subclassing: bool = True, subclass_depth: int | None = 1, counts: dict[str, int] | None = None, collapse_predicates: bool = False) -> DataFrame:
    """n_<key> and q_<key> (the id it stands for, null if itself) of every node, s_<key>, p_<key>, o_<key> of every edge, as stored.

    collapse_predicates: one row for each choice of nodes, with the first predicate of each edge.
    """
    nodes, edges = validated(query_graph)
    if not edges:
        raise ValueError("the query graph has no edges")
    allowed = {k: node_table(store, n, node_subclassing, subclass_depth) for k, n in nodes.items()}
    rows, bound = None, set()
    for e in order_edges(nodes, edges, counts):
        table = edge_table(store, e).select(F.col("from").alias(f"n_{e.subject}"), F.col("to").alias(f"n_{e.object}" if e.subject != e.object else "__loop"), F.col("subject").alias(f"s_{e.key}"), F.col("predicate").alias(f"p_{e.key}"), F.col("object").alias(f"o_{e.key}"))
        if e.subject == e.object:
            table = table.where(F.col(f"n_{e.subject}") == F.col("__loop")).drop("__loop")
        for k in dict.fromkeys((e.subject, e.object)):
            if allowed[k] is not None and k not in bound:
                table = table.join(allowed[k].select(F.col("id").alias(f"n_{k}")), f"n_{k}", "left_semi")
        shared = [f"n_{k}" for k in dict.fromkeys((e.subject, e.object)) if k in bound]
        if rows is None:
            rows = table
        elif shared:
            rows = rows.join(table, shared)
        else:
            raise ValueError(f"edge {e.key!r} is not connected with the rest of the query graph")
        bound |= {e.subject, e.object}
    for k, n in nodes.items():
        if k not in bound:
            raise ValueError(f"node {k!r} has no edge")
        if n.ids and node_subclassing:
            rows = rows.join(allowed[k].select(F.col("id").alias(f"n_{k}"), F.col("query_id").alias(f"q_{k}")), f"n_{k}")
        else:
            rows = rows.withColumn(f"q_{k}", F.lit(None).cast("string"))
    own = [c for k in nodes for c in (f"n_{k}", f"q_{k}")]
    ends = {e.key: [f"{x}_{e.key}" for x in "pso"] for e in edges}
    if collapse_predicates:
        rows = rows.groupBy(*own).agg(*[F.min(F.struct(*c)).alias(f"__{k}") for k, c in ends.items()])
        return rows.select(*own, *[F.col(f"__{k}.{c}") for k, names in ends.items() for c in names])
    return rows.select(*own, *[c for names in ends.values() for c in names])


@dataclass
class MatchResult:
    bindings: DataFrame
    truncated: bool
    query_graph: dict


def match(store: GraphStore, query_graph: dict, limit: int | None = 1000, node_subclassing: bool = True, subclass_depth: int | None = 1, expander=None, collapse_predicates: bool = False) -> MatchResult:
    """The bindings in order, at most `limit`; truncated says whether there are more."""
    asked = expand_query_graph(query_graph, expander) if expander else query_graph
    stats = MatchStats()
    return MatchResult(limited(bindings(store, asked, node_subclassing, subclass_depth, collapse_predicates=collapse_predicates), limit, stats), stats.truncated, asked)
