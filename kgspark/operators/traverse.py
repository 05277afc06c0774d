"""Edges as joins: hops, neighbours and fixed-length patterns.

A pattern is node, edge, node, ... Node and edge terms are None (any), a string, a collection (any of it), or a dict: nodes by
id or ids, category or categories; edges by predicate or predicates, knowledge_level, agent_type and any qualifier or other field.
Where an end is pinned to ids, the nodes that a walk can be at are listed hop by hop, as long as they are FRONTIER at most, so a hop
reads its edges through a short list before anything is shuffled; other hops join the distinct triples of their predicates on
the end at hand, and Catalyst chooses how.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions.terms import HIERARCHY, bare, full_column, is_symmetric
from kgspark.operators.metadata import EDGE_CORE, field_is
from kgspark.sources.folders import written
from kgspark.sources.store import GraphStore

#: What a place of a pattern may be: one name, several, or fields with their values; None is anything.
type Term = str | Collection[str] | Mapping[str, object] | None
#: Nodes that are sent to all tasks as a list at most, and those of them that become part of the filter itself.
FRONTIER, LITERALS = 10_000, 200


@dataclass
class MatchStats:
    """Whether rows were cut off, at which hops, and how many rows each hop had where it was counted."""

    truncated: bool = False
    truncated_hops: list[int] = field(default_factory=list)
    frontier_sizes: list[int] = field(default_factory=list)
    hop_caps: list[int | None] = field(default_factory=list)


def as_list(value: object) -> list:
    return [] if value is None else [value] if isinstance(value, str) else list(value)


def descendants(store: GraphStore, ids: list[str], max_depth: int | None = None) -> DataFrame:
    """root, id, depth of the ids and all below them by hierarchy edges (child to parent); 0 is the ids alone.

    Breadth first, each id once for a root, so cycles end; max_depth None goes on until nothing new is found.
    """
    spark = store.spark
    below = store.edges.where(F.col("predicate").isin(*HIERARCHY)).select(F.col("subject").alias("child"), F.col("object").alias("id")).distinct()
    seen = spark.createDataFrame([(i, i, 0) for i in dict.fromkeys(ids)], "root string, id string, depth int")
    last, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = last.join(below, "id").select("root", F.col("child").alias("id"), F.lit(depth).alias("depth")).distinct().join(seen.select("root", "id"), ["root", "id"], "left_anti")
        new = cut(new)
        if new.isEmpty():
            break
        seen, last = cut(seen.unionByName(new)), new
    return seen


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage ended: a table in the shared folder, computed once."""
    return written(df, "lineage")


def listed(ids: DataFrame) -> list[str] | None:
    """The ids, if they are FRONTIER at most; no more than one over that is ever collected."""
    rows = ids.limit(FRONTIER + 1).collect()
    return [r[0] for r in rows] if len(rows) <= FRONTIER else None


def among(rows: DataFrame, column: str, ids: list[str] | None) -> DataFrame:
    """The rows whose column is one of a short list; all where there is none."""
    if ids is None:
        return rows
    if len(ids) <= LITERALS:
        return rows.where(F.col(column).isin(ids))
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame([(i,) for i in ids], f"`{column}` string")), column, "left_semi")


def term_ids(store: GraphStore, term: Term, subclassing: bool = False, depth: int | None = None) -> DataFrame | None:
    """The ids (column id) that a node term allows; None where it allows all."""
    if term is None or term == {}:
        return None
    spec = {"ids": as_list(term)} if not isinstance(term, dict) else {"ids": as_list(term.get("ids", term.get("id"))), "categories": as_list(term.get("categories", term.get("category")))}
    out = None
    if spec["ids"]:
        out = descendants(store, spec["ids"], depth).select("id").distinct() if subclassing else store.spark.createDataFrame([(i,) for i in dict.fromkeys(spec["ids"])], "id string")
    if spec.get("categories"):
        members = store.nodes.where(F.arrays_overlap("category", F.array(*[F.lit(bare(c)) for c in spec["categories"]]))).select("id").distinct()
        out = members if out is None else out.join(members, "id", "left_semi")
    return out


def small(ids: DataFrame, term: Term, subclassing: bool = False) -> DataFrame:
    """A list that the caller spelled out is sent to all tasks; anything that grows with the graph is left to the planner."""
    grows = subclassing or isinstance(term, dict) and bool(as_list(term.get("categories", term.get("category"))))
    return ids if grows else F.broadcast(ids)


def term_records(store: GraphStore, term: Term) -> DataFrame:
    """subject, predicate, object of the records that an edge term allows; an empty collection allows all."""
    rows, predicates = store.edges, as_list(term.get("predicates", term.get("predicate")) if isinstance(term, dict) else term)
    if isinstance(term, dict):
        for name, value in term.items():
            if name not in ("predicate", "predicates"):
                rows = rows.where(field_is(name, value, EDGE_CORE))
    if predicates:
        rows = rows.where(F.col("predicate").isin([bare(p) for p in predicates]))
    return rows.select("subject", "predicate", "object")


def hop(store: GraphStore, term: Term, forward: bool = True, both_if_symmetric: bool = False, here: list[str] | None = None, there: list[str] | None = None) -> DataFrame:
    """here, there, subject, predicate, object: steps from one end to the other; a step both ways round is kept as it is stored once.

    here, there: short lists of the nodes at either end, which are looked at before repeats are removed.
    """
    ends = ("subject", "object") if forward else ("object", "subject")

    def walked(rows: DataFrame, one: str, other: str) -> DataFrame:
        steps = rows.select(F.col(one).alias("here"), F.col(other).alias("there"), "subject", "predicate", "object")
        return among(among(steps, "here", here), "there", there)

    rows = term_records(store, term)
    steps = walked(rows, *ends)
    if not both_if_symmetric:
        return steps.select("here", "there", "subject", "predicate", "object").distinct()
    back = walked(rows.where(is_symmetric(F.col("predicate"))), *reversed(ends))
    ranked = steps.withColumn("rank", F.lit(0)).unionByName(back.withColumn("rank", F.lit(1)))
    return ranked.groupBy("here", "there", "predicate").agg(F.min(F.struct("rank", "subject", "object")).alias("m")).select("here", "there", "m.subject", "predicate", "m.object")


def neighbors(store: GraphStore, node: str, relation: str | None = None, node_subclassing: bool = False) -> DataFrame:
    """Distinct ends (id) of edges that start at the node or, with subclassing, at any below it. An unknown node is a ValueError."""
    starts = descendants(store, [node]).select(F.col("id").alias("subject")).distinct() if node_subclassing else store.spark.createDataFrame([(node,)], "subject string")
    rows = store.edges if relation is None else store.edges.where(F.col("predicate") == bare(relation))
    found = rows.join(F.broadcast(starts) if not node_subclassing else starts, "subject", "left_semi").select(F.col("object").alias("id"))
    if found.isEmpty() and store.edges.where((F.col("subject") == node) | (F.col("object") == node)).isEmpty():
        raise ValueError(f"{node} is not in the graph")
    return found.distinct()


def pinned(term: Term) -> bool:
    return bool(as_list(term.get("ids", term.get("id"))) if isinstance(term, dict) else as_list(term))


def place_lists(store: GraphStore, nodes: list[Term], edges: list[Term], ways: list[bool], symmetric: bool, allowed: list[DataFrame | None]) -> list[list[str] | None]:
    """For each place of a pattern, the nodes that it can be, seen from pinned ends: forward from the start, then backward from the end.

    None where nothing pins the place or the nodes are too many; a walk goes on from there by joins.
    """
    places: list[list[str] | None] = [listed(a) if a is not None and pinned(n) else None for a, n in zip(allowed, nodes, strict=True)]

    def narrow(k: int, step: DataFrame, end: str) -> None:
        ids = step.select(F.col(end).alias("id")).distinct()
        if allowed[k] is not None and places[k] is None:
            ids = ids.join(allowed[k], "id", "left_semi")
        got = listed(ids)
        places[k] = got if got is not None else places[k]

    last = len(edges)
    if places[0] is not None:
        for k in range(last - 1 if places[last] is None else last):
            if places[k] is None:
                break
            narrow(k + 1, hop(store, edges[k], ways[k], symmetric, places[k], places[k + 1]), "there")
    if places[last] is not None:
        for k in range(last - 1, 0, -1):
            if places[k + 1] is None:
                break
            narrow(k, hop(store, edges[k], ways[k], symmetric, places[k], places[k + 1]), "here")
    return places


def match_path(
    store: GraphStore, pattern: list, limit: int | None = 100, node_subclassing: bool = False, subclass_depth: int | None = None, hop_directions: list[bool] | None = None,
    symmetric: bool = False, prune: bool = True, stats: MatchStats | None = None, hop_cap: int | None = None,
) -> DataFrame:
    """Walks n0, p0, s0, o0, n1, ... that fit a pattern; nodes may repeat. sK and oK are edge K's ends as stored.

    A limited result is ordered by all its columns, so it is the same on every run; stats learn whether more rows were there.
    hop_cap: so many walks at most go on from each hop but the last, the first in order; stats name the hops where there were more.
    """
    if len(pattern) < 3 or len(pattern) % 2 == 0:
        raise ValueError("a pattern is node, edge, node, ... with an odd length of 3 or more")
    nodes, edges = pattern[::2], pattern[1::2]
    ways = hop_directions if hop_directions is not None else [True] * len(edges)
    if len(ways) != len(edges):
        raise ValueError(f"{len(ways)} directions for {len(edges)} hops")
    if nodes[0] is None and limit is not None and len(edges) == 1 and edges[0] is None:
        raise ValueError("the start of a pattern is open and nothing else narrows it")
    allowed = [term_ids(store, n, node_subclassing, subclass_depth) for n in nodes]
    places = place_lists(store, nodes, edges, ways, symmetric, allowed) if prune else [None] * len(nodes)
    rows, own = None, MatchStats()
    for k, (edge, way) in enumerate(zip(edges, ways, strict=True)):
        step = hop(store, edge, way, symmetric, places[k], places[k + 1])
        if allowed[k + 1] is not None and places[k + 1] is None:
            step = step.join(small(allowed[k + 1], nodes[k + 1], node_subclassing).withColumnRenamed("id", "there"), "there", "left_semi")
        named = step.select(F.col("here").alias(f"n{k}"), F.col("predicate").alias(f"p{k}"), F.col("subject").alias(f"s{k}"), F.col("object").alias(f"o{k}"), F.col("there").alias(f"n{k + 1}"))
        if k == 0:
            rows = named if allowed[0] is None or places[0] is not None else named.join(small(allowed[0], nodes[0], node_subclassing).withColumnRenamed("id", "n0"), "n0", "left_semi")
        else:
            rows = rows.join(named, f"n{k}")
        if hop_cap is not None and k < len(edges) - 1:
            rows = limited(rows.select(*sorted(rows.columns)), hop_cap, own, k)
    rows = rows.select(*[c for k in range(len(edges)) for c in (f"n{k}", f"p{k}", f"s{k}", f"o{k}")], f"n{len(edges)}")
    out = limited(rows, limit, own if stats is not None else None, len(edges) - 1)
    if stats is not None:
        stats.__dict__.update(own.__dict__)
    return out


def limited(rows: DataFrame, limit: int | None, stats: MatchStats | None = None, hop_number: int = 0) -> DataFrame:
    """The first `limit` rows in the order of all columns. With stats they are read once, with one more, and kept as a list."""
    if limit is None:
        return rows
    ordered = rows.orderBy(*rows.columns)
    if stats is None:
        return ordered.limit(limit)
    got = ordered.limit(limit + 1).collect()
    stats.frontier_sizes.append(min(len(got), limit))
    stats.hop_caps.append(limit)
    if len(got) > limit:
        stats.truncated = True
        stats.truncated_hops.append(hop_number)
    return rows.sparkSession.createDataFrame(got[:limit], rows.schema)


def associations(store: GraphStore, source: str, target_category: str, max_hops: int = 1, limit: int | None = 1000, node_subclassing: bool = True) -> DataFrame:
    """Walks of exactly max_hops hops from the source to nodes of a category."""
    if max_hops < 1:
        raise ValueError("max_hops must be 1 or more")
    pattern: list = [source]
    for k in range(max_hops):
        pattern += [None, {"category": target_category} if k == max_hops - 1 else None]
    return match_path(store, pattern, limit, node_subclassing)


def prefixed(rows: DataFrame) -> DataFrame:
    """The same rows with the model's prefix on predicates."""
    return rows.withColumns({c: full_column(F.col(c)) for c in rows.columns if c[0] == "p" and c[1:].isdigit()})
