"""Paths of open length, and connected components: loops of joins whose lineage ends at each turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions.terms import bare
from kgspark.operators.traverse import among, cut, descendants, listed
from kgspark.sources.store import GraphStore


def _ends(store: GraphStore, source: str, target: str, subclassing: bool) -> tuple[DataFrame, DataFrame]:
    if subclassing:
        return tuple(descendants(store, [x]).select("id").distinct() for x in (source, target))
    return tuple(store.spark.createDataFrame([(x,)], "id string") for x in (source, target))


def all_shortest_paths(store: GraphStore, source: str, target: str, relation: str | None = None, node_subclassing: bool = False, max_depth: int | None = None) -> DataFrame:
    """path: arrays of subject, predicate, object, all of the least length; one empty path where source and target are one.

    A level reads only edges that start at its nodes, through a list where they are few; of a pair, the first predicate in order of arrival stands.
    """
    shape = "array<struct<subject:string,predicate:string,object:string>>"
    if source == target:
        return store.spark.createDataFrame([([],)], f"path {shape}")
    starts, targets = _ends(store, source, target, node_subclassing)
    records = store.edges if relation is None else store.edges.where(F.col("predicate") == bare(relation))
    seen, frontier, layers = starts, starts, []
    while max_depth is None or len(layers) < max_depth:
        few = listed(frontier)
        rows = among(records, "subject", few) if few is not None else records.join(frontier.withColumnRenamed("id", "subject"), "subject", "left_semi")
        rows = rows.join(seen.withColumnRenamed("id", "object"), "object", "left_anti")
        layer = cut(rows.groupBy("subject", "object").agg(F.min_by("predicate", F.struct("seq", "predicate")).alias("predicate")).select("subject", "predicate", "object"))
        if layer.isEmpty():
            return store.spark.createDataFrame([], f"path {shape}")
        layers.append(layer)
        frontier = cut(layer.select(F.col("object").alias("id")).distinct())
        if not frontier.join(targets, "id", "left_semi").isEmpty():
            break
        seen = seen.unionByName(frontier)
    else:
        return store.spark.createDataFrame([], f"path {shape}")
    edge = F.array(F.struct("subject", "predicate", "object"))
    rows = layers[-1].join(targets.withColumnRenamed("id", "object"), "object", "left_semi").select(F.col("subject").alias("at"), edge.alias("path"))
    for layer in reversed(layers[:-1]):
        before = layer.select(F.col("object").alias("at"), F.col("subject").alias("next"), edge.alias("first"))
        rows = rows.join(before, "at").select(F.col("next").alias("at"), F.concat("first", "path").alias("path"))
    return rows.select("path")


def shortest_path(store: GraphStore, source: str, target: str, relation: str | None = None, node_subclassing: bool = False) -> list[tuple] | None:
    """The first of the shortest paths in order; None where there is none."""
    row = all_shortest_paths(store, source, target, relation, node_subclassing).orderBy("path").first()
    return None if row is None else [tuple(e) for e in row.path]


def all_paths(store: GraphStore, source: str, target: str, relation: str | None = None, max_depth: int | None = 5, node_subclassing: bool = False) -> DataFrame:
    """path: all simple paths as arrays of subject, predicate, object; a path ends at the first target it meets."""
    shape = "array<struct<subject:string,predicate:string,object:string>>"
    if source == target:
        return store.spark.createDataFrame([([],)], f"path {shape}")
    starts, targets = _ends(store, source, target, node_subclassing)
    steps = store.triples if relation is None else store.triples.where(F.col("predicate") == bare(relation))
    there = targets.select(F.col("id").alias("at"), F.lit(True).alias("end"))
    rows = starts.select(F.col("id").alias("at"), F.array("id").alias("visited"), F.array().cast(shape).alias("path"))
    found, depth = None, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        grown = rows.join(steps.withColumnRenamed("subject", "at"), "at").where(~F.array_contains("visited", F.col("object")))
        grown = grown.select(F.col("object").alias("at"), F.concat("visited", F.array("object")).alias("visited"), F.concat("path", F.array(F.struct(F.col("at").alias("subject"), "predicate", "object"))).alias("path"))
        grown = cut(grown.join(there, "at", "left"))
        done = grown.where("end").select("path")
        found = done if found is None else found.unionByName(done)
        rows = grown.where("end IS NULL").drop("end")
        if rows.isEmpty():
            break
    return found if found is not None else store.spark.createDataFrame([], f"path {shape}")


def paths_by_predicates(store: GraphStore, source: str, target: str, predicates: list[str], node_subclassing: bool = False) -> DataFrame:
    """n0 ... nK of simple paths whose predicates are these, in order; one chain of joins."""
    starts, targets = _ends(store, source, target, node_subclassing)
    rows = starts.withColumnRenamed("id", "n0")
    for k, p in enumerate(predicates):
        step = store.triples.where(F.col("predicate") == bare(p)).select(F.col("subject").alias(f"n{k}"), F.col("object").alias(f"n{k + 1}"))
        rows = rows.join(step, f"n{k}")
        for j in range(k + 1):
            rows = rows.where(F.col(f"n{j}") != F.col(f"n{k + 1}"))
    last = f"n{len(predicates)}"
    return rows.join(targets.withColumnRenamed("id", last), last, "left_semi").select(*[f"n{k}" for k in range(len(predicates) + 1)])


def reachable(store: GraphStore, source: str, relation: str | None = None, max_depth: int | None = None) -> DataFrame:
    """id, depth: breadth-first levels from a node."""
    steps = store.pairs if relation is None else store.triples.where(F.col("predicate") == bare(relation)).select("subject", "object")
    seen = store.spark.createDataFrame([(source, 0)], "id string, depth int")
    last, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = cut(last.select(F.col("id").alias("subject")).join(steps, "subject").select(F.col("object").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        seen, last = cut(seen.unionByName(new)), new
    return seen


def components(store: GraphStore, relation: str | None = None) -> DataFrame:
    """id, component: the least id of each weakly connected component, by alternating star contractions."""
    rows = store.pairs if relation is None else store.triples.where(F.col("predicate") == bare(relation)).select("subject", "object")
    edges = cut(rows.where("subject <> object").select(F.greatest("subject", "object").alias("u"), F.least("subject", "object").alias("v")).distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
        edges = cut(_contracted(edges))
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    every = rows.select(F.explode(F.array("subject", "object")).alias("id")).distinct()
    return every.join(stars, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _contracted(edges: DataFrame) -> DataFrame:
    """One large star (larger neighbours to the least) and one small star (smaller ones and the node to the least)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
