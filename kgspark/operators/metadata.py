"""Lookups and filters of node and edge records."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.terms import bare, full_column
from kgspark.sources.store import GraphStore, variants


def python_text(value: object) -> str:
    return "None" if value is None else str(value)


def field_is(name: str, value: object, core: tuple[str, ...]) -> Column:
    """A record's field, as text, equals the value as text; a missing field reads 'None'."""
    raw = F.col(name).cast("string") if name in core else F.get_json_object("extra", f"$['{name}']")
    if name not in core and "qualifiers" in core:
        raw = F.coalesce(F.try_element_at("qualifiers", F.lit(name)), raw)
    wanted = python_text(value).lower() if isinstance(value, bool) else python_text(value)
    return F.coalesce(raw, F.lit("None")) == wanted


NODE_CORE = ("id", "name")
EDGE_CORE = ("subject", "predicate", "object", "knowledge_level", "agent_type", "qualifiers")


def node(store: GraphStore, node_id: str) -> dict:
    """A node's record with prefixed categories; {} for an unknown id."""
    row = store.nodes.where(F.col("id") == node_id).withColumn("category", F.transform("category", full_column)).first()
    return record(row.asDict()) if row else {}


def record(row: dict) -> dict:
    """A row as one flat record: extra fields and qualifiers beside the core ones, empty ones left out."""
    out = {k: v for k, v in row.items() if k not in ("extra", "qualifiers", "qual_fp", "seq") and v is not None}
    return out | dict(row.get("qualifiers") or {}) | (json.loads(row["extra"]) if row.get("extra") else {})


def edge_variants(store: GraphStore, subject: str, predicate: str, obj: str) -> list[dict]:
    """The records of one triple, one for each set of qualifiers, by fingerprint."""
    rows = variants(store.edges.where((F.col("subject") == subject) & (F.col("predicate") == bare(predicate)) & (F.col("object") == obj)))
    return [record(r.asDict()) | {"predicate": f"biolink:{r.predicate}" if ":" not in r.predicate else r.predicate} for r in rows.orderBy("qual_fp").collect()]


def edge(store: GraphStore, subject: str, predicate: str, obj: str) -> dict:
    """The variant with the lowest fingerprint; {} without any."""
    return next(iter(edge_variants(store, subject, predicate, obj)), {})


def filter_nodes(store: GraphStore, ids: DataFrame, category: str | None = None, extra_filters: dict | None = None) -> DataFrame:
    """Those of ids (column id) that are known and pass; category membership is exact."""
    rows = store.nodes
    if category:
        rows = rows.where(F.array_contains("category", bare(category)))
    for name, value in (extra_filters or {}).items():
        rows = rows.where(field_is(name, value, NODE_CORE))
    return ids.select("id").distinct().join(rows.select("id"), "id", "left_semi")


def nodes_by_category(store: GraphStore, category: str, limit: int | None = None) -> DataFrame:
    rows = store.nodes.where(F.array_contains("category", bare(category))).select("id")
    return rows if limit is None else rows.orderBy("id").limit(limit)


def filter_edges(store: GraphStore, candidates: DataFrame, knowledge_level: str | None = None, agent_type: str | None = None, extra_filters: dict | None = None) -> DataFrame:
    """Variants of the candidate edges (subject, predicate, object; a null predicate means any) that pass all filters."""
    rows = variants(store.edges)
    for name, value in (("knowledge_level", knowledge_level), ("agent_type", agent_type)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    for name, value in (extra_filters or {}).items():
        rows = rows.where(field_is(name, value, EDGE_CORE))
    wanted = candidates.select(F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("object").alias("o")).distinct()
    return rows.join(wanted, (F.col("subject") == F.col("s")) & (F.col("object") == F.col("o")) & (F.col("p").isNull() | (F.col("p") == F.col("predicate"))), "left_semi")


def predicates_of(store: GraphStore, pairs: DataFrame) -> DataFrame:
    """subject, object, predicate of all triples between pairs of known ends (subject, object)."""
    return store.edges.join(pairs.select("subject", "object").distinct(), ["subject", "object"], "left_semi").select("subject", "object", "predicate").distinct()


def least_variants(edges: DataFrame) -> DataFrame:
    """One record for each triple, as edge gives it: of the variant with the least fingerprint the last."""
    key = ["subject", "predicate", "object"]
    rest = [c for c in edges.columns if c not in key]
    least = edges.groupBy(*key, "qual_fp").agg(F.max_by(F.struct(*rest), "seq").alias("v")).groupBy(*key).agg(F.min_by("v", "qual_fp").alias("v"))
    return least.select(*key, "v.*").select(*edges.columns)


def edges_between(store: GraphStore, subject: str, obj: str) -> DataFrame:
    return store.triples.where((F.col("subject") == subject) & (F.col("object") == obj)).select(full_column(F.col("predicate")).alias("predicate"))


def has_edge(store: GraphStore, subject: str, obj: str, relation: str | None = None) -> bool:
    rows = store.edges.where((F.col("subject") == subject) & (F.col("object") == obj))
    return not (rows if relation is None else rows.where(F.col("predicate") == bare(relation))).isEmpty()
