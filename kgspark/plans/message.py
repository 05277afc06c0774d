"""Query graphs answered as messages: bindings with the nodes and edges that they name."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions.terms import QUALIFIERS, full
from kgspark.operators.metadata import least_variants, record
from kgspark.plans.expand import Expander
from kgspark.plans.pattern import bindings, match, validated
from kgspark.sources.store import GraphStore

RESOURCE = "infores:kgspark"


def _attributes(fields: dict, known: tuple[str, ...]) -> list[dict]:
    return [{"attribute_type_id": full(k), "value": v} for k, v in fields.items() if k not in known]


def knowledge_node(row: dict | None) -> dict:
    if not row:
        return {"categories": [], "attributes": []}
    fields = record(row)
    return {"name": fields.get("name"), "categories": [full(c) for c in fields.get("category", [])], "attributes": _attributes(fields, ("id", "name", "category"))}


def knowledge_edge(triple: tuple[str, str, str], row: dict | None) -> dict:
    s, p, o = triple
    out: dict = {"subject": s, "predicate": full(p or "related_to"), "object": o, "sources": [{"resource_id": RESOURCE, "resource_role": "primary_knowledge_source"}], "attributes": []}
    if row:
        fields = record(row)
        out["attributes"] = [{"attribute_type_id": full(k), "value": fields[k]} for k in ("knowledge_level", "agent_type") if fields.get(k)]
        if named := [{"qualifier_type_id": full(k), "qualifier_value": str(fields[k])} for k in QUALIFIERS[:6] if fields.get(k)]:
            out["qualifiers"] = named
        out["attributes"] += _attributes(fields, ("subject", "predicate", "object", "knowledge_level", "agent_type", *QUALIFIERS[:6]))
    return out


RENDERED = "subject string, predicate string, object string, attributes array<struct<attribute_type_id: string, value: string>>, qualifiers array<struct<qualifier_type_id: string, qualifier_value: string>>"


def rendered_edges(store: GraphStore, query_graph: dict, node_subclassing: bool = True, subclass_depth: int | None = 1) -> DataFrame:
    """Every edge that the query graph's matches name, as knowledge_edge shows it, without any limit; values that are no text as JSON."""
    _, edges = validated(query_graph)
    found = bindings(store, query_graph, node_subclassing, subclass_depth)
    triples = None
    for e in edges:
        own = found.select(*(F.col(f"{x}_{e.key}").alias(n) for x, n in (("s", "subject"), ("p", "predicate"), ("o", "object"))))
        triples = own if triples is None else triples.unionByName(own)
    rows = least_variants(store.edges.join(triples.distinct(), ["subject", "predicate", "object"], "left_semi"))
    text = lambda v: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shown = [knowledge_edge((r["subject"], r["predicate"], r["object"]), r | {"qualifiers": dict(r["qualifiers"] or [])}) for r in batch.to_pylist()]
            named = [e | {"attributes": [a | {"value": text(a["value"])} for a in e["attributes"]], "qualifiers": e.get("qualifiers", [])} for e in shown]
            yield pa.RecordBatch.from_pylist([{k: e[k] for k in schema.names} for e in named], schema)

    pair = lambda *names: pa.list_(pa.struct([(n, pa.string()) for n in names]))
    schema = pa.schema([*((n, pa.string()) for n in ("subject", "predicate", "object")), ("attributes", pair("attribute_type_id", "value")), ("qualifiers", pair("qualifier_type_id", "qualifier_value"))])
    return rows.mapInArrow(run, RENDERED)


def query(store: GraphStore, query_graph: dict, limit: int = 1000, expander: Expander | None = None, node_subclassing: bool = True, subclass_depth: int | None = 1) -> dict:
    """A message with at most `limit` results; logs say so where there are more."""
    if limit is None:
        raise ValueError("a message needs a limit")
    found = match(store, query_graph, limit, node_subclassing, subclass_depth, expander)
    nodes, edges = validated(query_graph)
    rows = found.bindings.collect()  # `limit` bounds it
    ids = sorted({r[f"n_{k}"] for r in rows for k in nodes})
    triples = list(dict.fromkeys((r[f"s_{e.key}"], r[f"p_{e.key}"], r[f"o_{e.key}"]) for r in rows for e in edges))
    node_rows, edge_rows = {}, {}
    if ids:
        wanted = F.broadcast(store.spark.createDataFrame([(i,) for i in ids], "id string"))
        node_rows = {r.id: r.asDict() for r in store.nodes.join(wanted, "id", "left_semi").collect()}
        asked = F.broadcast(store.spark.createDataFrame(triples, "subject string, predicate string, object string"))
        best = least_variants(store.edges.join(asked, ["subject", "predicate", "object"], "left_semi"))
        edge_rows = {(r.subject, r.predicate, r.object): r.asDict() for r in best.collect()}
    edge_ids = {t: f"e{k}" for k, t in enumerate(triples)}
    results = [
        {
            "node_bindings": {k: [{"id": r[f"n_{k}"], "attributes": []} | ({"query_id": r[f"q_{k}"]} if r[f"q_{k}"] else {})] for k in nodes},
            "analyses": [{"resource_id": RESOURCE, "edge_bindings": {e.key: [{"id": edge_ids[r[f"s_{e.key}"], r[f"p_{e.key}"], r[f"o_{e.key}"]], "attributes": []}] for e in edges}}],
        }
        for r in rows
    ]
    message = {
        "query_graph": query_graph,
        "knowledge_graph": {"nodes": {i: knowledge_node(node_rows.get(i)) for i in ids}, "edges": {edge_ids[t]: knowledge_edge(t, edge_rows.get(t)) for t in triples}},
        "results": results,
    }
    if found.truncated:
        message["logs"] = [{"timestamp": datetime.now(UTC).isoformat(), "level": "WARNING", "code": "ResultsTruncated", "message": f"there are more than the {limit} results that were asked for"}]
    return {"message": message}


def drawing(query_graph: dict) -> str:
    """The query graph as lines of text: one for each edge; ends that do not exist are shown as '?'."""
    nodes = query_graph.get("nodes") or {}

    def label(key: str | None) -> str:
        if key not in nodes:
            return f"({key} ?)"
        n = nodes[key] or {}
        return f"({key} {', '.join(n.get('ids') or n.get('categories') or ['*'])})"

    return "\n".join(f"{label(e.get('subject'))} --{' | '.join(e.get('predicates') or ['*'])}--> {label(e.get('object'))}" for e in (query_graph.get("edges") or {}).values())
