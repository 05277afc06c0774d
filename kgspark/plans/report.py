"""Reports: associations of a node, and the audit's findings, as data, text and HTML."""

from __future__ import annotations

from html import escape

from pyspark.sql import functions as F

from kgspark.functions.terms import full, name_class
from kgspark.operators import aggregates
from kgspark.operators.traverse import associations
from kgspark.plans.resolve import names
from kgspark.sources.store import GraphStore


def association_report(store: GraphStore, source: str, to_category: str, max_hops: int = 2, limit: int = 5000) -> dict:
    """Direct associations, and those over two hops whose end is not among the direct ones; rows carry names and groups.

    Repeats and direct ends go before anything is limited; truncated says whether `limit` left rows out of either list.
    """
    if limit is None:
        raise ValueError("a report needs a limit")
    direct = associations(store, source, to_category, 1, None).select("p0", F.col("n1").alias("end")).distinct()
    direct_rows, two_rows = direct.orderBy("p0", "end").limit(limit + 1).collect(), []
    if max_hops >= 2:
        two = associations(store, source, to_category, 2, None).select("p0", F.col("n1").alias("mid"), "p1", F.col("n2").alias("end")).distinct().join(direct.select("end").distinct(), "end", "left_anti")
        two_rows = two.orderBy("end", "mid", "p0", "p1").limit(limit + 1).collect()
    truncated = len(direct_rows) > limit or len(two_rows) > limit
    direct_rows, two_rows = direct_rows[:limit], two_rows[:limit]
    ids = sorted({source} | {r.end for r in direct_rows} | {x for r in two_rows for x in (r.mid, r.end)})
    label = names(store, ids)
    wanted = F.broadcast(store.spark.createDataFrame([(i,) for i in ids], "id string"))
    group = {r.id: r.g for r in wanted.join(store.nodes.select("id", "category"), "id", "left").select("id", name_class(F.col("id"), F.col("category")).alias("g")).collect()}
    return {
        "source": {"id": source, "name": label[source]},
        "category": full(to_category),
        "truncated": truncated,
        "direct": [{"predicate": full(r.p0), "id": r.end, "name": label[r.end], "group": group[r.end]} for r in direct_rows],
        "two_hop": [{"id": r.end, "name": label[r.end], "group": group[r.end], "by": r.mid, "by_name": label[r.mid], "predicates": [full(r.p0), full(r.p1)]} for r in two_rows],
    }


def _table(head: list[str], rows: list[list]) -> str:
    cells = lambda tag, row: "".join(f"<{tag}>{escape(str(c))}</{tag}>" for c in row)
    return f"<table><tr>{cells('th', head)}</tr>" + "".join(f"<tr>{cells('td', r)}</tr>" for r in rows) + "</table>"


def _page(title: str, body: str) -> str:
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>{body}</body></html>'


def association_html(report: dict) -> str:
    direct = _table(["predicate", "id", "name", "group"], [[r["predicate"], r["id"], r["name"], r["group"]] for r in report["direct"]])
    two = _table(["id", "name", "by", "predicates"], [[r["id"], r["name"], r["by_name"], " / ".join(r["predicates"])] for r in report["two_hop"]])
    return _page(f"{report['source']['name']} and {report['category']}", f"<h2>Direct</h2>{direct}<h2>Two hops</h2>{two}")


def association_text(report: dict) -> str:
    head = f"{report['source']['name']} ({report['source']['id']}): {len(report['direct'])} direct, {len(report['two_hop'])} over two hops" + (", and more" if report["truncated"] else "")
    return "\n".join([head, *(f"  {r['predicate']} {r['name']} ({r['id']})" for r in report["direct"])])


def audit_report(store: GraphStore, per_predicate: int = 10) -> list[dict]:
    """The findings, each with some examples."""
    found = [r.asDict() for r in aggregates.findings(store).collect()]
    shown: dict[str, list] = {}
    for r in aggregates.examples(store, per_predicate).orderBy("predicate", "a", "b").collect():
        shown.setdefault(r.predicate, []).append([r.a, r.b])
    return [f | {"examples": shown.get(f["predicate"], [])} for f in found]


def audit_html(report: list[dict]) -> str:
    return _page("Predicate audit", _table(["severity", "predicate", "category", "triples", "self loops", "mutual pairs", "examples"], [[r["severity"], r["predicate"], r["category"], r["directed"], r["self_loops"], r["mutual_pairs"], "; ".join(" - ".join(e) for e in r["examples"])] for r in report]))
