"""The engine behind a server, a tool set or a command line: functions from requests to answers, and a small HTTP server around them."""

from __future__ import annotations

import argparse
import functools
import json
import os
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kgspark.functions.terms import full, is_curie
from kgspark.operators import aggregates
from kgspark.operators.paths import all_shortest_paths, shortest_path
from kgspark.operators.traverse import associations, neighbors
from kgspark.operators.metadata import filter_nodes
from kgspark.plans import dsl
from kgspark.plans.message import drawing, query
from kgspark.plans.resolve import names, path_text, resolve, resolve_one
from kgspark.sources.store import FORMAT_VERSION, GraphStore

#: Most results of a request, and its ceilings for tools; KGSPARK_MAX_HOPS and KGSPARK_MAX_ROWS override the latter.
MAX_RESULTS, DEFAULT_RESULTS, MAX_HOPS, MAX_ROWS = 10_000, 1_000, 3, 500


def clamped(limit: object) -> int:
    """A limit between 1 and MAX_RESULTS; a ValueError if it is no whole number."""
    if limit is None:
        return DEFAULT_RESULTS
    if isinstance(limit, bool) or not isinstance(limit, int):
        raise ValueError("limit must be a whole number")
    return max(1, min(limit, MAX_RESULTS))


def handle(store: GraphStore | None, body: object, summary: bool = False) -> tuple[int, object]:
    """Status and answer to a query request: 400 for what is wrong with it, 503 without a graph, 500 for anything else."""
    if store is None:
        return 503, {"error": "no graph is loaded"}
    try:
        if not isinstance(body, dict):
            raise ValueError("the request must be an object")
        graph = (body.get("message") or {}).get("query_graph") if isinstance(body.get("message"), dict) else body.get("query_graph")
        if not isinstance(graph, dict):
            raise ValueError("message.query_graph must be an object")
        answer = query(store, graph, clamped(body.get("limit")), subclass_depth=body.get("subclass_depth", 1))
        return 200, summary_text(answer) if summary else answer
    except ValueError as e:
        return 400, {"error": str(e)}
    except Exception as e:  # noqa: BLE001
        return 500, {"error": f"{type(e).__name__}: {e}"}


def summary_text(answer: dict) -> str:
    message = answer["message"]
    nodes = message["knowledge_graph"]["nodes"]
    rows = [", ".join(f"{k}={nodes[b[0]['id']].get('name') or b[0]['id']}" for k, b in r["node_bindings"].items()) for r in message["results"]]
    return "\n".join([drawing(message["query_graph"]), f"{len(rows)} results" + (" (more exist)" if message.get("logs") else ""), *rows])


def health(store: GraphStore | None) -> tuple[int, dict]:
    return (200, {"status": "ok"}) if store else (503, {"status": "no graph"})


def version(store: GraphStore) -> dict:
    return {"store_format_version": FORMAT_VERSION} | store.manifest


def meta(store: GraphStore) -> dict:
    """Predicates with their records, categories with their members, and sizes."""
    return {
        "predicates": {full(r.predicate): r.records for r in aggregates.predicate_counts(store).orderBy(F.desc("records"), "predicate").collect()},
        "categories": {full(r.category): r.members for r in aggregates.category_counts(store).orderBy(F.desc("members"), "category").collect()},
        "counts": aggregates.sizes(store).first().asDict(),
    }


@functools.lru_cache(maxsize=4)
def loaded(spark: SparkSession, path: str) -> GraphStore:
    """A saved graph; the same one for the same path."""
    return GraphStore.load(spark, path)


def route(store: GraphStore | None, method: str, target: str, body: bytes = b"") -> tuple[int, object]:
    """Status and answer of a request to /query (POST, ?summary for text), /, /meta, /version or /health."""
    url = urlsplit(target)
    if method == "POST" and url.path == "/query":
        try:
            asked = json.loads(body)
        except ValueError:
            return 400, {"error": "the request must be JSON"}
        return handle(store, asked, "summary" in parse_qs(url.query, keep_blank_values=True))
    if method == "GET" and url.path == "/health":
        return health(store)
    pages = {"/": lambda s: {"service": "kgspark", "routes": ["/query", "/meta", "/version", "/health"]}, "/meta": meta, "/version": version}
    if method != "GET" or url.path not in pages:
        return 404, {"error": f"there is no {method} {url.path}"}
    return (200, pages[url.path](store)) if store else (503, {"error": "no graph is loaded"})


def server(store: GraphStore | None, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server of route(), a thread for each request (Spark runs their jobs side by side); serve_forever() starts it."""

    class Requests(BaseHTTPRequestHandler):
        def answer(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, said = route(store, self.command, self.path, body)
            raw = said.encode() if isinstance(said, str) else json.dumps(said).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/plain; charset=utf-8" if isinstance(said, str) else "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = answer

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Requests)


def tool(f: Callable) -> Callable:
    """A tool answers anticipated mistakes as {"error": ...}."""

    @functools.wraps(f)
    def wrapped(*args, **kwargs) -> dict:
        try:
            return f(*args, **kwargs)
        except (ValueError, RuntimeError) as e:
            return {"error": str(e)}

    return wrapped


def _id(store: GraphStore, text: str, category: str | None = None) -> str:
    return text if is_curie(text) and " " not in text else resolve_one(store, text, category)


def _ceiling(name: str, default: int) -> int:
    return int(os.environ.get(f"KGSPARK_{name}", default))


@tool
def resolve_entity(store: GraphStore, text: str, category: str | None = None, top: int = 5) -> dict:
    return {"candidates": resolve(store, text, category, min(top, _ceiling("MAX_ROWS", MAX_ROWS)))}


@tool
def find_associations(store: GraphStore, source: str, target_category: str, max_hops: int = 1, limit: int = 25) -> dict:
    if max_hops > _ceiling("MAX_HOPS", MAX_HOPS):
        raise ValueError(f"max_hops is {_ceiling('MAX_HOPS', MAX_HOPS)} at most")
    limit = min(limit, _ceiling("MAX_ROWS", MAX_ROWS))
    rows = associations(store, _id(store, source), target_category, max_hops, limit + 1).collect()
    walks = [[(r[f"s{k}"], full(r[f"p{k}"]), r[f"o{k}"]) for k in range(max_hops)] for r in rows[:limit]]
    label = names(store, [x for w in walks for s, _, o in w for x in (s, o)])
    return {"associations": [path_text(w, label) for w in walks], "truncated": len(rows) > limit}


@tool
def connect_entities(store: GraphStore, a: str, b: str, all_paths: bool = True) -> dict:
    a, b = _id(store, a), _id(store, b)
    if not all_paths:
        one = shortest_path(store, a, b)
        return {"paths": [] if one is None else [path_text(one)]}
    most = _ceiling("MAX_ROWS", MAX_ROWS)
    rows = all_shortest_paths(store, a, b).orderBy("path").limit(most + 1).collect()
    return {"paths": [path_text([tuple(e) for e in r.path]) for r in rows[:most]], "truncated": len(rows) > most}


@tool
def list_neighbors(store: GraphStore, node: str, relation: str | None = None, category: str | None = None, limit: int = 100) -> dict:
    limit = min(limit, _ceiling("MAX_ROWS", MAX_ROWS))
    ids = neighbors(store, _id(store, node), relation)
    ids = filter_nodes(store, ids, category) if category else ids
    rows = [r.id for r in ids.orderBy("id").limit(limit + 1).collect()]
    return {"neighbors": names(store, rows[:limit]), "truncated": len(rows) > limit}


@tool
def graph_query(store: GraphStore, pattern: list, return_vars: list[str] | None = None, limit: int = 25) -> dict:
    return dsl.run(store, pattern, return_vars, min(limit, _ceiling("MAX_ROWS", MAX_ROWS)), resolver=lambda text: resolve_one(store, text), name_lookup=True)


@tool
def describe_schema(store: GraphStore) -> dict:
    out = meta(store)
    return {"predicates": out["predicates"], "categories": out["categories"], "qualifiers": sorted(dsl.ALIASES)}


@tool
def graph_info(store: GraphStore) -> dict:
    return aggregates.sizes(store).first().asDict() | version(store)


def main(argv: list[str] | None = None) -> None:
    """resolve, assoc, connect, neighbors and serve on a saved graph."""
    parser = argparse.ArgumentParser(prog="kgspark")
    parser.add_argument("store")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, args in (("resolve", ["text"]), ("assoc", ["source", "category"]), ("connect", ["a", "b"]), ("neighbors", ["node"])):
        sub = commands.add_parser(name)
        for a in args:
            sub.add_argument(a)
        if name == "assoc":
            sub.add_argument("--hops", type=int, default=1)
        if name in ("resolve", "neighbors"):
            sub.add_argument("--category")
    commands.add_parser("serve").add_argument("--port", type=int, default=int(os.environ.get("KGSPARK_PORT", 8080)))
    got = parser.parse_args(argv)
    store = loaded(SparkSession.builder.getOrCreate(), got.store)
    if got.command == "serve":
        server(store, os.environ.get("KGSPARK_HOST", "127.0.0.1"), got.port).serve_forever()
    answer = {
        "resolve": lambda: resolve_entity(store, got.text, got.category), "assoc": lambda: find_associations(store, got.source, got.category, got.hops),
        "connect": lambda: connect_entities(store, got.a, got.b), "neighbors": lambda: list_neighbors(store, got.node, None, got.category),
    }[got.command]()
    print(json.dumps(answer, indent=1, ensure_ascii=False))


if __name__ == "__main__":
    main()
