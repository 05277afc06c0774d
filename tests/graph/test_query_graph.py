import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from kgspark import service
from kgspark.functions.terms import attribute_test
from kgspark.plans import dsl
from kgspark.plans.expand import Expander, expand_query_graph
from kgspark.plans.message import drawing, query, rendered_edges
from kgspark.plans.pattern import bindings, match, validated
from kgspark.plans.report import association_html, association_report, association_text, audit_html, audit_report
from kgspark.plans.resolve import names, path_text, resolve, resolve_one
from kgspark.sources.store import from_records, from_triples


def graph(nodes, **edges):
    return {"nodes": nodes, "edges": {k: {"subject": e[0], "predicates": e[1], "object": e[2]} | (e[3] if len(e) > 3 else {}) for k, e in edges.items()}}


def qualifiers(**values):
    return [{"qualifier_set": [{"qualifier_type_id": f"biolink:{k}", "qualifier_value": v} for k, v in values.items()]}]


def test_validation():
    for wrong, text in ((None, "must be an object"), ({"nodes": []}, "nodes"), ({"nodes": {}}, "edges must be"), ({"nodes": {}, "paths": {}}, "paths"), ({"nodes": {}, "edges": {"e": 1}}, "'e'"), ({"nodes": {}, "edges": {"e": {}}}, "missing"), ({"nodes": {}, "edges": {"e": {"subject": "a", "object": "b"}}}, "is not a node")):
        with pytest.raises(ValueError, match=text):
            validated(wrong)


def test_shapes(spark):
    store = from_triples(spark, [("A:1", "p", "B:1"), ("A:1", "p", "B:2"), ("B:1", "q", "C:1"), ("B:2", "q", "C:2"), ("C:1", "r", "A:1"), ("A:1", "s", "D:1")])
    fork = graph({"a": {"ids": ["A:1"]}, "b": {}, "d": {}}, x=("a", ["p"], "b"), y=("a", ["s"], "d"))
    assert sorted(r.n_b for r in bindings(store, fork).collect()) == ["B:1", "B:2"]
    cycle = graph({"a": {}, "b": {}, "c": {}}, x=("a", ["p"], "b"), y=("b", ["q"], "c"), z=("c", ["r"], "a"))
    assert [(r.n_a, r.n_b, r.n_c) for r in bindings(store, cycle).collect()] == [("A:1", "B:1", "C:1")]
    with pytest.raises(ValueError, match="not connected"):
        bindings(store, graph({"a": {}, "b": {}, "c": {}, "d": {}}, x=("a", ["p"], "b"), y=("c", ["q"], "d")))
    found = match(store, graph({"a": {"ids": ["A:1"]}, "b": {}}, x=("a", [], "b")), limit=2)
    assert found.truncated and found.bindings.count() == 2


def test_qualifiers_hold_on_one_record(qualified):
    ask = lambda **q: sorted(r.n_b for r in bindings(qualified, graph({"a": {"ids": ["A:1"]}, "b": {}}, e=("a", ["affects"], "b", {"qualifier_constraints": qualifiers(**q)}))).collect())
    assert ask(object_direction_qualifier="increased", object_aspect_qualifier="activity") == ["B:1"]
    assert ask(object_direction_qualifier="decreased", object_aspect_qualifier="activity") == []
    assert ask(object_direction_qualifier="increased") == ["B:1", "B:2"] and ask(unknown="x") == [] and ask() == ["B:1", "B:2"]


def test_constraints(spark):
    rows = spark.createDataFrame([(1, "150", None), (2, "50", None), (3, None, None), (4, None, ["x", "y"])], "k int, v string, l array<string>")
    check = lambda op, value, negated=False: {r.k for r in rows.where(attribute_test(F.col("v"), F.col("l"), op, value, negated)).collect()}
    assert check(">", 100) == {1} and check(">", 100, True) == {2, 3, 4} and check("<", "60") == {2} and check(">", "abc") == set()
    assert check("==", "50") == {2} and check("==", "x") == {4} and check("matches", "/^1.*/i") == {1} and check("matches", "x y") == {4} and check("matches", "(") == set()
    assert check("in", ["150", "7"]) == {1} and check("in", "a 50 b") == {2} and check("nonsense", 1) == set() and check("nonsense", 1, True) == {1, 2, 3, 4}
    store = from_records(spark, [{"id": "A:1", "name": "Alpha", "category": ["biolink:Gene"], "score": 5}, {"id": "A:2", "name": "beta", "category": ["biolink:Gene"]}], [{"subject": a, "predicate": "p", "object": "B:1"} for a in ("A:1", "A:2")])
    ask = lambda **c: sorted(r.n_a for r in bindings(store, graph({"a": {"constraints": [c]}, "b": {"ids": ["B:1"]}}, e=("a", ["p"], "b"))).collect())
    assert ask(id="biolink:name", operator="matches", value="/ALPHA/i") == ["A:1"] and ask(id="score", operator=">", value=4) == ["A:1"]
    assert ask(id="score", operator=">", value=4, **{"not": True}) == ["A:2"] and ask(id="category", operator="==", value="Gene") == ["A:1", "A:2"]


def test_subclasses(hierarchy):
    ask = lambda depth, cats=(): {(r.n_a, r.q_b) for r in bindings(hierarchy, graph({"a": {}, "b": {"ids": ["ROOT:1"], "categories": list(cats)}}, e=("a", ["treats"], "b")), subclass_depth=depth).collect()}
    assert ask(0) == {("D:3", None)} and ask(1) == {("D:3", None), ("D:2", "ROOT:1")} and ask(None) == {("D:3", None), ("D:2", "ROOT:1"), ("D:1", "ROOT:1")}
    assert ask(None, ["biolink:Disease"]) == {("D:3", None), ("D:1", "ROOT:1")}  # the expanded phenotype does not conform


def test_symmetric_edges(spark):
    store = from_triples(spark, [("A:1", "interacts_with", "B:1"), ("C:1", "interacts_with", "A:1"), ("C:1", "causes", "A:1")])
    rows = bindings(store, graph({"a": {"ids": ["A:1"]}, "b": {}}, e=("a", ["interacts_with", "causes"], "b"))).collect()
    assert sorted((r.n_b, r.s_e, r.p_e) for r in rows) == [("B:1", "A:1", "interacts_with"), ("C:1", "C:1", "interacts_with")]
    both = bindings(store, graph({"a": {"ids": ["C:1"]}, "b": {}}, e=("a", [], "b")), collapse_predicates=True).collect()
    assert [(r.n_b, r.p_e) for r in both] == [("A:1", "causes")]


def test_expander():
    e = Expander({"affects": frozenset({"regulates"})}, {"abundance": frozenset({"expression"}), "v": frozenset(map(str, range(70)))})
    asked = graph({"a": {}, "b": {}}, e=("a", ["biolink:affects"], "b", {"qualifier_constraints": qualifiers(object_aspect_qualifier="abundance")}))
    wide = expand_query_graph(asked, e)
    assert wide["edges"]["e"]["predicates"] == ["biolink:affects", "biolink:regulates"] and len(wide["edges"]["e"]["qualifier_constraints"]) == 2
    assert asked["edges"]["e"]["predicates"] == ["biolink:affects"]
    many = graph({"a": {}, "b": {}}, e=("a", [], "b", {"qualifier_constraints": qualifiers(object_aspect_qualifier="v")}))
    assert expand_query_graph(many, e)["edges"]["e"]["qualifier_constraints"] == many["edges"]["e"]["qualifier_constraints"]


def test_messages(synthetic, hierarchy):
    asked = graph({"a": {"ids": ["RIVER:1"]}, "b": {"categories": ["biolink:Lake"]}}, e=("a", ["biolink:feeds"], "b"))
    message = query(synthetic, asked)["message"]
    assert [r["node_bindings"]["b"][0]["id"] for r in message["results"]] == ["LAKE:1", "LAKE:2"] and "logs" not in message
    assert message["knowledge_graph"]["nodes"]["RIVER:1"]["attributes"] == [{"attribute_type_id": "biolink:length", "value": "288"}]
    edge = message["knowledge_graph"]["edges"][message["results"][0]["analyses"][0]["edge_bindings"]["e"][0]["id"]]
    assert edge["predicate"] == "biolink:feeds" and edge["attributes"][0] == {"attribute_type_id": "biolink:knowledge_level", "value": "measured"}
    assert query(synthetic, asked, limit=1)["message"]["logs"][0]["code"] == "ResultsTruncated"
    below = query(hierarchy, graph({"a": {}, "b": {"ids": ["ROOT:1"]}}, e=("a", ["treats"], "b")))["message"]
    assert [r["node_bindings"]["b"][0].get("query_id") for r in below["results"]] == ["ROOT:1", None]
    assert drawing(asked) == "(a RIVER:1) --biolink:feeds--> (b biolink:Lake)"


def test_patterns(synthetic):
    asked, variables = dsl.to_query_graph([["RIVER:1", "feeds", "?g:Lake"], ["?g", {"predicate": "supplies"}, "biolink:Town"]])
    assert asked["nodes"] == {"n0": {"ids": ["RIVER:1"]}, "n1": {"categories": ["biolink:Lake"]}, "n2": {"categories": ["biolink:Town"]}} and variables == {"g": "n1"}
    assert dsl.run(synthetic, [["RIVER:1", "feeds", "?g"], ["?g", "*", "?d"]], name_lookup=True)["rows"] == [{"g": "LAKE:1", "d": "TOWN:1", "g_name": "Thun", "d_name": "Bern"}]
    got = dsl.run(synthetic, [["Aare", "feeds", "?g"]], limit=1, resolver=lambda t: resolve_one(synthetic, t))
    assert got == {"rows": [{"g": "LAKE:1"}], "truncated": True, "enumeration_truncated": False}
    assert dsl.run(synthetic, [["RIVER:1", "feeds", "?g"]], enumerate_limit=1)["enumeration_truncated"]
    for wrong, text in (([], "one or more"), ([["A:1", "p"]], "triple 0"), ([["A:1", "p", "?"]], "needs a name"), ([["A:1", "p", "B:1"], ["name", "p", "B:1"]], "triple 1"), ([["A:1", {"colour": 1}, "B:1"]], "colour"), ([["A:1", 5, "B:1"]], "an edge is"), ([[5, "p", "B:1"]], "a node is")):
        with pytest.raises(dsl.PatternError, match=text):
            dsl.to_query_graph(wrong)
    with pytest.raises(dsl.PatternError, match="pin one"):
        dsl.run(synthetic, [["?a", "p", "?b"]])
    assert dsl.query_terms(asked) == (["biolink:feeds", "biolink:supplies"], [])


def test_names(synthetic):
    assert [c["id"] for c in resolve(synthetic, "thun")] == ["LAKE:1", "LAKE:2"] and resolve(synthetic, "thun", "Town") == []
    with pytest.raises(ValueError):
        resolve_one(synthetic, "nothing")
    assert names(synthetic, ["LAKE:1", "X:1"]) == {"LAKE:1": "Thun", "X:1": "X:1"}
    assert path_text([("A", "p", "B"), ("C", "q", "B")]) == "A -[p]-> B <-[q]- C"


def test_reports(synthetic, hierarchy):
    report = association_report(synthetic, "RIVER:1", "Town")
    assert report["direct"] == [] and report["two_hop"][0]["by_name"] == "Thun" and report["two_hop"][0]["group"] == "other"
    assert "Bern" in association_html(report) and association_text(report).startswith("Aare")
    audit = audit_report(hierarchy)
    assert audit[0]["predicate"] == "subclass_of" and audit[0]["examples"] == [["LOOP:1", "ROOT:1"]] and "LOOP:1" in audit_html(audit)


def test_reports_remove_repeats_before_they_limit(spark):
    """Of a hub with two predicates to each end, `limit` counts ends that are listed, says that there are more, and a direct end is none over two hops."""
    edges = [("S:1", p, f"T:{i}") for i in range(6) for p in ("p", "q")] + [("S:1", "p", "M:1")] + [("M:1", "p", f"T:{i}") for i in range(9)]
    store = from_triples(spark, edges, [(f"T:{i}", None, ["Town"]) for i in range(9)])
    whole, some = association_report(store, "S:1", "Town"), association_report(store, "S:1", "Town", limit=4)
    assert len(whole["direct"]) == 12 and [r["id"] for r in whole["two_hop"]] == ["T:6", "T:7", "T:8"] and not whole["truncated"]
    assert len(some["direct"]) == 4 and [r["id"] for r in some["two_hop"]] == ["T:6", "T:7", "T:8"] and some["truncated"]


def test_service(synthetic):
    good = {"message": {"query_graph": graph({"a": {"ids": ["RIVER:1"]}, "b": {}}, e=("a", [], "b"))}}
    assert service.handle(synthetic, good)[0] == 200 and "Aare" in service.handle(synthetic, good, summary=True)[1]
    for bad in (None, [], {}, {"message": {"query_graph": {"nodes": {}}}}, good | {"limit": "many"}):
        assert service.handle(synthetic, bad)[0] == 400
    assert service.handle(None, good)[0] == 503 and service.health(synthetic)[0] == 200 and service.clamped(10**9) == 10_000
    assert service.meta(synthetic)["predicates"] == {"biolink:feeds": 2, "biolink:lies_on": 1, "biolink:supplies": 1}
    assert service.connect_entities(synthetic, "Aare", "Bern")["paths"] == ["RIVER:1 -[feeds]-> LAKE:1 -[supplies]-> TOWN:1"]
    assert "error" in service.find_associations(synthetic, "RIVER:1", "Town", 9) and "error" in service.list_neighbors(synthetic, "NONE:1")
    assert service.find_associations(synthetic, "RIVER:1", "Town", 2)["associations"] == ["Aare -[biolink:feeds]-> Thun -[biolink:supplies]-> Bern"]
    assert service.list_neighbors(synthetic, "RIVER:1", category="Lake")["neighbors"] == {"LAKE:1": "Thun", "LAKE:2": "Thun shore, upper"}
    assert service.graph_query(synthetic, [["Aare", "feeds", "?g"]])["rows"][0]["g_name"] == "Thun"
    assert service.graph_info(synthetic)["triples"] == 4 and "biolink:Lake" in service.describe_schema(synthetic)["categories"] and service.resolve_entity(synthetic, "aare")["candidates"]


def test_http(synthetic):
    web = service.server(synthetic)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{web.server_address[1]}"
    try:
        asked = json.dumps({"message": {"query_graph": graph({"a": {"ids": ["RIVER:1"]}, "b": {}}, e=("a", [], "b"))}}).encode()
        answer = json.load(urllib.request.urlopen(f"{at}/query", asked))
        assert len(answer["message"]["results"]) == 2
        assert "2 results" in urllib.request.urlopen(f"{at}/query?summary", asked).read().decode()
        assert json.load(urllib.request.urlopen(f"{at}/health")) == {"status": "ok"} and "store_format_version" in json.load(urllib.request.urlopen(f"{at}/version"))
        for target, body, status in (("/query", b"{", 400), ("/query", b"[]", 400), ("/none", None, 404)):
            with pytest.raises(urllib.error.HTTPError) as e:
                urllib.request.urlopen(at + target, body)
            assert e.value.code == status
    finally:
        web.shutdown()
        web.server_close()
    assert service.route(None, "GET", "/meta")[0] == 503 and service.route(None, "GET", "/health")[0] == 503


def test_rendered_edges_are_those_of_a_message(synthetic, qualified):
    for store, asked in ((synthetic, graph({"a": {}, "b": {}, "c": {}}, x=("a", None, "b"), y=("b", None, "c"))), (qualified, graph({"a": {"ids": ["A:1"]}, "b": {}}, x=("a", None, "b")))):
        want = [e | {"attributes": [a | {"value": a["value"] if isinstance(a["value"], str) else json.dumps(a["value"])} for a in e["attributes"]], "qualifiers": e.get("qualifiers", [])} for e in query(store, asked)["message"]["knowledge_graph"]["edges"].values()]
        got = [r.asDict(True) | {"sources": e["sources"]} for r, e in zip(rendered_edges(store, asked).orderBy("subject", "predicate", "object").collect(), want, strict=True)]
        assert want and got == sorted(want, key=lambda e: (e["subject"], e["predicate"], e["object"]))
