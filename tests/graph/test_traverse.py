import itertools
import random

import pytest

from kgspark.operators import aggregates, paths, traverse
from kgspark.sources.store import from_triples


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def test_neighbors(hierarchy, synthetic):
    assert ids(traverse.neighbors(synthetic, "RIVER:1")) == ["LAKE:1", "LAKE:2"] and ids(traverse.neighbors(synthetic, "RIVER:1", "biolink:none")) == []
    with pytest.raises(ValueError):
        traverse.neighbors(synthetic, "NONE:1")
    assert ids(traverse.neighbors(hierarchy, "MID:1", node_subclassing=True)) == ["MID:1", "ROOT:1"]


def test_descendants_end_in_cycles(hierarchy):
    assert ids(traverse.descendants(hierarchy, ["ROOT:1"])) == ["LEAF:1", "LOOP:1", "MID:1", "ROOT:1"]
    assert ids(traverse.descendants(hierarchy, ["ROOT:1"], 1)) == ["LOOP:1", "MID:1", "ROOT:1"] and ids(traverse.descendants(hierarchy, ["ROOT:1"], 0)) == ["ROOT:1"]


def test_patterns(synthetic, hierarchy):
    two = traverse.match_path(synthetic, ["RIVER:1", None, {"category": "Lake"}, None, {"category": "biolink:Town"}])
    assert [(r.n1, r.n2) for r in two.collect()] == [("LAKE:1", "TOWN:1")]
    assert traverse.match_path(synthetic, ["RIVER:1", {"agent_type": "model"}, None]).first().n1 == "LAKE:2"
    back = traverse.match_path(synthetic, ["TOWN:1", "supplies", None, "feeds", None], hop_directions=[False, False]).first()
    assert (back.n2, back.s1, back.o1) == ("RIVER:1", "RIVER:1", "LAKE:1")
    for wrong in ([], ["RIVER:1"], ["RIVER:1", None]):
        with pytest.raises(ValueError):
            traverse.match_path(synthetic, wrong)
    with pytest.raises(ValueError):
        traverse.match_path(synthetic, ["RIVER:1", None, None], hop_directions=[True, True])
    assert ids(traverse.match_path(hierarchy, [None, "treats", "ROOT:1"], node_subclassing=True, subclass_depth=1), "n0") == ["D:2", "D:3"]
    assert len(traverse.associations(synthetic, "RIVER:1", "Town", 2).collect()) == 1
    with pytest.raises(ValueError):
        traverse.associations(synthetic, "RIVER:1", "Town", 0)


def test_symmetric_hops(spark):
    store = from_triples(spark, [("A:1", "interacts_with", "B:1"), ("C:1", "interacts_with", "A:1"), ("B:1", "interacts_with", "A:1"), ("D:1", "treats", "A:1")])
    rows = traverse.match_path(store, ["A:1", None, None], symmetric=True).collect()
    assert sorted((r.n1, r.s0, r.o0) for r in rows) == [("B:1", "A:1", "B:1"), ("C:1", "C:1", "A:1")]


def test_limits_are_the_same_every_time(spark):
    store = from_triples(spark, [("S:1", "p", f"T:{i}") for i in range(60)])
    stats = traverse.MatchStats()
    first = ids(traverse.match_path(store, ["S:1", "p", None], limit=5, stats=stats), "n1")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert ids(traverse.match_path(store, ["S:1", "p", None], limit=5), "n1") == first and stats.truncated and stats.truncated_hops == [0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    whole = traverse.MatchStats()
    assert traverse.match_path(store, ["S:1", "p", None], limit=60, stats=whole).count() == 60 and not whole.truncated


def test_pruning_changes_nothing(spark):
    rng = random.Random(1)
    store = from_triples(spark, sorted({(f"N:{rng.randrange(12)}", rng.choice("pq"), f"N:{rng.randrange(12)}") for _ in range(50)}))
    spec = ["N:1", None, None, "p", None, None, "N:2"]
    rows = [sorted(traverse.match_path(store, spec, limit=None, prune=p).collect()) for p in (True, False)]
    assert rows[0] == rows[1] and rows[0]


def test_hop_caps_name_the_hops_that_were_cut(spark):
    store = from_triples(spark, [("S:1", "p", f"T:{i}") for i in range(8)] + [(f"T:{i}", "q", f"U:{i}") for i in range(8)])
    stats = traverse.MatchStats()
    rows = traverse.match_path(store, ["S:1", "p", None, "q", None], limit=None, hop_cap=3, stats=stats).collect()
    assert sorted(r.n2 for r in rows) == ["U:0", "U:1", "U:2"] and stats.truncated and stats.truncated_hops == [0] and stats.hop_caps == [3]


def test_places_are_listed_from_pinned_ends(spark, monkeypatch):
    """With lists that are long enough, with ones that are not, and without: the same walks."""
    rng = random.Random(8)
    store = from_triples(spark, sorted({(f"N:{rng.randrange(15)}", rng.choice(["p", "q", "interacts_with"]), f"N:{rng.randrange(15)}") for _ in range(70)}), [(f"N:{i}", None, ["Even" if i % 2 == 0 else "Odd"]) for i in range(15)])
    specs = [["N:1", "p", None, "q", None], [None, None, {"category": "Even"}, None, "N:2"], [["N:1", "N:2"], None, {"category": "Odd"}, "p", None, None, "N:3"], [{"category": "Odd"}, "p", None, "q", None]]
    some = 0
    for spec in specs:
        for symmetric in (False, True):
            want = sorted(traverse.match_path(store, spec, None, prune=False, symmetric=symmetric).collect())
            some += bool(want)
            for longest, literals in ((10_000, 200), (10_000, 1), (3, 2)):
                monkeypatch.setattr(traverse, "FRONTIER", longest)
                monkeypatch.setattr(traverse, "LITERALS", literals)
                assert sorted(traverse.match_path(store, spec, None, symmetric=symmetric).collect()) == want
    assert some >= 6


@pytest.fixture(scope="module")
def random_graph(spark):
    rng = random.Random(4)
    triples = sorted({(f"N:{rng.randrange(9)}", rng.choice(["p", "q"]), f"N:{rng.randrange(9)}") for _ in range(24)})
    return triples, from_triples(spark, triples)


def simple_paths(triples, s, t, depth):
    out, todo = [], [(s, [], {s})]
    while todo:
        at, path, seen = todo.pop()
        if at == t:
            out.append(tuple(path))
        elif len(path) < depth:
            todo += [(o, [*path, (a, p, o)], seen | {o}) for a, p, o in triples if a == at and o not in seen]
    return sorted(out)


def test_paths_equal_brute_force(random_graph):
    triples, store = random_graph
    for s, t in (("N:0", "N:1"), ("N:2", "N:3"), ("N:4", "N:5")):
        want = simple_paths(triples, s, t, 4)
        got = sorted(tuple(tuple(e) for e in r.path) for r in paths.all_paths(store, s, t, max_depth=4).collect())
        assert got == want
        least = min((len(p) for p in simple_paths(triples, s, t, 9)), default=None)
        short = paths.all_shortest_paths(store, s, t).collect()
        assert {len(r.path) for r in short} == ({least} if least else set())
        nodes = {tuple(e[0] for e in p) for p in simple_paths(triples, s, t, 9) if len(p) == least}
        assert {tuple(e.subject for e in r.path) for r in short} == nodes
        one = paths.shortest_path(store, s, t)
        assert (one is None) == (least is None) and (one is None or len(one) == least)
    assert paths.shortest_path(store, "N:0", "N:0") == [] and paths.all_paths(store, "N:0", "N:0").first().path == []


def test_predicate_sequences(random_graph):
    triples, store = random_graph
    for s, t in itertools.product(("N:0", "N:2"), ("N:1", "N:3")):
        want = sorted({(s, b, t) for a, p, b in triples for c, q, d in triples if (a, p, c, q, d) == (s, "p", b, "q", t) and len({a, b, d}) == 3})
        assert sorted(tuple(r) for r in paths.paths_by_predicates(store, s, t, ["p", "q"]).collect()) == want


def test_components_and_levels(spark):
    store = from_triples(spark, [(f"C:{i:02}", "next", f"C:{i + 1:02}") for i in range(20)] + [("X:1", "p", "X:2"), ("X:3", "p", "X:2"), ("S:1", "p", "S:1")])
    got = {}
    for r in paths.components(store).collect():
        got.setdefault(r.component, set()).add(r.id)
    assert got == {"C:00": {f"C:{i:02}" for i in range(21)}, "X:1": {"X:1", "X:2", "X:3"}, "S:1": {"S:1"}}
    assert {r.id: r.depth for r in paths.reachable(store, "C:15").collect()} == {f"C:{15 + i}": i for i in range(6)}


def test_audit(spark):
    store = from_triples(spark, [("A:1", "subclass_of", "B:1"), ("B:1", "subclass_of", "A:1"), ("A:1", "subclass_of", "A:1"), ("A:1", "treats", "B:1"), ("A:1", "affects", "A:1"), ("A:1", "interacts_with", "B:1"), ("B:1", "same_as", "A:1"), ("A:1", "same_as", "B:1")])
    rows = {r.predicate: r for r in aggregates.audit(store).collect()}
    assert (rows["subclass_of"].directed, rows["subclass_of"].self_loops, rows["subclass_of"].mutual_pairs, rows["subclass_of"].recip_directed) == (3, 1, 1, 3)
    found = [(r.severity, r.predicate) for r in aggregates.findings(store).collect()]
    assert found == [("high", "subclass_of"), ("medium", "affects"), ("info", "interacts_with")]
    assert [(r.a, r.b) for r in aggregates.examples(store, 1).where("predicate = 'subclass_of'").collect()] == [("A:1", "B:1")]
