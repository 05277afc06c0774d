import pytest

from kgspark.sources.store import from_records, from_triples


@pytest.fixture(scope="session")
def synthetic(spark):
    """A river that feeds two lakes, one of which supplies a town while the other has a village on it, with metadata."""
    waters = [("RIVER:1", "Aare", ["River"]), ("LAKE:1", "Thun", ["Lake"]), ("LAKE:2", "Thun shore, upper", ["Lake", "Basin"]), ("TOWN:1", "Bern", ["Town"]), ("TOWN:2", "Spiez", ["Village"])]
    nodes = [{"id": i, "name": name, "category": [f"biolink:{c}" for c in kinds]} | ({"length": "288"} if i == "RIVER:1" else {}) for i, name, kinds in waters]
    known = [("RIVER:1", "feeds", "LAKE:1", "measured", "gauge"), ("RIVER:1", "feeds", "LAKE:2", "modelled", "model"), ("LAKE:1", "supplies", "TOWN:1", "measured", "gauge"), ("TOWN:2", "lies_on", "LAKE:2", "surveyed", "map")]
    edges = [{"subject": s, "predicate": f"biolink:{p}", "object": o, "knowledge_level": level, "agent_type": agent} | ({"seasonal": True} if p == "supplies" else {}) for s, p, o, level, agent in known]
    return from_records(spark, nodes, edges)


@pytest.fixture(scope="session")
def qualified(spark):
    """One triple asserted with two sets of qualifiers, and one more."""
    q = lambda d, a: {"object_direction_qualifier": d, "object_aspect_qualifier": a}
    edges = [{"subject": "A:1", "predicate": "biolink:affects", "object": "B:1"} | q("increased", "activity"), {"subject": "A:1", "predicate": "biolink:affects", "object": "B:1"} | q("decreased", "abundance"), {"subject": "A:1", "predicate": "biolink:affects", "object": "B:2"} | q("increased", "abundance")]
    return from_records(spark, [], edges)


@pytest.fixture(scope="session")
def hierarchy(spark):
    """leaf below mid below root, a cycle beside it, a foreign predicate, and treatments at each level."""
    return from_triples(
        spark,
        [("LEAF:1", "biolink:subclass_of", "MID:1"), ("MID:1", "rdfs:subClassOf", "ROOT:1"), ("ROOT:1", "subclass_of", "LOOP:1"), ("LOOP:1", "subclass_of", "ROOT:1"), ("D:1", "treats", "LEAF:1"), ("D:2", "treats", "MID:1"), ("D:3", "treats", "ROOT:1")],
        [("LEAF:1", "leaf", ["Disease"]), ("MID:1", "mid", ["PhenotypicFeature"]), ("ROOT:1", "root", ["Disease"])],
    )
