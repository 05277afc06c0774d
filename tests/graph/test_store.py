import gzip
import io
import json
import os
import tarfile

import pytest
import zstandard

from kgspark.operators import metadata as m
from kgspark.sources import archive, release
from kgspark.sources.store import GraphStore, from_records, from_triples, variants

NODES = [{"id": "A:1", "name": "a", "category": ["biolink:Gene"], "x": 1}, {"id": "B:1", "name": "b", "category": "biolink:Disease"}, {"name": "no id"}, {"id": "A:1", "name": "later", "category": ["biolink:Gene"]}]
EDGES = [{"subject": "A:1", "predicate": "biolink:causes", "object": "B:1", "object_aspect_qualifier": q} for q in ("x", "y", "x")] + [{"subject": "A:1", "predicate": "", "object": "B:1"}, {"subject": "B:1", "predicate": "rdfs:seeAlso", "object": "A:1"}]


def archive_at(path, nodes=NODES, edges=EDGES):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as tar:
        for name, text in (("deep/nodes.jsonl", "\n\n".join(map(json.dumps, nodes))), ("deep/edges.jsonl", "\n".join(map(json.dumps, edges)) + "\n"), ("graph-metadata.json", '{"biolinkVersion": "4.3.7"}'), ("other.txt", "x")):
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            tar.addfile(info, io.BytesIO(text.encode()))
    data = raw.getvalue()
    data = zstandard.compress(data) if path.endswith(".zst") else gzip.compress(data) if path.endswith("gz") else data
    with open(path, "wb") as f:
        f.write(data)
    return path


@pytest.mark.parametrize("suffix", [".tar", ".tar.gz", ".tgz", ".tar.zst"])
def test_archives(spark, tmp_path, suffix):
    store = archive.load(spark, archive_at(f"{tmp_path}/g{suffix}"))
    assert store.edges.count() == 4 and store.triples.count() == 2 and variants(store.edges).count() == 3
    assert {(r.id, r.name, tuple(r.category)) for r in store.nodes.collect()} == {("A:1", "later", ("Gene",)), ("B:1", "b", ("Disease",))}
    assert {r.predicate for r in store.triples.collect()} == {"causes", "rdfs:seeAlso"}
    assert store.manifest["biolink_version"] == "4.3.7"


def test_archive_filters_and_errors(spark, tmp_path):
    path = archive_at(f"{tmp_path}/g.tar")
    assert archive.load(spark, path, predicates=["biolink:causes"]).triples.count() == 1
    with pytest.raises(ValueError):
        archive.load(spark, path, predicates=["biolink:none"])
    with pytest.raises(ValueError):
        archive.scan(spark, f"{tmp_path}/g.zip")
    with pytest.raises(ValueError):
        from_triples(spark, [])
    kept = archive.load(spark, archive_at(f"{tmp_path}/h.tar", [{"id": "A:1", "x": 1, "y": 2}]), node_fields=["x"])
    assert json.loads(kept.nodes.first().extra) == {"x": "1"}


def test_save_and_load(spark, tmp_path, synthetic):
    synthetic.save(f"{tmp_path}/s")
    back = GraphStore.load(spark, f"{tmp_path}/s")
    assert sorted(back.triples.collect()) == sorted(synthetic.triples.collect()) and back.nodes.count() == 5
    plan = back.edges.where("predicate = 'causes'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(predicate" in plan
    spark.createDataFrame([('{"store_format_version": 1}',)], "value string").write.mode("overwrite").text(f"{tmp_path}/s/manifest")
    with pytest.raises(ValueError):
        GraphStore.load(spark, f"{tmp_path}/s")


def test_release(spark, tmp_path):
    path, target = archive_at(f"{tmp_path}/g.tar.zst"), f"{tmp_path}/release"
    manifest = release.build(spark, path, target, "test", "1")
    assert (manifest["source_record_count"], manifest["edge_count"], manifest["variant_count"], manifest["node_count"]) == (4, 2, 3, 2)
    assert GraphStore.load(spark, target).manifest["biolink_version"] == "4.3.7" and not os.path.exists(f"{target}.building")
    assert manifest["artifacts"]["edges"] == release.tree_digest(spark, f"{target}/edges")
    with pytest.raises(release.ReleaseError):
        release.build(spark, path, target)
    assert release.build(spark, path, target, force=True)["edge_count"] == 2
    with pytest.raises(release.ReleaseError):
        release.verify(GraphStore.load(spark, target), 2)


def test_lookups(spark, synthetic, qualified):
    assert m.node(synthetic, "LAKE:2") == {"id": "LAKE:2", "name": "Thun shore, upper", "category": ["biolink:Lake", "biolink:Basin"]}
    assert m.node(synthetic, "NONE:1") == {} and m.edge(synthetic, "A", "b", "C") == {}
    assert m.edge(synthetic, "LAKE:1", "supplies", "TOWN:1")["seasonal"] == "true"
    found = m.edge_variants(qualified, "A:1", "biolink:affects", "B:1")
    assert {v["object_direction_qualifier"] for v in found} == {"increased", "decreased"} and m.edge(qualified, "A:1", "affects", "B:1") == found[0]
    ids = spark.createDataFrame([("LAKE:1",), ("LAKE:2",), ("RIVER:1",), ("NONE:1",)], "id string")
    get = lambda df: {r.id for r in df.collect()}
    assert get(m.filter_nodes(synthetic, ids, "biolink:Lake")) == {"LAKE:1", "LAKE:2"}
    assert get(m.filter_nodes(synthetic, ids, extra_filters={"length": 288})) == {"RIVER:1"}
    assert get(m.filter_nodes(synthetic, ids, extra_filters={"length": None})) == {"LAKE:1", "LAKE:2"}
    assert get(m.nodes_by_category(synthetic, "Lake", 1)) == {"LAKE:1"}
    asked = spark.createDataFrame([("RIVER:1", None, "LAKE:1"), ("LAKE:1", "supplies", "TOWN:1"), ("LAKE:1", "feeds", "TOWN:1")], "subject string, predicate string, object string")
    assert {r.object for r in m.filter_edges(synthetic, asked).collect()} == {"LAKE:1", "TOWN:1"}
    assert m.filter_edges(synthetic, asked, agent_type="model").count() == 0
    assert {r.object for r in m.filter_edges(synthetic, asked, extra_filters={"seasonal": True}).collect()} == {"TOWN:1"}
    assert m.has_edge(synthetic, "RIVER:1", "LAKE:1") and not m.has_edge(synthetic, "RIVER:1", "LAKE:1", "supplies") and not m.has_edge(synthetic, "X", "Y")
    assert [r.predicate for r in m.edges_between(synthetic, "LAKE:1", "TOWN:1").collect()] == ["biolink:supplies"]


def test_fingerprints(qualified):
    import hashlib

    got = {r.qual_fp for r in qualified.edges.collect()}
    text = '{"object_aspect_qualifier":"activity","object_direction_qualifier":"increased"}'
    assert hashlib.sha1(text.encode()).hexdigest()[:10] in got and len(got) == 3


def test_last_record_counts(spark):
    store = from_records(spark, [], [{"subject": "A:1", "predicate": "p", "object": "B:1", "agent_type": t} for t in ("first", "last")])
    assert [r.agent_type for r in variants(store.edges).collect()] == ["last"]
