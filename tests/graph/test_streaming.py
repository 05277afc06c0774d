import json

from kgspark.sources.store import GraphStore, save_edges
from kgspark.streaming import ingest


def test_append_to_a_saved_graph(spark, tmp_path, synthetic):
    """Batches stand beside the saved edges in one layout; one that is run again takes its own place."""
    source, saved = tmp_path / "in", f"{tmp_path}/graph"
    source.mkdir()
    synthetic.save(saved)
    for k in range(2):
        (source / f"{k}.jsonl").write_text("\n".join(json.dumps({"subject": f"A:{k}{i}", "predicate": p, "object": "B:1"}) for i, p in enumerate(["biolink:feeds", "biolink:feeds", "biolink:crosses"])))
        ingest.append_edges(spark, str(source), saved, f"{tmp_path}/check").awaitTermination()
    store = GraphStore.load(spark, saved)
    assert {r.predicate: r["count"] for r in store.edges.groupBy("predicate").count().collect()} == {"feeds": 6, "supplies": 1, "lies_on": 1, "crosses": 2}
    save_edges(store.edges.where("subject LIKE 'A:1%'"), saved, 2)
    again = GraphStore.load(spark, saved)
    assert again.triples.count() == 10 and again.edges.count() == 10 and again.edges.columns == synthetic.edges.columns
    assert again.nodes.count() == 5


def test_windowed_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"ts": f"2024-01-01T0{h}:10:00Z", "predicate": "p"}) for h in (1, 1, 2, 5)))
    rows = ingest.edge_counts(spark, str(tmp_path / "in"), "ts timestamp, predicate string", "ts")
    rows.writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.records for r in spark.table("counts").collect()) == [1, 2]
