"""Releases: a graph built from an archive, verified by counts against its source, and published with a manifest.

Source and target may be on any file system that the cluster shares; a path without a scheme is on its default one. Files are
hashed by tasks, one file each; the driver sees their names and digests.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions.terms import bare_column, qualifier_fingerprint
from kgspark.sources import archive
from kgspark.sources.folders import qualified
from kgspark.sources.store import FORMAT_VERSION, GraphStore, variants


class ReleaseError(RuntimeError):
    """A gate that a release did not pass."""


def file_digest(fs: FileSystem, path: str) -> str:
    h = hashlib.sha256()
    with fs.open_input_stream(path, compression=None) as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def tree_digest(spark: SparkSession, path: str) -> str:
    """One SHA-256 over the relative names and digests of a folder's files."""
    uri = qualified(spark, path)
    fs, base = FileSystem.from_uri(uri)
    names = sorted(f.path[len(base) :].lstrip("/") for f in fs.get_file_info(FileSelector(base, recursive=True)) if f.type == FileType.File)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = FileSystem.from_uri(uri)
        for batch in batches:
            own = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([file_digest(fs, f"{base}/{n}") for n in own], pa.string())], ["name", "digest"])

    files = spark.createDataFrame([(n,) for n in names], "name string").repartition(max(1, min(len(names), spark.sparkContext.defaultParallelism * 4)))
    h = hashlib.sha256()
    for r in sorted(files.mapInArrow(run, "name string, digest string").collect()):
        h.update(r.name.encode() + b"\0" + r.digest.encode())
    return h.hexdigest()


def source_counts(rows: DataFrame) -> tuple[int, int, int]:
    """Edge records, distinct triples and distinct variants, counted anew from the source's JSON."""
    e = rows.where("kind = 'edge'").select(F.from_json("json", "subject string, predicate string, object string").alias("r"), F.from_json("json", "map<string,string>").alias("m")).where("r.subject <> '' AND r.predicate <> '' AND r.object <> ''")
    keyed = e.select("r.subject", bare_column(F.col("r.predicate")).alias("predicate"), "r.object", qualifier_fingerprint(F.col("m")).alias("fp"))
    return tuple(keyed.agg(F.count("*"), F.count_distinct("subject", "predicate", "object"), F.count_distinct("subject", "predicate", "object", "fp")).first())


def store_counts(store: GraphStore) -> tuple[int, int]:
    return tuple(store.edges.agg(F.count_distinct("subject", "predicate", "object"), F.count_distinct("subject", "predicate", "object", "qual_fp")).first())


def verify(store: GraphStore, records: int) -> None:
    """Distinct triples <= variants <= records, and an edge can be read."""
    triples, kinds = store_counts(store)
    if not triples <= kinds <= records:
        raise ReleaseError(f"{triples} triples, {kinds} variants and {records} records do not fit together")
    if store.edges.isEmpty():
        raise ReleaseError("no edge can be read")


def build(spark: SparkSession, path: str, target: str, graph_name: str = "graph", version: str = "1", gate_completeness: bool = True, force: bool = False) -> dict:
    """Builds in a folder beside the target, passes the gates, writes the manifest last, and renames. Returns the manifest."""
    path, target = qualified(spark, path), qualified(spark, target).rstrip("/")
    fs, at = FileSystem.from_uri(target)
    there = lambda x: fs.get_file_info(x).type != FileType.NotFound
    if there(at) and not force:
        raise ReleaseError(f"{target} exists")
    stage = f"{target}.building"
    if there(f"{at}.building"):
        fs.delete_dir(f"{at}.building")
    rows = archive.read_once(spark, path)
    loaded = archive.graph_of(rows, path)
    records, triples, kinds = source_counts(rows)
    GraphStore(loaded.nodes, variants(loaded.edges), loaded.manifest).save(stage)
    store = GraphStore.load(spark, stage)
    verify(store, records)
    if gate_completeness and store_counts(store) != (triples, kinds):
        raise ReleaseError(f"the source has {triples} triples and {kinds} variants, the store {store_counts(store)}")
    source_fs, source_at = FileSystem.from_uri(path)
    manifest = {
        "graph_name": graph_name, "version": version, "built_at": datetime.now(UTC).isoformat(), "source": path.rpartition("/")[2], "source_sha256": file_digest(source_fs, source_at), "source_bytes": source_fs.get_file_info(source_at).size,
        "store_format_version": FORMAT_VERSION, "biolink_version": loaded.manifest.get("biolink_version"), "node_count": store.graph_nodes.count(), "edge_count": triples, "source_record_count": records, "variant_count": kinds,
        "artifacts": {name: tree_digest(spark, f"{stage}/{name}") for name in ("nodes", "edges")},
    }
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{stage}/manifest")
    old = f"{at}.old"
    if there(old):
        fs.delete_dir(old)
    if replaced := there(at):
        fs.move(at, old)
    fs.move(f"{at}.building", at)
    if replaced:
        fs.delete_dir(old)
    return manifest
