"""Archives of node and edge records as a Spark data source: tar, gzip or zstd, local or at a URI, one task an archive."""

from __future__ import annotations

import json
import os
import tarfile
from collections.abc import Iterator
from typing import BinaryIO

from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kgspark.sources.folders import written
from kgspark.sources.store import GraphStore, from_json

SUFFIXES = (".tar.zst", ".tar.gz", ".tgz", ".tar")
MEMBERS = {"nodes.jsonl": "node", "edges.jsonl": "edge", "graph-metadata.json": "graph_metadata"}


def opened(path: str) -> BinaryIO:
    """A local path or a URI (file, hdfs, s3, gs ...), read as a stream."""
    if "://" not in path:
        return open(path, "rb")
    fs, at = FileSystem.from_uri(path)
    return fs.open_input_stream(at, compression=None)


def lines(path: str) -> Iterator[tuple[str, int, str]]:
    """(kind, line number, JSON) of an archive's members, found by their base names; blank lines are left out."""
    if not path.endswith(SUFFIXES):
        raise ValueError(f"{path}: an archive ends in one of {', '.join(SUFFIXES)}")
    with opened(path) as f:
        if path.endswith(".zst"):
            import zstandard

            tar = tarfile.open(fileobj=zstandard.ZstdDecompressor().stream_reader(f), mode="r|")
        else:
            tar = tarfile.open(fileobj=f, mode="r|*")
        with tar:
            for member in tar:
                kind = MEMBERS.get(os.path.basename(member.name))
                if not kind or not member.isfile():
                    continue
                stream = tar.extractfile(member)
                if kind == "graph_metadata":
                    yield kind, 0, stream.read().decode()
                    continue
                for n, line in enumerate(stream):
                    if line.strip():
                        yield kind, n, line.decode().strip()


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(",") if p]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from lines(partition.value)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kgx"

    def schema(self) -> str:
        return "kind string, seq long, json string"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """kind, seq, json of an archive or of several, separated by commas."""
    for p in path.split(","):
        if not p.endswith(SUFFIXES):
            raise ValueError(f"{p}: an archive ends in one of {', '.join(SUFFIXES)}")
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("kgx").option("path", path).load()


def read_once(spark: SparkSession, path: str) -> DataFrame:
    """What scan gives, as a table: one task unpacks an archive, once, and many read what it has written."""
    return written(scan(spark, path), "archive")


def graph_of(rows: DataFrame, path: str, predicates: list[str] | None = None, node_fields: list[str] | None = None, edge_fields: list[str] | None = None) -> GraphStore:
    """The graph of an archive's rows. Without an edge it is a ValueError."""
    store = from_json(rows.where("kind = 'node'"), rows.where("kind = 'edge'"), predicates, node_fields, edge_fields)
    if store.edges.isEmpty():
        raise ValueError(f"{path}: no edges")
    about = rows.where("kind = 'graph_metadata'").first()
    store.manifest = {"biolink_version": json.loads(about.json).get("biolinkVersion")} if about else {}
    return store


def load(spark: SparkSession, path: str, predicates: list[str] | None = None, node_fields: list[str] | None = None, edge_fields: list[str] | None = None) -> GraphStore:
    """A graph from an archive, or from several, separated by commas."""
    return graph_of(read_once(spark, path), path, predicates, node_fields, edge_fields)
