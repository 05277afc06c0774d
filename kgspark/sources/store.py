"""A graph as tables: nodes and edges, and the tables that follow from them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions.terms import bare, bare_column, qualifier_fingerprint

NODE = "id string, name string, category array<string>, extra string"
EDGE = "seq long, subject string, predicate string, object string, knowledge_level string, agent_type string, qualifiers map<string,string>, extra string"
EDGE_COLUMNS = (*(c.split()[0] for c in EDGE.split(", ")), "qual_fp")
FORMAT_VERSION = 3


@dataclass
class GraphStore:
    """nodes: id, name, category, extra (JSON); edges: EDGE and qual_fp. Predicates and categories are without the model's prefix."""

    nodes: DataFrame
    edges: DataFrame
    manifest: dict = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @cached_property
    def triples(self) -> DataFrame:
        """Distinct subject, predicate, object."""
        return self.edges.select("subject", "predicate", "object").distinct()

    @cached_property
    def pairs(self) -> DataFrame:
        """Distinct subject, object over all predicates."""
        return self.edges.select("subject", "object").distinct()

    @cached_property
    def graph_nodes(self) -> DataFrame:
        """The ids at the ends of edges; records without an edge are not in the graph."""
        return self.edges.select(F.explode(F.array("subject", "object")).alias("id")).distinct()

    @cached_property
    def node_category(self) -> DataFrame:
        return self.nodes.select("id", F.explode("category").alias("category")).distinct()

    @cached_property
    def representative(self) -> DataFrame:
        """The first predicate in order of arrival for each pair of ends (by name where nothing orders them)."""
        return self.edges.groupBy("subject", "object").agg(F.min_by("predicate", F.struct("seq", "predicate")).alias("predicate"))

    def save(self, path: str) -> None:
        """Edges in folders by predicate and batch, in files sorted by subject, so filters on either skip what they do not need; the manifest beside them."""
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        save_edges(self.edges, path, 0)
        text = json.dumps(self.manifest | {"store_format_version": FORMAT_VERSION})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    def hold(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> GraphStore:
        """The same graph, its tables kept where the level says once they are read; what does not fit in memory goes to disk."""
        return GraphStore(self.nodes.persist(level), self.edges.persist(level), self.manifest)

    def bytes_by_table(self) -> dict[str, int]:
        """What the planner takes each table to hold; nothing is read."""
        return {name: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for name, df in (("nodes", self.nodes), ("edges", self.edges))}

    @staticmethod
    def load(spark: SparkSession, path: str) -> GraphStore:
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
        if manifest.get("store_format_version") != FORMAT_VERSION:
            raise ValueError(f"store format {manifest.get('store_format_version')} is not {FORMAT_VERSION}")
        return GraphStore(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges").select(*EDGE_COLUMNS), manifest)


def save_edges(edges: DataFrame, path: str, batch: int) -> None:
    """Writes or replaces one batch of a saved graph's edges; number 0 is the graph as it was saved and takes the place of all others."""
    rows = edges.withColumn("batch", F.lit(batch).cast("long")).repartitionByRange("predicate", "subject").sortWithinPartitions("predicate", "subject")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if batch else "static").partitionBy("predicate", "batch").parquet(f"{path}/edges")


def from_triples(spark: SparkSession, triples: list[tuple[str, str, str]], nodes: list[tuple] = ()) -> GraphStore:
    """A graph from triples, and from (id, name, categories, extra dict) for nodes."""
    if not triples:
        raise ValueError("a graph needs a triple")
    return from_records(spark, [{"id": n[0], "name": n[1], "category": list(n[2]), **(n[3] if len(n) > 3 else {})} for n in nodes], [{"subject": s, "predicate": p, "object": o} for s, p, o in triples])


def from_records(spark: SparkSession, nodes: list[dict], edges: list[dict]) -> GraphStore:
    """A graph from node and edge records as archives hold them."""
    node_rows = spark.createDataFrame([(json.dumps(n), i) for i, n in enumerate(nodes)], "json string, seq long")
    edge_rows = spark.createDataFrame([(json.dumps(e), i) for i, e in enumerate(edges)], "json string, seq long")
    return from_json(node_rows, edge_rows)


def from_json(nodes: DataFrame, edges: DataFrame, predicates: list[str] | None = None, node_fields: list[str] | None = None, edge_fields: list[str] | None = None) -> GraphStore:
    """A graph from tables of JSON records (json, seq); of records with one key, the last counts.

    predicates: keep these only. node_fields, edge_fields: other fields to keep (None: all). Records without their keys are left out.
    """
    n = nodes.select("seq", F.from_json("json", "id string, name string").alias("r"), F.from_json("json", "category array<string>").alias("c"), F.from_json("json", "category string").alias("c1"), F.from_json("json", "map<string,string>").alias("m"))
    category = F.coalesce("c.category", F.when(F.col("c1.category").isNotNull(), F.array("c1.category")), F.array().cast("array<string>"))
    extra = F.map_filter("m", lambda k, v: ~k.isin("id", "name", "category") & (k.isin(node_fields) if node_fields is not None else F.lit(True)))
    rows = n.where("r.id IS NOT NULL AND r.id <> ''").select(F.col("r.id").alias("id"), F.struct(F.col("r.name").alias("name"), F.transform(category, bare_column).alias("category"), F.when(F.size(extra) > 0, F.to_json(extra)).alias("extra")).alias("v"), "seq")
    out_nodes = rows.groupBy("id").agg(F.max_by("v", "seq").alias("v")).select("id", "v.name", "v.category", "v.extra")
    core = ("subject", "predicate", "object", "knowledge_level", "agent_type")
    e = edges.select("seq", F.from_json("json", ", ".join(f"{c} string" for c in core)).alias("r"), F.from_json("json", "map<string,string>").alias("m")).where("r.subject <> '' AND r.predicate <> '' AND r.object <> ''")
    wanted = F.lit(True) if edge_fields is None else F.lit(False)
    qualifier = F.map_filter("m", lambda k, v: F.contains(k, F.lit("qualifier")) | (k == "qualified_predicate"))
    rest = F.map_filter("m", lambda k, v: ~k.isin(*core) & ~F.contains(k, F.lit("qualifier")) & (k != "qualified_predicate") & (wanted | k.isin(edge_fields or [])))
    full = e.select("seq", "r.subject", bare_column(F.col("r.predicate")).alias("predicate"), "r.object", "r.knowledge_level", "r.agent_type", qualifier.alias("qualifiers"), F.when(F.size(rest) > 0, F.to_json(rest)).alias("extra"))
    full = full.withColumn("qual_fp", qualifier_fingerprint(F.col("qualifiers")))
    return GraphStore(out_nodes, full if predicates is None else full.where(F.col("predicate").isin([bare(p) for p in predicates])))


def variants(edges: DataFrame) -> DataFrame:
    """One row for each triple and qualifier fingerprint: the last that arrived."""
    key = ["subject", "predicate", "object", "qual_fp"]
    rest = [c for c in edges.columns if c not in key]
    return edges.groupBy(*key).agg(F.max_by(F.struct(*rest), "seq").alias("v")).select(*key, "v.*").select(*edges.columns)
