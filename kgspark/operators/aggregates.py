"""Counts, audits and comparisons over graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.functions.terms import SYMMETRIC
from kgspark.sources.store import GraphStore

#: Predicates that order a hierarchy, those that must not hold both ways round, and those that may.
ORDERING = ("subclass_of", "rdfs:subClassOf", "superclass_of")
ANTISYMMETRIC = (
    "part_of", "has_part", "located_in", "has_input", "has_output", "has_metabolite", "has_substrate", "causes", "caused_by", "predisposes_to_condition",
    "acts_upstream_of", "acts_upstream_of_or_within", "has_phenotype", "capable_of", "enables", "contributes_to",
)
PLAUSIBLE_BOTH_WAYS = ("affects", "regulates", "interacts_with")
PARTS = 64
SEVERITIES = ("high", "medium", "low", "info")


def predicate_counts(store: GraphStore) -> DataFrame:
    """predicate, records: raw edge records, repeats included."""
    return store.edges.groupBy("predicate").agg(F.count("*").alias("records"))


def category_counts(store: GraphStore, top: int | None = None) -> DataFrame:
    rows = store.node_category.groupBy("category").agg(F.count("*").alias("members"))
    return rows if top is None else rows.orderBy(F.desc("members"), "category").limit(top)


def sizes(store: GraphStore) -> DataFrame:
    """One row: node records, graph nodes, edge records, distinct triples, pairs and variants, and predicates.

    Distinct counts are nested group-bys, each on the rows that the one below has left.
    """
    variant = store.edges.groupBy("subject", "predicate", "object", "qual_fp").agg(F.count("*").alias("records"))
    triple = variant.groupBy("subject", "predicate", "object").agg(F.sum("records").alias("records"), F.count("*").alias("variants"))
    pair = triple.groupBy("subject", "object").agg(F.sum("records").alias("records"), F.sum("variants").alias("variants"), F.count("*").alias("triples"))
    parts = [
        pair.agg(F.sum("records").alias("records"), F.sum("triples").alias("triples"), F.count("*").alias("pairs"), F.sum("variants").alias("variants")),
        predicate_counts(store).agg(F.count("*").alias("predicates")), store.nodes.agg(F.count("*").alias("node_records")), store.graph_nodes.agg(F.count("*").alias("graph_nodes")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in out.columns])


def out_degree(store: GraphStore) -> DataFrame:
    """id, degree: distinct objects over all predicates."""
    return store.pairs.groupBy(F.col("subject").alias("id")).agg(F.count("*").alias("degree"))


def variant_histogram(store: GraphStore) -> DataFrame:
    """variants, triples: how many triples have so many sets of qualifiers."""
    per = store.edges.groupBy("subject", "predicate", "object").agg(F.count_distinct("qual_fp").alias("variants"))
    return per.groupBy("variants").agg(F.count("*").alias("triples"))


def unordered(store: GraphStore) -> DataFrame:
    """predicate, a, b, ways: pairs of ends in order, and how many ways round they are linked (a self loop: one)."""
    return store.triples.groupBy("predicate", F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b")).agg(F.count("*").alias("ways"))


def mutual(store: GraphStore) -> DataFrame:
    """predicate, subject, object of the triples whose reverse is there too; a self loop is its own."""
    both = unordered(store).where("ways = 2 OR a = b")
    ends = F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("o")), F.struct(F.col("b").alias("s"), F.col("a").alias("o")))
    return both.select("predicate", F.explode(F.array_distinct(ends)).alias("e")).select("predicate", F.col("e.s").alias("subject"), F.col("e.o").alias("object"))


def audit(store: GraphStore) -> DataFrame:
    """predicate, directed, self_loops, recip_directed, mutual_pairs, symmetric.

    recip_directed: triples whose reverse is there too (a self loop is its own); mutual_pairs: pairs of different nodes linked both ways.
    """
    loop, both = F.col("a") == F.col("b"), (F.col("a") != F.col("b")) & (F.col("ways") == 2)
    stats = unordered(store).groupBy("predicate").agg(F.sum("ways").alias("directed"), F.count_if(loop).alias("self_loops"), F.count_if(both).alias("mutual_pairs"))
    return stats.withColumns({"recip_directed": 2 * F.col("mutual_pairs") + F.col("self_loops"), "symmetric": F.col("predicate").isin(sorted(SYMMETRIC))})


def findings(store: GraphStore) -> DataFrame:
    """The audit's predicates that need a look, with severity and category, the most severe first."""
    loops, mutual = F.col("self_loops") > 0, F.col("mutual_pairs") > 0
    stored_both_ways = F.col("recip_directed") >= 0.999 * F.col("directed")
    wrong = F.col("predicate").isin(*ORDERING, *ANTISYMMETRIC)
    severity = (
        F.when(F.col("symmetric"), F.when(~stored_both_ways, "info"))
        .when(~loops & ~mutual, None).when(wrong, "high")
        .when(F.col("predicate").isin(*PLAUSIBLE_BOTH_WAYS), F.when(mutual, "low").otherwise("medium"))
        .otherwise(F.when(mutual, "medium").otherwise("low"))
    )
    category = (
        F.when(F.col("symmetric"), "symmetric but stored one way").when(F.col("predicate").isin(*ORDERING), "cycle or loop in a hierarchy")
        .when(wrong, "antisymmetric but both ways").when(F.col("predicate").isin(*PLAUSIBLE_BOTH_WAYS), "plausible both ways").otherwise("unexpectedly both ways")
    )
    rows = audit(store).withColumn("severity", severity).where("severity IS NOT NULL").withColumn("category", category)
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return rows.orderBy(rank, F.desc(F.col("mutual_pairs") + F.col("self_loops")), "predicate")


def examples(store: GraphStore, per_predicate: int = 10) -> DataFrame:
    """predicate, a, b: up to so many mutual pairs of each predicate in order, then self loops (a = b).

    Ranks are taken in parts of each predicate first, so one predicate's pairs do not meet in a task but for the first of each part.
    """
    odd = unordered(store).where("(a <> b AND ways = 2) OR a = b").withColumn("loop", F.col("a") == F.col("b"))
    for part in (["predicate", F.pmod(F.xxhash64("a", "b"), F.lit(PARTS))], ["predicate"]):
        odd = odd.withColumn("k", F.row_number().over(W.partitionBy(*part).orderBy("loop", "a", "b"))).where(F.col("k") <= per_predicate)
    return odd.select("predicate", "a", "b")


def answer_sets(bindings: DataFrame, columns: list[str]) -> DataFrame:
    """qnode, id: the distinct answers of each query node."""
    return bindings.select(F.explode(F.array(*[F.struct(F.lit(c).alias("qnode"), F.col(c).alias("id")) for c in columns])).alias("x")).select("x.*").distinct()


def compare_answers(left: DataFrame, right: DataFrame) -> DataFrame:
    """qnode, shared, only_left, only_right of two tables of answer sets."""
    both = left.withColumn("l", F.lit(1)).join(right.withColumn("r", F.lit(1)), ["qnode", "id"], "full")
    return both.groupBy("qnode").agg(F.count_if(F.expr("l = 1 AND r = 1")).alias("shared"), F.count_if(F.expr("r IS NULL")).alias("only_left"), F.count_if(F.expr("l IS NULL")).alias("only_right"))
