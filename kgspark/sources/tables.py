"""A graph from the driver's star schema, and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions.terms import qualifier_fingerprint
from kgspark.sources.store import GraphStore


def curie(prefix: str, key: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string"))


def _nodes(t: DataFrame, prefix: str, key: str, name: str | None, category: str) -> DataFrame:
    return t.select(curie(prefix, key).alias("id"), (F.col(name) if name else F.lit(None)).cast("string").alias("name"), F.array(F.lit(category)).alias("category"), F.lit(None).cast("string").alias("extra"))


def _edges(t: DataFrame, subject: Column, predicate: str, obj: Column, level: Column | str | None = None, agent: Column | str | None = None, qualifiers: Column | None = None, extra: Column | None = None) -> DataFrame:
    text = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("string")
    none = F.lit(None).cast("map<string,string>")
    return t.select(F.lit(0).cast("long").alias("seq"), subject.alias("subject"), F.lit(predicate).alias("predicate"), obj.alias("object"), text(level).alias("knowledge_level"), text(agent).alias("agent_type"), (none if qualifiers is None else qualifiers).alias("qualifiers"), (F.lit(None).cast("string") if extra is None else extra).alias("extra"))


def graph(spark: SparkSession, sf_dir: str, island: bool = False) -> GraphStore:
    """Regions, nations, customers, suppliers, parts, orders, brands and part types; with island, users and event types too.

    Some nations regulate and derive from each other, and some are part of themselves, so that audits find something.
    Rows have no order of arrival, so seq is 0 and a pair's first predicate is the first by name.
    """
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    nodes = [
        _nodes(t["region"], "REGION", "r_regionkey", "r_name", "Region"), _nodes(t["nation"], "NATION", "n_nationkey", "n_name", "Nation"),
        _nodes(t["customer"], "CUST", "c_custkey", "c_name", "Customer"), _nodes(t["supplier"], "SUPP", "s_suppkey", "s_name", "Supplier"),
        _nodes(t["part"], "PART", "p_partkey", "p_name", "Part"), _nodes(t["orders"], "ORDER", "o_orderkey", "o_orderpriority", "Order"),
        _nodes(t["part"].select("p_brand").distinct(), "BRAND", "p_brand", "p_brand", "Brand"), _nodes(t["part"].select("p_type").distinct(), "PTYPE", "p_type", "p_type", "PartType"),
    ]
    a, b = (t["nation"].select(F.col("n_nationkey").alias(k), F.col("n_regionkey").alias("r")) for k in ("a", "b"))
    near = a.join(F.broadcast(b), "r").where("a < b")  # 25 nations
    qualifiers = F.create_map(F.lit("object_direction_qualifier"), F.col("l_returnflag"), F.lit("object_aspect_qualifier"), F.col("l_linestatus"))
    edges = [
        _edges(t["nation"], curie("NATION", "n_nationkey"), "subclass_of", curie("REGION", "n_regionkey")),
        _edges(t["part"], curie("PART", "p_partkey"), "subclass_of", curie("PTYPE", "p_type")),
        _edges(t["customer"], curie("CUST", "c_custkey"), "located_in", curie("NATION", "c_nationkey"), "assertion", F.col("c_mktsegment")),
        _edges(t["supplier"], curie("SUPP", "s_suppkey"), "located_in", curie("NATION", "s_nationkey"), "assertion", "manual", extra=F.to_json(F.struct(F.col("s_acctbal").alias("balance")))),
        _edges(t["orders"], curie("CUST", "o_custkey"), "places", curie("ORDER", "o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")),
        _edges(t["lineitem"], curie("ORDER", "l_orderkey"), "contains", curie("PART", "l_partkey"), F.col("l_returnflag"), F.col("l_linestatus")),
        _edges(t["lineitem"], curie("SUPP", "l_suppkey"), "affects", curie("PART", "l_partkey"), "observation", "automated", qualifiers),
        _edges(t["part"], curie("PART", "p_partkey"), "has_brand", curie("BRAND", "p_brand"), "assertion", "manual"),
        _edges(near, curie("NATION", "a"), "interacts_with", curie("NATION", "b"), "prediction", "computed"),
        *(_edges(near.where("(a + b) % 2 = 0"), curie("NATION", x), "regulates", curie("NATION", y)) for x, y in ("ab", "ba")),
        *(_edges(near.where("(a * b) % 3 = 0"), curie("NATION", x), "derives_from", curie("NATION", y)) for x, y in ("ab", "ba")),
        _edges(t["nation"].where("n_nationkey % 5 = 0"), curie("NATION", "n_nationkey"), "part_of", curie("NATION", "n_nationkey")),
    ]
    if island:
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        nodes += [_nodes(events.select("user_id").distinct(), "USER", "user_id", None, "User"), _nodes(events.select("event_type").distinct(), "EVTYPE", "event_type", "event_type", "EventType")]
        edges.append(_edges(events, curie("USER", "user_id"), "performs", curie("EVTYPE", "event_type"), "observation", "automated"))

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    return GraphStore(union(nodes), union(edges).withColumn("qual_fp", qualifier_fingerprint(F.col("qualifiers"))))


#: The graph's tables in SQL: n(id, name, category), e(subject, predicate, object, knowledge_level, agent_type, direction, aspect), t (distinct triples).
SQL = """n AS (
  SELECT 'REGION:' || CAST(r_regionkey AS VARCHAR) AS id, r_name AS name, 'Region' AS category FROM region
  UNION ALL SELECT 'NATION:' || CAST(n_nationkey AS VARCHAR), n_name, 'Nation' FROM nation
  UNION ALL SELECT 'CUST:' || CAST(c_custkey AS VARCHAR), c_name, 'Customer' FROM customer
  UNION ALL SELECT 'SUPP:' || CAST(s_suppkey AS VARCHAR), s_name, 'Supplier' FROM supplier
  UNION ALL SELECT 'PART:' || CAST(p_partkey AS VARCHAR), p_name, 'Part' FROM part
  UNION ALL SELECT 'ORDER:' || CAST(o_orderkey AS VARCHAR), o_orderpriority, 'Order' FROM orders
  UNION ALL SELECT DISTINCT 'BRAND:' || p_brand, p_brand, 'Brand' FROM part
  UNION ALL SELECT DISTINCT 'PTYPE:' || p_type, p_type, 'PartType' FROM part),
e AS (
  SELECT 'NATION:' || CAST(n_nationkey AS VARCHAR) AS subject, 'subclass_of' AS predicate, 'REGION:' || CAST(n_regionkey AS VARCHAR) AS object,
    CAST(NULL AS VARCHAR) AS knowledge_level, CAST(NULL AS VARCHAR) AS agent_type, CAST(NULL AS VARCHAR) AS direction, CAST(NULL AS VARCHAR) AS aspect FROM nation
  UNION ALL SELECT 'PART:' || CAST(p_partkey AS VARCHAR), 'subclass_of', 'PTYPE:' || p_type, NULL, NULL, NULL, NULL FROM part
  UNION ALL SELECT 'CUST:' || CAST(c_custkey AS VARCHAR), 'located_in', 'NATION:' || CAST(c_nationkey AS VARCHAR), 'assertion', c_mktsegment, NULL, NULL FROM customer
  UNION ALL SELECT 'SUPP:' || CAST(s_suppkey AS VARCHAR), 'located_in', 'NATION:' || CAST(s_nationkey AS VARCHAR), 'assertion', 'manual', NULL, NULL FROM supplier
  UNION ALL SELECT 'CUST:' || CAST(o_custkey AS VARCHAR), 'places', 'ORDER:' || CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority, NULL, NULL FROM orders
  UNION ALL SELECT 'ORDER:' || CAST(l_orderkey AS VARCHAR), 'contains', 'PART:' || CAST(l_partkey AS VARCHAR), l_returnflag, l_linestatus, NULL, NULL FROM lineitem
  UNION ALL SELECT 'SUPP:' || CAST(l_suppkey AS VARCHAR), 'affects', 'PART:' || CAST(l_partkey AS VARCHAR), 'observation', 'automated', l_returnflag, l_linestatus FROM lineitem
  UNION ALL SELECT 'PART:' || CAST(p_partkey AS VARCHAR), 'has_brand', 'BRAND:' || p_brand, 'assertion', 'manual', NULL, NULL FROM part
  UNION ALL SELECT 'NATION:' || CAST(a.n_nationkey AS VARCHAR), 'interacts_with', 'NATION:' || CAST(b.n_nationkey AS VARCHAR), 'prediction', 'computed', NULL, NULL
    FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey
  UNION ALL SELECT 'NATION:' || CAST(a.n_nationkey AS VARCHAR), 'regulates', 'NATION:' || CAST(b.n_nationkey AS VARCHAR), NULL, NULL, NULL, NULL
    FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey AND (a.n_nationkey + b.n_nationkey) % 2 = 0
  UNION ALL SELECT 'NATION:' || CAST(a.n_nationkey AS VARCHAR), 'derives_from', 'NATION:' || CAST(b.n_nationkey AS VARCHAR), NULL, NULL, NULL, NULL
    FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey AND (a.n_nationkey * b.n_nationkey) % 3 = 0
  UNION ALL SELECT 'NATION:' || CAST(n_nationkey AS VARCHAR), 'part_of', 'NATION:' || CAST(n_nationkey AS VARCHAR), NULL, NULL, NULL, NULL FROM nation WHERE n_nationkey % 5 = 0),
t AS (SELECT DISTINCT subject, predicate, object FROM e)"""
#: With the events: users and event types form an island.
ISLAND_SQL = SQL.replace(
    "),\nt AS", "\n  UNION ALL SELECT 'USER:' || CAST(user_id AS VARCHAR), 'performs', 'EVTYPE:' || event_type, 'observation', 'automated', NULL, NULL FROM events),\nt AS"
).replace("FROM part),\ne AS", "FROM part\n  UNION ALL SELECT DISTINCT 'USER:' || CAST(user_id AS VARCHAR), NULL, 'User' FROM events\n  UNION ALL SELECT DISTINCT 'EVTYPE:' || event_type, event_type, 'EventType' FROM events),\ne AS")
