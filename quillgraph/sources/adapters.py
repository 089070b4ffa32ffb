"""Relational tables as graphs: keys become nodes, foreign keys edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.build import Graph
from quillgraph.session import table

# Table, key, label column; and child table, key, parent kind, parent key, relation.
NODE_TABLES = (
    ("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"),
    ("part", "p_partkey", "p_name"),
)
LINKS = (
    ("nation", "n_nationkey", "region", "n_regionkey", "belongs_to"), ("customer", "c_custkey", "nation", "c_nationkey", "belongs_to"),
    ("supplier", "s_suppkey", "nation", "s_nationkey", "belongs_to"),
)


def key(kind: str, column: str):
    return F.concat(F.lit(kind + ":"), F.col(column).cast("string"))


def trade_graph(spark: SparkSession, folder: str) -> Graph:
    """Regions, nations, customers, suppliers and parts; who belongs where, and who supplies what (weight: order lines)."""
    nodes, edges = None, None
    for t, k, label in NODE_TABLES:
        rows = table(spark, folder, t).select(key(t, k).alias("id"), F.col(label).alias("label"), F.lit(t).alias("kind"))
        nodes = rows if nodes is None else nodes.unionByName(rows)
    for t, k, parent, fk, relation in LINKS:
        rows = table(spark, folder, t).select(key(t, k).alias("src"), key(parent, fk).alias("dst"), F.lit(relation).alias("relation"), F.lit(1).cast("bigint").alias("weight"))
        edges = rows if edges is None else edges.unionByName(rows)
    lines = table(spark, folder, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("weight"))
    supplies = lines.select(key("supplier", "l_suppkey").alias("src"), key("part", "l_partkey").alias("dst"), F.lit("supplies").alias("relation"), "weight")
    return Graph(nodes, edges.unionByName(supplies))


def co_ordered(spark: SparkSession, folder: str) -> DataFrame:
    """(src, dst, weight): parts that were ordered together, by number of orders. An order has at most a handful of lines."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey").distinct()
    pairs = lines.select("l_orderkey", F.col("l_partkey").alias("a")).join(lines.select("l_orderkey", F.col("l_partkey").alias("b")), "l_orderkey").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight")).select(F.concat(F.lit("part:"), "a").alias("src"), F.concat(F.lit("part:"), "b").alias("dst"), "weight")


def event_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Events as signals on nodes: purchases are useful, errors dead ends."""
    outcome = F.when(F.col("event_type") == "purchase", "useful").when(F.col("event_type") == "error", "dead_end").otherwise("unmarked")
    return table(spark, folder, "events").select(F.concat(F.lit("user:"), "user_id").alias("node"), outcome.alias("outcome"), F.col("ts").alias("at"), F.date_format("ts", "EEE").alias("area"))
