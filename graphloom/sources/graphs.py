"""Edge lists bound to the project's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.edges import IDENTITY, canonical_edges, logical_edge_id, with_inverse
from graphloom.session import cut
from graphloom.sources.tables import table


def memory_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Seeds and edges of ``kg_edges_by_src``: every source whose number is divisible by 50, and the logical edges with their inverses.

    ``(query_id, graph_id, seed_id)`` and ``(*IDENTITY, edge_id)``. The edges
    are made once and written, so that no hop makes them anew; inverses and ids
    are made of those that a hop reads.
    """
    forward = cut(canonical_edges(table(spark, folder, "kg_edges_by_src")).select(*IDENTITY), "canonical")
    return memory_seeds(forward), with_inverse(forward).withColumn("edge_id", logical_edge_id())


def memory_seeds(edges: DataFrame) -> DataFrame:
    """Every source whose number is divisible by 50: ``(query_id, graph_id, seed_id)``."""
    number = F.regexp_extract("src_id", r"(\d+)$", 1).try_cast("bigint")
    return edges.where(number % 50 == 0).select("graph_id", F.col("src_id").alias("seed_id")).distinct().withColumn("query_id", F.col("seed_id"))


def trade_graph(spark: SparkSession, folder: str) -> DataFrame:
    """The trade tables as a graph: customers place orders, orders contain parts, parts are supplied, all in nations and regions."""

    def link(name: str, source_kind: str, source: str, relation: str, target_kind: str, target: str, label: Column | None = None) -> DataFrame:
        rows = table(spark, folder, name)
        return rows.select(F.lit("trade").alias("graph_id"), F.concat(F.lit(f"{source_kind}:"), F.col(source)).alias("src_id"), F.lit(relation).alias("relation"), F.concat(F.lit(f"{target_kind}:"), F.col(target)).alias("dst_id"), (F.lit("") if label is None else label).alias("source"))

    line = F.concat(F.lit("l:"), F.col("l_orderkey"), F.lit(":"), F.col("l_linenumber"))
    edges = [
        link("orders", "customer", "o_custkey", "placed", "order", "o_orderkey"),
        link("lineitem", "order", "l_orderkey", "contains", "part", "l_partkey", line),
        link("lineitem", "part", "l_partkey", "supplied_by", "supplier", "l_suppkey", line),
        link("supplier", "supplier", "s_suppkey", "in_nation", "nation", "s_nationkey"),
        link("customer", "customer", "c_custkey", "in_nation", "nation", "c_nationkey"),
        link("nation", "nation", "n_nationkey", "in_region", "region", "n_regionkey"),
    ]
    whole = edges[0]
    for part in edges[1:]:
        whole = whole.unionByName(part)
    # not written: a hop's relation leaves the tables of all others unread
    return whole.distinct().select(*IDENTITY).withColumn("edge_id", logical_edge_id())


def trade_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer whose key is divisible by 50."""
    seed = F.concat(F.lit("customer:"), F.col("c_custkey"))
    return table(spark, folder, "customer").where("c_custkey % 50 = 0").select(seed.alias("query_id"), F.lit("trade").alias("graph_id"), seed.alias("seed_id"))
