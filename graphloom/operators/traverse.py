"""Bounded multi-hop traversal of labelled edges, all queries in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import cut

ANY = "*"


def bounded_adjacency(edges: DataFrame, fanout: int, hops: int) -> DataFrame:
    """The edges that a traversal can still choose, a bounded number for each source and relation.

    Of the edges of a source and relation in order of destination, a path
    takes at most ``fanout``, and passes over those that lead back to one of
    its nodes, at most ``hops + 1`` destinations. So only the first
    ``fanout + hops + 1`` destinations, and of each the first ``fanout``
    parallel edges, can ever be taken. A hub with millions of edges joins with
    these few; Spark cuts the rest off before the shuffle (WindowGroupLimit).
    """
    place = Window.partitionBy("graph_id", "src_id", "relation").orderBy("dst_id")
    parallel = Window.partitionBy("graph_id", "src_id", "relation", "dst_id").orderBy("source", "edge_id")
    rows = edges.withColumn("_place", F.dense_rank().over(place)).where(F.col("_place") <= fanout + hops + 1)
    return rows.withColumn("_parallel", F.row_number().over(parallel)).where(F.col("_parallel") <= fanout).drop("_place", "_parallel")


def _steps(frontier: DataFrame, edges: DataFrame, relation: str, fanout: int, hops: int) -> DataFrame:
    """The bounded adjacency of a frontier's nodes; the semi join reaches down to the scan, before any edge is shuffled or sorted."""
    if relation != ANY:
        edges = edges.where(F.col("relation") == relation)
    nodes = frontier.select("graph_id", F.col("node").alias("src_id")).distinct()
    near = bounded_adjacency(edges.join(nodes, ["graph_id", "src_id"], "left_semi"), fanout, hops)
    return near.select("graph_id", F.col("src_id").alias("node"), "relation", "dst_id", "source", "edge_id")


def _hop(frontier: DataFrame, steps: DataFrame, fanout: int, cycle_first: bool, cycles: str) -> DataFrame:
    joined = frontier.join(steps, ["graph_id", "node"])
    fresh = ~F.array_contains("node_path", F.col("dst_id")) if cycles == "path" else F.lit(True)
    # the order of edges, and within one state the choice of the first ones
    order = Window.partitionBy("query_id", "graph_id", "edge_path").orderBy("relation", "dst_id", "source", "edge_id")
    if cycle_first:
        joined = joined.where(fresh)
    joined = joined.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= fanout)
    if not cycle_first:
        joined = joined.where(fresh)
    return joined.select(
        "query_id",
        "graph_id",
        F.col("dst_id").alias("node"),
        F.concat("node_path", F.array("dst_id")).alias("node_path"),
        F.concat("edge_path", F.array("edge_id")).alias("edge_path"),
        F.concat("relation_path", F.array("relation")).alias("relation_path"),
        F.concat("source_path", F.array(F.coalesce("source", F.lit("")))).alias("source_path"),
    )


def traverse_levels(seeds: DataFrame, edges: DataFrame, relations: list[str], fanout: int, cycle_first: bool = True, cycles: str = "path") -> list[DataFrame]:
    """The frontiers after each hop: ``(query_id, graph_id, node, node_path, edge_path, relation_path, source_path)``.

    ``seeds(query_id, graph_id, seed_id)``; ``edges(graph_id, src_id,
    relation, dst_id, source, edge_id)`` with one row for each logical edge;
    one relation for each hop, ``*`` for any. Each state takes its first
    ``fanout`` edges by (relation, destination, source). With ``cycle_first``
    edges back to the path's nodes are dropped before they are counted,
    otherwise after. ``cycles`` is ``path`` or ``none`` (then nothing is
    dropped).
    """
    if cycles not in ("path", "none"):
        raise ValueError(f"unknown cycle policy: {cycles}")
    if fanout < 1 or not relations:
        raise ValueError("a traversal has at least one hop and a fanout of at least 1")
    empty = F.array().cast("array<string>")
    frontier = seeds.select("query_id", "graph_id", F.col("seed_id").alias("node"), F.array("seed_id").alias("node_path"), empty.alias("edge_path"), empty.alias("relation_path"), empty.alias("source_path"))
    levels = []
    for hop, relation in enumerate(relations, 1):
        steps = _steps(frontier, edges, relation, fanout, len(relations))
        # written, as each hop reads the frontier before it twice
        frontier = cut(_hop(frontier, steps, fanout, cycle_first, cycles), f"frontier-{hop}")
        levels.append(frontier)
    return levels


def traverse(seeds: DataFrame, edges: DataFrame, relations: list[str], fanout: int, cycle_first: bool = True, cycles: str = "path") -> DataFrame:
    """The distinct paths of the whole length: ``(query_id, graph_id, edge_path, relation_path, node)``."""
    last = traverse_levels(seeds, edges, relations, fanout, cycle_first, cycles)[-1]
    return last.select("query_id", "graph_id", "edge_path", "relation_path", "node").distinct()


def frontier_sets(seeds: DataFrame, edges: DataFrame, relations: list[str], fanout: int, max_frontier: int) -> DataFrame:
    """Breadth first without paths: the nodes of each level as ``(query_id, graph_id, hop, node)``.

    Each node of a frontier takes its first ``fanout`` edges; of a level's
    distinct nodes the first ``max_frontier`` in order go on.
    """
    frontier = seeds.select("query_id", "graph_id", F.col("seed_id").alias("node"))
    out = frontier.withColumn("hop", F.lit(0))
    for hop, relation in enumerate(relations, 1):
        steps = _steps(frontier, edges, relation, fanout, 0)
        order = Window.partitionBy("query_id", "graph_id", "node").orderBy("relation", "dst_id", "source", "edge_id")
        reached = frontier.join(steps, ["graph_id", "node"]).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= fanout)
        nodes = reached.select("query_id", "graph_id", F.col("dst_id").alias("node")).distinct()
        first = Window.partitionBy("query_id", "graph_id").orderBy("node")
        frontier = cut(nodes.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= max_frontier).drop("_n"), f"frontier-{hop}")
        out = out.unionByName(frontier.withColumn("hop", F.lit(hop)))
    return out


def depth_profile(levels: list[DataFrame]) -> DataFrame:
    """For each level: queries still going, states, distinct nodes."""
    rows = None
    for hop, level in enumerate(levels, 1):
        part = level.agg(F.countDistinct("query_id", "graph_id").alias("n_queries"), F.count(F.lit(1)).alias("n_states"), F.countDistinct("graph_id", "node").alias("n_nodes")).withColumn("hop", F.lit(hop))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def closure(seeds: DataFrame, levels: list[DataFrame], edges: DataFrame) -> DataFrame:
    """All outgoing edges, of whatever relation, of every source that a traversal expanded."""
    visited = seeds.select("graph_id", F.col("seed_id").alias("src_id"))
    for level in levels[:-1]:
        visited = visited.unionByName(level.select("graph_id", F.col("node").alias("src_id")))
    return edges.join(visited.distinct(), ["graph_id", "src_id"], "left_semi").distinct()


def path_identity(form: str) -> Column:
    """The text by which a path of :func:`traverse_levels` is told apart from others.

    ``edges``: its edges' ids; ``triples``: each hop as source, relation and
    destination, so that parallel edges are one; ``sources``: the sources of
    its edges only.
    """
    if form == "edges":
        return F.array_join("edge_path", ",")
    if form == "sources":
        return F.array_join("source_path", ",")
    if form != "triples":
        raise ValueError(f"unknown form of path: {form}")
    n = F.size("relation_path")
    hops = F.zip_with(F.slice("node_path", 1, n), F.zip_with("relation_path", F.slice("node_path", 2, n), lambda r, d: F.concat(r, F.lit("|"), d)), lambda s, rest: F.concat(s, F.lit("|"), rest))
    return F.array_join(hops, ",")


def path_hashes(paths: DataFrame, digits: int = 64, as_json: bool = False) -> DataFrame:
    """For each query how many paths it has and the SHA-256 of their sorted list, or its first ``digits``.

    ``as_json`` hashes the JSON array of arrays of edge ids, with a blank after
    each comma, instead of lines. A query's paths are bounded by the fanout.
    """
    path = F.concat(F.lit('["'), F.array_join("edge_path", '", "'), F.lit('"]')) if as_json else F.array_join("edge_path", ",")
    texts = paths.groupBy("query_id", "graph_id").agg(F.array_sort(F.collect_set(path)).alias("_p"))
    whole = F.concat(F.lit("["), F.array_join("_p", ", "), F.lit("]")) if as_json else F.array_join("_p", "\n")
    return texts.select("query_id", "graph_id", F.size("_p").cast("bigint").alias("n_paths"), F.substring(F.sha2(whole, 256), 1, digits).alias("path_hash"))


def manifest(seeds: DataFrame, edges: DataFrame, relations: list[str], fanout: int) -> DataFrame:
    """Queries with what they must return, for every seed that has any path: seed, relation path, hops, fanout, expected number and hash of paths."""
    expected = path_hashes(traverse(seeds, edges, relations, fanout))
    rows = seeds.join(expected, ["query_id", "graph_id"])
    return rows.select("query_id", "graph_id", "seed_id", F.array(*map(F.lit, relations)).alias("relation_path"), F.lit(len(relations)).alias("hop"), F.lit(fanout).alias("fanout"), F.lit("path").alias("cycle_policy"), F.col("n_paths").alias("expected_path_count"), F.col("path_hash").alias("expected_path_hash"))
