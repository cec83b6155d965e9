"""python -m graphloom COMMAND ...

list                              the registered queries
run QUERY TABLES OUT              run a query over a folder of tables and write its rows
canonicalize EDGES.csv OUT        logical edges with their portable id from an edge file; 2 if rows were left out
profile EDGES.csv                 sources, edges and degrees of each graph of an edge file
generate-manifest EDGES.csv OUT FANOUT RELATION...
                                  queries from every source that has such paths, with their expected number and hash
validate MANIFEST EDGES.csv       answer the queries of a manifest and compare them with what they expect; 2 if any differs
manifest MANIFEST                 problems of a manifest; 2 if there are any
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.edges import canonical_edges, degree_summary
from graphloom.operators.traverse import manifest, path_hashes, traverse
from graphloom.plans import registry
from graphloom.session import build_session, scratch, ship
from graphloom.sources.files import invalid_edges, invalid_queries, read_edges, read_manifest, write_canonical


def _edges(spark: SparkSession, path: str) -> DataFrame:
    return canonical_edges(read_edges(spark, path)).withColumn("edge_id", F.col("logical_edge_id"))


def _canonicalize(spark: SparkSession, path: str, out: str) -> int:
    rows = read_edges(spark, path)
    write_canonical(canonical_edges(rows), out)
    return 0 if invalid_edges(rows).isEmpty() else 2


def _generate(spark: SparkSession, path: str, out: str, fanout: str, *relations: str) -> int:
    edges = _edges(spark, path)
    seeds = edges.select(F.col("src_id").alias("query_id"), "graph_id", F.col("src_id").alias("seed_id")).distinct()
    manifest(seeds, edges, list(relations), int(fanout)).write.mode("overwrite").json(out)
    return 0


def _validate(spark: SparkSession, path: str, edges: str) -> int:
    """Each relation path of the manifest is one traversal of all its queries; a manifest has few of them."""
    asked = spark.read.json(path).select("query_id", "graph_id", "seed_id", "relation_path", "fanout", "expected_path_count", "expected_path_hash")
    graph = _edges(spark, edges)
    wrong = 0
    for plan in asked.select("relation_path", "fanout").distinct().collect():
        mine = asked.where((F.col("relation_path") == F.array(*map(F.lit, plan.relation_path))) & (F.col("fanout") == plan.fanout))
        found = path_hashes(traverse(mine.select("query_id", "graph_id", "seed_id"), graph, list(plan.relation_path), int(plan.fanout)))
        both = mine.join(found, ["query_id", "graph_id"], "left")
        differs = (F.col("n_paths").eqNullSafe(F.col("expected_path_count")) & F.col("path_hash").eqNullSafe(F.col("expected_path_hash"))) | ((F.col("expected_path_count") == 0) & F.col("n_paths").isNull())
        bad = both.where(~differs)
        bad.select("query_id", "graph_id", "expected_path_count", "n_paths").show(100, truncate=False)
        wrong += bad.count()
    return 2 if wrong else 0


def main(args: list[str], spark: SparkSession | None = None) -> int:
    command, rest = (args[0], args[1:]) if args else ("", [])
    if command == "list" and not rest:
        print(*registry.queries(), sep="\n")
        return 0
    known = {"run": 3, "canonicalize": 2, "profile": 1, "validate": 2, "manifest": 1}
    if not (known.get(command) == len(rest) or command == "generate-manifest" and len(rest) >= 4) or command == "run" and rest[0] not in registry.queries():
        print(__doc__)
        return 1
    spark = spark or build_session()
    ship(spark)
    with scratch():
        if command == "run":
            registry.queries()[rest[0]](spark, rest[1]).write.parquet(rest[2])
            return 0
        if command == "canonicalize":
            return _canonicalize(spark, *rest)
        if command == "profile":
            degree_summary(_edges(spark, rest[0]), 50).show(1000, truncate=False)
            return 0
        if command == "generate-manifest":
            return _generate(spark, *rest)
        if command == "validate":
            return _validate(spark, *rest)
        problems = invalid_queries(read_manifest(spark, rest[0]))
        problems.show(1000, truncate=False)
        return 0 if problems.isEmpty() else 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
