"""Queries of the edge store and of traversal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import edges as E
from graphloom.operators import traverse as T
from graphloom.operators.evidence import first_of_each
from graphloom.sources import graphs
from graphloom.sources.tables import table

HIGH_DEGREE = 50


def _canonical(spark: SparkSession, sf: str) -> DataFrame:
    return E.canonical_edges(table(spark, sf, "kg_edges_by_src"))


def edge_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Every logical edge, with its identity hash and number of stored copies."""
    return _canonical(spark, sf)


def edge_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Logical edges stored more than once."""
    return E.duplicate_edges(_canonical(spark, sf)).select("logical_edge_id", "copies")


def edge_duplicate_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Up to three stored ids of each logical edge that is stored more than once."""
    rows = table(spark, sf, "kg_edges_by_src").select(*[F.coalesce(E.trimmed(c), F.lit("")).alias(c) for c in E.IDENTITY], "edge_id").withColumn("logical_edge_id", E.logical_edge_id())
    twice = E.duplicate_edges(_canonical(spark, sf)).select("logical_edge_id")
    found = rows.select("logical_edge_id", "edge_id").join(twice, "logical_edge_id", "left_semi").distinct()
    return first_of_each(found, ["logical_edge_id"], ["edge_id"], 3)


def edge_identity_rules(spark: SparkSession, sf: str) -> DataFrame:
    """How many edges remain under each of the identity rules in use."""
    rules = {"five": E.IDENTITY, "without_source": E.IDENTITY[:4], "without_graph": E.IDENTITY[1:], "triple": E.IDENTITY[1:4]}
    parts = None
    for name, rule in rules.items():
        part = E.canonical_edges(table(spark, sf, "kg_edges_by_src"), rule).agg(F.count(F.lit(1)).alias("n_edges"), F.sum("copies").alias("n_rows")).withColumn("rule", F.lit(name))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def edge_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Edges in each bucket by the MD5 rule (16 buckets) and the SHA-256 rule (64 buckets)."""
    rows = table(spark, sf, "kg_edges_by_src").where("src_id is not null")
    md5 = rows.groupBy(E.md5_bucket(F.col("src_id"), 16).alias("bucket")).agg(F.count(F.lit(1)).alias("n_edges")).withColumn("rule", F.lit("md5"))
    sha = rows.groupBy(E.sha256_bucket(F.col("src_id"), 6).alias("bucket")).agg(F.count(F.lit(1)).alias("n_edges")).withColumn("rule", F.lit("sha256"))
    return md5.unionByName(sha)


def edge_reverse_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return E.in_degrees(_canonical(spark, sf))


def edge_degree_summary(spark: SparkSession, sf: str) -> DataFrame:
    return E.degree_summary(_canonical(spark, sf), HIGH_DEGREE)


def edge_relation_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return E.relation_histogram(_canonical(spark, sf))


def edge_relation_selectivity(spark: SparkSession, sf: str) -> DataFrame:
    return E.relation_selectivity(_canonical(spark, sf), "likes")


def edge_seeds_by_degree(spark: SparkSession, sf: str) -> DataFrame:
    """The 100 sources with the most edges."""
    return E.out_degrees(_canonical(spark, sf)).orderBy(F.desc("degree"), "graph_id", "src_id").limit(100)


def edge_selective_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of which between 5 and 20 percent of the edges bear the relation."""
    return E.relation_selectivity(_canonical(spark, sf), "likes").where("selectivity between 0.05 and 0.2 and raw_edges >= 5").select("graph_id", "src_id", "selectivity")


def edge_bucket_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Relation scans over all buckets of the relation table: rows, buckets and the fullest bucket."""
    rows = table(spark, sf, "kg_edges_by_relation_bucket").groupBy("graph_id", "relation", "bucket").agg(F.count(F.lit(1)).alias("_n"))
    return rows.groupBy("graph_id", "relation").agg(F.sum("_n").alias("n_edges"), F.count("bucket").alias("n_buckets"), F.max("_n").alias("fullest"))


def edge_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The evidence after the last bar of a source, as session and turn: edges and turns of each session."""
    evidence = F.substring_index("source", "|", -1)
    rows = table(spark, sf, "kg_edges_by_src").where("source is not null").select(F.regexp_extract(evidence, r"D\s*:?\s*(\d+)\s*:\s*(\d+)", 1).try_cast("int").alias("session"), F.regexp_extract(evidence, r"D\s*:?\s*(\d+)\s*:\s*(\d+)", 2).try_cast("int").alias("turn"))
    return rows.groupBy("session").agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("turn").alias("n_turns"))


def edge_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return E.neighbour_counts(_canonical(spark, sf))


def edge_table_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Logical edges of each graph that only one of the two edge tables has, and those in both."""
    left = _canonical(spark, sf).select("graph_id", "logical_edge_id")
    right = E.canonical_edges(table(spark, sf, "kg_edges_by_relation_bucket")).select("graph_id", "logical_edge_id")
    side = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), ["graph_id", "logical_edge_id"], "full")
    count = lambda c: F.sum(c.cast("bigint"))
    return side.groupBy("graph_id").agg(count(F.col("_r").isNull()).alias("only_by_src"), count(F.col("_l").isNull()).alias("only_by_relation"), count(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("in_both"))


KG_PATH = ["likes", "~likes"]
TRADE_PATH = ["placed", "contains", "supplied_by"]


def _kg(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return graphs.memory_graph(spark, sf)


def _trade(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return graphs.trade_seeds(spark, sf), graphs.trade_graph(spark, sf)


def _listed(paths: DataFrame) -> DataFrame:
    return paths.select("query_id", "graph_id", F.array_join("edge_path", ",").alias("path"))


def graph_two_hop_strict(spark: SparkSession, sf: str) -> DataFrame:
    """Sources that like the same things: cycles dropped, then the first 5 edges of each state."""
    return _listed(T.traverse(*_kg(spark, sf), KG_PATH, 5))


def graph_two_hop_bench(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the first 5 edges taken, then cycles dropped."""
    return _listed(T.traverse(*_kg(spark, sf), KG_PATH, 5, cycle_first=False))


def graph_two_hop_free(spark: SparkSession, sf: str) -> DataFrame:
    """The same with cycles allowed."""
    return _listed(T.traverse(*_kg(spark, sf), KG_PATH, 5, cycles="none"))


def graph_two_hop_wildcard(spark: SparkSession, sf: str) -> DataFrame:
    return _listed(T.traverse(*_kg(spark, sf), ["*", "*"], 4))


def graph_three_hop_trade(spark: SparkSession, sf: str) -> DataFrame:
    return _listed(T.traverse(*_trade(spark, sf), TRADE_PATH, 3))


def graph_frontier_sets(spark: SparkSession, sf: str) -> DataFrame:
    return T.frontier_sets(*_trade(spark, sf), TRADE_PATH, 4, 20)


def graph_depth_profile(spark: SparkSession, sf: str) -> DataFrame:
    return T.depth_profile(T.traverse_levels(*_trade(spark, sf), TRADE_PATH, 3))


def graph_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Edges that a server must hold to answer the two-hop queries."""
    seeds, edges = _kg(spark, sf)
    return T.closure(seeds, T.traverse_levels(seeds, edges, KG_PATH, 5), edges).groupBy("graph_id", "relation").agg(F.count(F.lit(1)).alias("n_edges"))


def graph_path_hash(spark: SparkSession, sf: str) -> DataFrame:
    return T.path_hashes(T.traverse(*_trade(spark, sf), TRADE_PATH, 3))


def graph_path_hash_json(spark: SparkSession, sf: str) -> DataFrame:
    """The same over JSON, its first 16 digits."""
    return T.path_hashes(T.traverse(*_trade(spark, sf), TRADE_PATH, 3), 16, as_json=True)


def _told_apart(spark: SparkSession, sf: str, form: str) -> DataFrame:
    levels = T.traverse_levels(*_kg(spark, sf), ["*", "*"], 4, cycle_first=False)
    return levels[-1].select("query_id", "graph_id", T.path_identity(form).alias("path")).distinct()


def graph_two_hop_triples(spark: SparkSession, sf: str) -> DataFrame:
    """Two-hop paths told apart by their triples."""
    return _told_apart(spark, sf, "triples")


def graph_two_hop_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Two-hop paths told apart by their sources only."""
    return _told_apart(spark, sf, "sources")


def graph_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest of three-hop queries over the trade graph with the number and hash of their paths."""
    rows = T.manifest(*_trade(spark, sf), TRADE_PATH, 3)
    return rows.withColumn("relation_path", F.array_join("relation_path", ","))


def graph_path_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Least, median, 95th percentile and greatest number of paths of a query, 0 for queries without any."""
    seeds, edges = _trade(spark, sf)
    counts = T.path_hashes(T.traverse(seeds, edges, TRADE_PATH, 3)).select("query_id", "n_paths")
    counts = seeds.select("query_id").join(counts, "query_id", "left").select(F.coalesce("n_paths", F.lit(0)).alias("n"))
    return counts.agg(F.count(F.lit(1)).alias("n_queries"), F.min("n").alias("min_paths"), F.percentile("n", F.lit(0.5)).alias("p50_paths"), F.percentile("n", F.lit(0.95)).alias("p95_paths"), F.max("n").alias("max_paths"))


def graph_relation_paths(spark: SparkSession, sf: str) -> DataFrame:
    """How often each pair of relations occurs on two-hop paths."""
    paths = T.traverse(*_kg(spark, sf), ["*", "*"], 4, cycles="none")
    return paths.groupBy(F.array_join("relation_path", ",").alias("relation_path")).agg(F.count(F.lit(1)).alias("n_paths"))


QUERIES = {
    f.__name__: f
    for f in (
        edge_canonical,
        edge_duplicates,
        edge_duplicate_examples,
        edge_identity_rules,
        edge_buckets,
        edge_reverse_lookup,
        edge_degree_summary,
        edge_relation_histogram,
        edge_relation_selectivity,
        edge_seeds_by_degree,
        edge_selective_seeds,
        edge_bucket_scan,
        edge_evidence,
        edge_neighbours,
        edge_table_agreement,
        graph_two_hop_strict,
        graph_two_hop_bench,
        graph_two_hop_free,
        graph_two_hop_wildcard,
        graph_three_hop_trade,
        graph_frontier_sets,
        graph_depth_profile,
        graph_closure,
        graph_path_hash,
        graph_path_hash_json,
        graph_two_hop_triples,
        graph_two_hop_sources,
        graph_manifest,
        graph_path_stats,
        graph_relation_paths,
    )
}


def _trim(c: str) -> str:
    return f"coalesce(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '')"


def _id(columns: list[str]) -> str:
    return "'L' || substr(sha1(CAST(to_json([" + ", ".join(columns) + "]) AS VARCHAR)), 1, 24)"


def _canonical_sql(name: str = "kg_edges_by_src", identity: list[str] | None = None) -> str:
    identity = identity or E.IDENTITY
    inner = ", ".join(f"{_trim(c)} AS {c}" for c in identity)
    needed = " AND ".join(f"{c} <> ''" for c in identity if c in E.REQUIRED)
    return f"(SELECT {', '.join(identity)}, count(*) AS copies, {_id(identity)} AS logical_edge_id FROM (SELECT {inner} FROM {name}) WHERE {needed} GROUP BY {', '.join(identity)})"


_C = f"WITH c AS {_canonical_sql()}\n"

_KG = f"""
c AS {_canonical_sql()},
b AS (SELECT graph_id, src_id, relation, dst_id, source FROM c UNION ALL SELECT graph_id, dst_id, '~' || relation, src_id, source FROM c),
edges AS (SELECT *, {_id(E.IDENTITY)} AS edge_id FROM b),
seeds AS (SELECT DISTINCT src_id AS query_id, graph_id, src_id AS seed_id FROM c WHERE TRY_CAST(nullif(regexp_extract(src_id, '(\\d+)$', 1), '') AS BIGINT) % 50 = 0)"""

_TRADE = f"""
b AS (SELECT 'trade' AS graph_id, * FROM (
  SELECT 'customer:' || o_custkey AS src_id, 'placed' AS relation, 'order:' || o_orderkey AS dst_id, '' AS source FROM orders
  UNION ALL SELECT 'order:' || l_orderkey, 'contains', 'part:' || l_partkey, 'l:' || l_orderkey || ':' || l_linenumber FROM lineitem
  UNION ALL SELECT 'part:' || l_partkey, 'supplied_by', 'supplier:' || l_suppkey, 'l:' || l_orderkey || ':' || l_linenumber FROM lineitem
  UNION ALL SELECT 'supplier:' || s_suppkey, 'in_nation', 'nation:' || s_nationkey, '' FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, 'in_nation', 'nation:' || c_nationkey, '' FROM customer
  UNION ALL SELECT 'nation:' || n_nationkey, 'in_region', 'region:' || n_regionkey, '' FROM nation)),
edges AS (SELECT DISTINCT *, {_id(E.IDENTITY)} AS edge_id FROM b),
seeds AS (SELECT 'customer:' || c_custkey AS query_id, 'trade' AS graph_id, 'customer:' || c_custkey AS seed_id FROM customer WHERE c_custkey % 50 = 0)"""


def _levels_sql(graph: str, relations: list[str], fanout: int, cycle_first: bool = True, cycles: str = "path") -> str:
    """CTEs l0 to lN; lN holds the states after hop N."""
    out = "WITH " + graph + ",\nl0 AS (SELECT query_id, graph_id, seed_id AS node, [seed_id] AS node_path, CAST([] AS VARCHAR[]) AS edge_path, CAST([] AS VARCHAR[]) AS relation_path, CAST([] AS VARCHAR[]) AS source_path FROM seeds)"
    for hop, relation in enumerate(relations, 1):
        fresh = "NOT list_contains(l.node_path, e.dst_id)" if cycles == "path" else "true"
        wanted = "true" if relation == T.ANY else f"e.relation = '{relation}'"
        inner = f"""SELECT l.*, e.relation, e.dst_id, e.edge_id, e.source, {fresh} AS fresh,
  row_number() OVER (PARTITION BY l.query_id, l.graph_id, l.edge_path ORDER BY e.relation, e.dst_id, e.source, e.edge_id) AS n
  FROM l{hop - 1} l JOIN edges e ON e.graph_id = l.graph_id AND e.src_id = l.node WHERE {wanted}{' AND ' + fresh if cycle_first else ''}"""
        out += f""",
l{hop} AS (SELECT query_id, graph_id, dst_id AS node, list_append(node_path, dst_id) AS node_path, list_append(edge_path, edge_id) AS edge_path, list_append(relation_path, relation) AS relation_path, list_append(source_path, source) AS source_path
 FROM ({inner}) WHERE n <= {fanout} AND fresh)"""
    return out + "\n"


_PATHS = "SELECT DISTINCT query_id, graph_id, array_to_string(edge_path, ',') AS path FROM l{}"
_TRADE_LEVELS = _levels_sql(_TRADE, TRADE_PATH, 3)
_HASHED = "SELECT query_id, graph_id, count(*) AS n_paths, sha256(string_agg(path, chr(10) ORDER BY path)) AS path_hash FROM (" + _PATHS.format(3) + ") GROUP BY query_id, graph_id"


def _frontier_sql(relations: list[str], fanout: int, most: int) -> str:
    out = "WITH " + _TRADE + ",\nf0 AS (SELECT query_id, graph_id, seed_id AS node FROM seeds)"
    for hop, relation in enumerate(relations, 1):
        out += f""",
f{hop} AS (SELECT query_id, graph_id, node FROM (SELECT DISTINCT query_id, graph_id, dst_id AS node FROM (
  SELECT f.query_id, f.graph_id, e.dst_id, row_number() OVER (PARTITION BY f.query_id, f.graph_id, f.node ORDER BY e.relation, e.dst_id, e.source, e.edge_id) AS n
  FROM f{hop - 1} f JOIN edges e ON e.graph_id = f.graph_id AND e.src_id = f.node WHERE e.relation = '{relation}') WHERE n <= {fanout})
  QUALIFY row_number() OVER (PARTITION BY query_id, graph_id ORDER BY node) <= {most})"""
    return out + "\n" + " UNION ALL ".join(f"SELECT query_id, graph_id, node, {hop} AS hop FROM f{hop}" for hop in range(len(relations) + 1))


_SELECTIVITY = _C + "SELECT graph_id, src_id, count(*) AS raw_edges, CAST(count(*) FILTER (WHERE relation = 'likes') AS BIGINT) AS returned_edges, round(count(*) FILTER (WHERE relation = 'likes') / count(*), 6) AS selectivity FROM c GROUP BY ALL"

SQL = {
    "edge_canonical": _C + "SELECT * FROM c",
    "edge_duplicates": _C + "SELECT logical_edge_id, copies FROM c WHERE copies > 1",
    "edge_duplicate_examples": _C + f"SELECT DISTINCT c.logical_edge_id, r.edge_id FROM (SELECT edge_id, {', '.join(f'{_trim(x)} AS {x}' for x in E.IDENTITY)} FROM kg_edges_by_src) r JOIN c ON {' AND '.join(f'r.{x} = c.{x}' for x in E.IDENTITY)} WHERE c.copies > 1 QUALIFY dense_rank() OVER (PARTITION BY c.logical_edge_id ORDER BY r.edge_id) <= 3",
    "edge_identity_rules": " UNION ALL ".join(
        f"SELECT '{name}' AS rule, count(*) AS n_edges, CAST(sum(copies) AS BIGINT) AS n_rows FROM {_canonical_sql(identity=rule)}" for name, rule in {"five": E.IDENTITY, "without_source": E.IDENTITY[:4], "without_graph": E.IDENTITY[1:], "triple": E.IDENTITY[1:4]}.items()
    ),
    "edge_buckets": """
SELECT 'md5' AS rule, CAST('0x' || substr(md5(src_id), 1, 8) AS BIGINT) % 16 AS bucket, count(*) AS n_edges FROM kg_edges_by_src WHERE src_id IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'sha256', CAST('0x' || substr(sha256(src_id), 57, 8) AS BIGINT) % 64, count(*) FROM kg_edges_by_src WHERE src_id IS NOT NULL GROUP BY ALL""",
    "edge_reverse_lookup": _C + "SELECT graph_id, dst_id, count(*) AS n_edges, count(DISTINCT src_id) AS n_sources, count(DISTINCT relation) AS n_relations FROM c GROUP BY ALL",
    "edge_degree_summary": _C
    + f"""SELECT graph_id, count(*) AS n_sources, CAST(sum(d) AS BIGINT) AS n_edges, min(d) AS min_degree, quantile_cont(d, 0.5) AS p50_degree, max(d) AS max_degree, count(*) FILTER (WHERE d >= {HIGH_DEGREE}) AS n_high
FROM (SELECT graph_id, src_id, count(*) AS d FROM c GROUP BY ALL) GROUP BY graph_id""",
    "edge_relation_histogram": _C + "SELECT relation, count(*) AS n_edges, round(count(*) / (SELECT count(*) FROM c), 6) AS share FROM c GROUP BY relation",
    "edge_relation_selectivity": _SELECTIVITY,
    "edge_seeds_by_degree": _C + "SELECT graph_id, src_id, count(*) AS degree, count(DISTINCT relation) AS relations FROM c GROUP BY ALL ORDER BY degree DESC, graph_id, src_id LIMIT 100",
    "edge_selective_seeds": f"SELECT graph_id, src_id, selectivity FROM ({_SELECTIVITY}) WHERE selectivity BETWEEN 0.05 AND 0.2 AND raw_edges >= 5",
    "edge_bucket_scan": "SELECT graph_id, relation, CAST(sum(n) AS BIGINT) AS n_edges, count(bucket) AS n_buckets, max(n) AS fullest FROM (SELECT graph_id, relation, bucket, count(*) AS n FROM kg_edges_by_relation_bucket GROUP BY ALL) GROUP BY graph_id, relation",
    "edge_evidence": r"""
WITH e AS (SELECT regexp_extract(source, '[^|]*$') AS v FROM kg_edges_by_src WHERE source IS NOT NULL)
SELECT TRY_CAST(regexp_extract(v, 'D\s*:?\s*(\d+)\s*:\s*(\d+)', 1) AS INTEGER) AS session, count(*) AS n_edges, count(DISTINCT TRY_CAST(regexp_extract(v, 'D\s*:?\s*(\d+)\s*:\s*(\d+)', 2) AS INTEGER)) AS n_turns FROM e GROUP BY 1""",
    "edge_neighbours": _C + "SELECT graph_id, entity, count(*) AS n_neighbours FROM (SELECT graph_id, src_id AS entity, dst_id AS other FROM c UNION SELECT graph_id, dst_id, src_id FROM c) GROUP BY ALL",
    "edge_table_agreement": f"""
WITH a AS {_canonical_sql()}, r AS {_canonical_sql("kg_edges_by_relation_bucket")}
SELECT coalesce(a.graph_id, r.graph_id) AS graph_id, count(*) FILTER (WHERE r.logical_edge_id IS NULL) AS only_by_src, count(*) FILTER (WHERE a.logical_edge_id IS NULL) AS only_by_relation,
       count(*) FILTER (WHERE a.logical_edge_id = r.logical_edge_id) AS in_both FROM a FULL JOIN r ON a.logical_edge_id = r.logical_edge_id GROUP BY 1""",
    "graph_two_hop_strict": _levels_sql(_KG, KG_PATH, 5) + _PATHS.format(2),
    "graph_two_hop_bench": _levels_sql(_KG, KG_PATH, 5, cycle_first=False) + _PATHS.format(2),
    "graph_two_hop_free": _levels_sql(_KG, KG_PATH, 5, cycles="none") + _PATHS.format(2),
    "graph_two_hop_wildcard": _levels_sql(_KG, ["*", "*"], 4) + _PATHS.format(2),
    "graph_three_hop_trade": _TRADE_LEVELS + _PATHS.format(3),
    "graph_frontier_sets": _frontier_sql(TRADE_PATH, 4, 20),
    "graph_depth_profile": _TRADE_LEVELS + " UNION ALL ".join(f"SELECT {h} AS hop, count(DISTINCT query_id || ' ' || graph_id) AS n_queries, count(*) AS n_states, count(DISTINCT graph_id || ' ' || node) AS n_nodes FROM l{h}" for h in (1, 2, 3)),
    "graph_closure": _levels_sql(_KG, KG_PATH, 5)
    + "SELECT e.graph_id, e.relation, count(*) AS n_edges FROM edges e WHERE EXISTS (SELECT 1 FROM (SELECT graph_id, node FROM l0 UNION SELECT graph_id, node FROM l1) v WHERE v.graph_id = e.graph_id AND v.node = e.src_id) GROUP BY ALL",
    "graph_path_hash": _TRADE_LEVELS + _HASHED,
    "graph_path_hash_json": _TRADE_LEVELS
    + "SELECT query_id, graph_id, count(*) AS n_paths, substr(sha256('[' || string_agg(p, ', ' ORDER BY p) || ']'), 1, 16) AS path_hash FROM (SELECT DISTINCT query_id, graph_id, '[\"' || array_to_string(edge_path, '\", \"') || '\"]' AS p FROM l3) GROUP BY query_id, graph_id",
    "graph_two_hop_triples": _levels_sql(_KG, ["*", "*"], 4, cycle_first=False) + "SELECT DISTINCT query_id, graph_id, node_path[1] || '|' || relation_path[1] || '|' || node_path[2] || ',' || node_path[2] || '|' || relation_path[2] || '|' || node_path[3] AS path FROM l2",
    "graph_two_hop_sources": _levels_sql(_KG, ["*", "*"], 4, cycle_first=False) + "SELECT DISTINCT query_id, graph_id, array_to_string(source_path, ',') AS path FROM l2",
    "graph_manifest": _TRADE_LEVELS + f"SELECT s.query_id, s.graph_id, s.seed_id, '{','.join(TRADE_PATH)}' AS relation_path, {len(TRADE_PATH)} AS hop, 3 AS fanout, 'path' AS cycle_policy, h.n_paths AS expected_path_count, h.path_hash AS expected_path_hash FROM seeds s JOIN ({_HASHED}) h ON h.query_id = s.query_id AND h.graph_id = s.graph_id",
    "graph_path_stats": _TRADE_LEVELS
    + f"""SELECT count(*) AS n_queries, min(n) AS min_paths, quantile_cont(n, 0.5) AS p50_paths, quantile_cont(n, 0.95) AS p95_paths, max(n) AS max_paths
FROM (SELECT coalesce(h.n_paths, 0) AS n FROM seeds s LEFT JOIN ({_HASHED}) h ON h.query_id = s.query_id)""",
    "graph_relation_paths": _levels_sql(_KG, ["*", "*"], 4, cycles="none") + "SELECT array_to_string(relation_path, ',') AS relation_path, count(*) AS n_paths FROM (SELECT DISTINCT query_id, graph_id, edge_path, relation_path FROM l2) GROUP BY 1",
}
