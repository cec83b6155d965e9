"""Queries of the general training-data problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.keys import as_key, as_whole
from graphloom.operators import chunked_keys, copy_difference, delete_vectors, orphans
from graphloom.session import cut
from graphloom.sources.tables import table

VERSIONS = ["expected_version", "memory_version", "rawerk_version", "bm25_version"]
CHANGE_BATCHES = 3


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that hold at least 4 % of the rows of their table."""
    src = chunked_keys.heavy_keys(table(spark, sf, "kg_edges_by_src"), as_key("src_id"), 0.04, F.col("created_at"))
    relation = chunked_keys.heavy_keys(table(spark, sf, "kg_edges_by_relation_bucket"), as_key("relation"), 0.04, F.col("created_at"))
    named = lambda df, name: df.select(F.lit(name).alias("table_name"), F.col("key").alias("key_value"))
    return named(src, "kg_edges_by_src").unionByName(named(relation, "kg_edges_by_relation_bucket"))


def _profile(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    # confidences have two digits: whole hundredths add up alike in any order
    rows = chunked_keys.profile_keys(table(spark, sf, name), as_key(key), F.col("created_at"), F.round(F.col("confidence") * 100).try_cast("bigint"))
    return rows.select(F.col("key").alias("key_value"), F.col("n").alias("n_edges"), F.col("first_at").alias("first_at_us"), F.col("last_at").alias("last_at_us"), F.col("longest_gap").alias("longest_gap_us"), F.col("bursts").cast("bigint").alias("bursts"), "n_values", F.col("total").alias("confidence_hundredths"))


def p1_source_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Each source: edges, first and last time, longest pause, bursts of activity, confidence."""
    return _profile(spark, sf, "kg_edges_by_src", "src_id")


def p1_relation_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The same for each relation."""
    return _profile(spark, sf, "kg_edges_by_relation_bucket", "relation")


def current_memories(spark: SparkSession, sf: str, batches: int = CHANGE_BATCHES) -> delete_vectors.DeleteVectorTable:
    """The feed of ``materialized`` applied in ``batches`` by ranges of its sequence."""
    feed = table(spark, sf, "materialized").select(as_key("memory_id").alias("key"), "version", "sequence", "update_id", "graph_id", as_key("operation").alias("operation"))
    feed = feed.where("key is not null and version is not null")
    # each change once, so that a late repeat cannot outrank a competing change
    feed = delete_vectors.first_deliveries(feed, "update_id", "sequence")
    span = table(spark, sf, "materialized").agg(F.min("sequence").alias("_low"), F.max("sequence").alias("_high"))
    place = F.floor((F.col("sequence") - F.col("_low")) * batches / (F.col("_high") - F.col("_low") + 1))
    feed = feed.join(F.broadcast(span)).withColumn("_batch", F.coalesce(place, F.lit(0)).cast("int")).drop("_low", "_high")
    feed = cut(feed.withColumn("deletes", F.col("operation").eqNullSafe("delete_memory")), "changes")
    state = delete_vectors.DeleteVectorTable(spark, ["update_id", "graph_id", "operation"])
    for number in range(batches):
        state.apply(feed.where(F.col("_batch") == number).drop("_batch"))
    return state


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """The memories that exist after all changes."""
    return current_memories(spark, sf).read().select(F.col("key").alias("memory_id"), F.col("version").cast("int").alias("version"), "update_id")


def p2_current_by_graph(spark: SparkSession, sf: str) -> DataFrame:
    """For each graph and last operation: how many memories exist, and their greatest version."""
    return current_memories(spark, sf).read().groupBy("graph_id", "operation").agg(F.count(F.lit(1)).alias("n_memories"), F.max("version").alias("max_version"))


def _audit(spark: SparkSession, sf: str, backend: str) -> DataFrame:
    rows = table(spark, sf, f"p5_3c_{backend}_final_state_audit")
    return rows.select(as_key("memory_id").alias("memory_id"), *[as_whole(v).alias(v) for v in VERSIONS])


def p4_differences(spark: SparkSession, sf: str) -> DataFrame:
    """All differences between the two audits, with both values."""
    rows = copy_difference.copy_differences(_audit(spark, sf, "cassandra"), _audit(spark, sf, "neo4j"), "memory_id", VERSIONS, "cassandra", "neo4j")
    whole = lambda c: F.col(c).cast("decimal(30,6)").cast("bigint").alias(c)
    return rows.select(F.col("key").alias("memory_id"), "field", "kind", whole("left_value"), whole("right_value"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Memories missing on either side, and each differing field."""
    return p4_differences(spark, sf).where("kind not like 'repeated%'").select("memory_id", "field", "kind").distinct()


def _references(spark: SparkSession, sf: str) -> tuple[list[orphans.References], DataFrame]:
    parent = F.struct(F.col("graph_id"), as_key("memory_id").alias("memory_id"))
    parent = F.when(as_key("memory_id").isNotNull(), parent)
    edges = table(spark, sf, "kg_edges_by_src").select(F.col("edge_id").alias("ref_key"), parent.alias("parent_key"), F.col("created_at").alias("at"))
    views = table(spark, sf, "raw_erk_view").select(as_key("memory_id").alias("ref_key"), parent.alias("parent_key"), F.timestamp_micros(F.round(F.col("updated_at") * 1_000_000).try_cast("bigint")).alias("at"))
    memories = table(spark, sf, "memory_by_id").select(parent.alias("parent_key"), "created_at", "deleted_at")
    return [orphans.References("kg_edges_by_src", edges), orphans.References("raw_erk_view", views)], memories


def _links(spark: SparkSession, sf: str) -> list[orphans.Link]:
    """What hangs on the references: copies of edges, audits of views, and the other backend's audits of those."""
    copies = table(spark, sf, "kg_edges_by_relation_bucket").select(F.col("edge_id").alias("ref_key"), F.col("edge_id").alias("parent_ref_key"), F.col("created_at").alias("at"))
    audit = lambda name: table(spark, sf, name).select(as_key("memory_id").alias("ref_key"), as_key("memory_id").alias("parent_ref_key"), F.lit(None).cast("timestamp").alias("at"))
    first, second = "p5_3c_cassandra_final_state_audit", "p5_3c_neo4j_final_state_audit"
    return [orphans.Link("kg_edges_by_relation_bucket", "kg_edges_by_src", copies), orphans.Link(first, "raw_erk_view", audit(first)), orphans.Link(second, first, audit(second))]


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each reference to a memory that is missing, deleted or later: what the fixpoint reaches from the lost memories down the two foreign keys to them."""
    return orphans.find_orphans(*_references(spark, sf)).select("ref_table", "ref_key", "kind", "period").distinct()


def p5_orphans_by_period(spark: SparkSession, sf: str) -> DataFrame:
    """Direct and inherited orphans for each table, kind and month, down the foreign keys to the audits of audits of views."""
    found = orphans.find_orphans(*_references(spark, sf), _links(spark, sf))
    return found.groupBy("ref_table", "kind", "origin", "depth", "period").agg(F.count(F.lit(1)).alias("n_refs"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_source_profile, p1_relation_profile, p2_found, p2_current_by_graph, p4_found, p4_differences, p5_found, p5_orphans_by_period)
}


def _key(column: str) -> str:
    return f"nullif(lower(regexp_replace({column}, '^\\s+|\\s+$', '', 'g')), '')"


def _profile_sql(name: str, key: str) -> str:
    return f"""
WITH e AS (SELECT {_key(key)} AS key_value, created_at, CAST(round(confidence * 100) AS BIGINT) AS c FROM {name}),
g AS (SELECT *, epoch_us(created_at) - lag(epoch_us(created_at)) OVER (PARTITION BY key_value ORDER BY created_at NULLS FIRST) AS gap FROM e WHERE key_value IS NOT NULL)
SELECT key_value, count(*) AS n_edges, epoch_us(min(created_at)) AS first_at_us, epoch_us(max(created_at)) AS last_at_us,
       CASE WHEN count(created_at) > 0 THEN coalesce(max(gap), 0) END AS longest_gap_us,
       CAST(CASE WHEN count(created_at) > 0 THEN 1 + count(*) FILTER (WHERE gap > 86400000000) ELSE 0 END AS BIGINT) AS bursts,
       count(c) AS n_values, CAST(sum(c) AS BIGINT) AS confidence_hundredths
FROM g GROUP BY key_value"""


CURRENT_SQL = f"""
WITH c AS (SELECT {_key("memory_id")} AS memory_id, graph_id, version, update_id, sequence, {_key("operation")} AS operation FROM materialized),
d AS (SELECT * FROM c WHERE memory_id IS NOT NULL AND version IS NOT NULL QUALIFY row_number() OVER (PARTITION BY update_id ORDER BY sequence) = 1),
w AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY version DESC, sequence DESC) = 1),
live AS (SELECT * FROM w WHERE operation IS DISTINCT FROM 'delete_memory')"""

_WHOLE = "CAST(TRY_CAST(regexp_replace(CAST({0} AS VARCHAR), '^\\s+|\\s+$', '', 'g') AS DECIMAL(30, 6)) AS BIGINT)"

_DIFFERENCE_SQL = (
    f"""
WITH c AS (SELECT DISTINCT {_key("memory_id")} AS k, """
    + ", ".join(f"{_WHOLE.format(v)} AS {v}" for v in VERSIONS)
    + f""" FROM p5_3c_cassandra_final_state_audit WHERE {_key("memory_id")} IS NOT NULL),
n AS (SELECT DISTINCT {_key("memory_id")} AS k, """
    + ", ".join(f"{_WHOLE.format(v)} AS {v}" for v in VERSIONS)
    + f""" FROM p5_3c_neo4j_final_state_audit WHERE {_key("memory_id")} IS NOT NULL),
found AS (
SELECT k AS memory_id, 'row' AS field, 'missing_in_neo4j' AS kind FROM c WHERE k NOT IN (SELECT k FROM n)
UNION ALL SELECT k, 'row', 'missing_in_cassandra' FROM n WHERE k NOT IN (SELECT k FROM c)
"""
    + "".join(f"UNION ALL SELECT c.k, '{v}', 'differs' FROM c JOIN n ON c.k = n.k WHERE c.{v} IS DISTINCT FROM n.{v}\n" for v in VERSIONS)
    + ")"
)

_COPY = "SELECT " + _key("memory_id") + " AS k, " + ", ".join(f"{_WHOLE.format(v)} AS {v}" for v in VERSIONS) + " FROM p5_3c_{0}_final_state_audit WHERE " + _key("memory_id") + " IS NOT NULL"
_RESIDUE = "SELECT *, row_number() OVER (PARTITION BY k ORDER BY " + ", ".join(f"{v} NULLS FIRST" for v in VERSIONS) + ") AS place FROM (SELECT DISTINCT * FROM (SELECT * FROM {0} EXCEPT ALL SELECT * FROM {1}))"
_LONE = "SELECT DISTINCT k AS memory_id, 'row' AS field, CASE WHEN k IN (SELECT k FROM {1}) THEN 'repeated_in_{2}' ELSE 'missing_in_{3}' END AS kind, CAST(NULL AS BIGINT) AS left_value, CAST(NULL AS BIGINT) AS right_value FROM {0} ANTI JOIN {4} USING (k, place)"
_RESIDUE_SQL = (
    f"""
WITH c AS ({_COPY.format("cassandra")}), n AS ({_COPY.format("neo4j")}),
l AS ({_RESIDUE.format("c", "n")}), r AS ({_RESIDUE.format("n", "c")})
{_LONE.format("l", "n", "cassandra", "neo4j", "r")} UNION ALL {_LONE.format("r", "c", "neo4j", "cassandra", "l")}
"""
    + "".join(f"UNION ALL SELECT DISTINCT l.k, '{v}', 'differs', l.{v}, r.{v} FROM l JOIN r ON l.k = r.k AND l.place = r.place WHERE l.{v} IS DISTINCT FROM r.{v}\n" for v in VERSIONS)
)

_ORPHAN_SQL = f"""
WITH m AS (SELECT graph_id, {_key("memory_id")} AS k, bool_or(deleted_at IS NOT NULL) AS deleted, min(created_at) AS created_at, true AS there FROM memory_by_id GROUP BY ALL),
r AS (SELECT 'kg_edges_by_src' AS ref_table, edge_id AS ref_key, graph_id, {_key("memory_id")} AS k, epoch_us(created_at) AS at FROM kg_edges_by_src
      UNION ALL SELECT 'raw_erk_view', {_key("memory_id")}, graph_id, {_key("memory_id")}, CAST(round(updated_at * 1000000) AS BIGINT) FROM raw_erk_view),
j AS (SELECT ref_table, ref_key, CASE WHEN m.there IS NULL THEN 'missing' WHEN m.deleted THEN 'deleted' WHEN epoch_us(m.created_at) > r.at THEN 'late' END AS kind,
      strftime(make_timestamp(r.at), '%Y-%m') AS period FROM r LEFT JOIN m ON m.graph_id = r.graph_id AND m.k = r.k WHERE r.k IS NOT NULL),
direct AS (SELECT DISTINCT * FROM j WHERE kind IS NOT NULL),
inherited AS (SELECT DISTINCT 'kg_edges_by_relation_bucket' AS ref_table, b.edge_id AS ref_key, d.kind, strftime(make_timestamp(epoch_us(b.created_at)), '%Y-%m') AS period
      FROM kg_edges_by_relation_bucket b JOIN direct d ON d.ref_table = 'kg_edges_by_src' AND d.ref_key = b.edge_id),
audited AS (SELECT DISTINCT {_key("memory_id")} AS ref_key, kind FROM p5_3c_cassandra_final_state_audit JOIN direct d ON d.ref_table = 'raw_erk_view' AND d.ref_key = {_key("memory_id")}),
again AS (SELECT DISTINCT {_key("memory_id")} AS ref_key, kind FROM p5_3c_neo4j_final_state_audit JOIN audited d ON d.ref_key = {_key("memory_id")})"""

SQL = {
    "p1_found": f"""
WITH a AS (SELECT 'kg_edges_by_src' AS table_name, {_key("src_id")} AS key_value FROM kg_edges_by_src
           UNION ALL SELECT 'kg_edges_by_relation_bucket', {_key("relation")} FROM kg_edges_by_relation_bucket),
t AS (SELECT table_name, count(*) AS whole FROM a GROUP BY 1)
SELECT a.table_name, a.key_value FROM a JOIN t USING (table_name) WHERE key_value IS NOT NULL GROUP BY 1, 2, whole HAVING count(*) >= 0.04 * whole""",
    "p1_source_profile": _profile_sql("kg_edges_by_src", "src_id"),
    "p1_relation_profile": _profile_sql("kg_edges_by_relation_bucket", "relation"),
    "p2_found": CURRENT_SQL + " SELECT memory_id, version, update_id FROM live",
    "p2_current_by_graph": CURRENT_SQL + " SELECT graph_id, operation, count(*) AS n_memories, CAST(max(version) AS BIGINT) AS max_version FROM live GROUP BY ALL",
    "p4_found": _DIFFERENCE_SQL + " SELECT * FROM found",
    "p4_differences": _RESIDUE_SQL,
    "p5_found": _ORPHAN_SQL + " SELECT * FROM direct",
    "p5_orphans_by_period": _ORPHAN_SQL
    + """ SELECT ref_table, kind, 'direct' AS origin, 0 AS depth, period, count(*) AS n_refs FROM direct GROUP BY ALL
UNION ALL SELECT ref_table, kind, 'inherited', 1, period, count(*) FROM inherited GROUP BY ALL
UNION ALL SELECT 'p5_3c_cassandra_final_state_audit', kind, 'inherited', 1, NULL, count(*) FROM audited GROUP BY ALL
UNION ALL SELECT 'p5_3c_neo4j_final_state_audit', kind, 'inherited', 2, NULL, count(*) FROM again GROUP BY ALL""",
}
