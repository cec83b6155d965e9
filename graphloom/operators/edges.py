"""Labelled edges with a portable logical identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.chunked_keys import number_rows

IDENTITY = ["graph_id", "src_id", "relation", "dst_id", "source"]
REQUIRED = IDENTITY[:4]


def trimmed(column: str) -> Column:
    return F.regexp_replace(F.col(column), r"^\s+|\s+$", "")


def logical_edge_id(columns: list[str] | None = None) -> Column:
    """``L`` and 24 hex digits of the SHA-1 of the compact JSON array of the identity columns; null counts as empty."""
    parts = F.array(*[F.coalesce(F.col(c), F.lit("")) for c in columns or IDENTITY])
    return F.concat(F.lit("L"), F.substring(F.sha1(F.to_json(parts)), 1, 24))


def canonical_edges(df: DataFrame, identity: list[str] | None = None) -> DataFrame:
    """One row for each logical edge: ``(*identity, logical_edge_id, copies)``.

    Values are trimmed, a null source is empty, rows without one of the
    required values are left out, and physical ids, times and other columns
    play no part. Equal rows are counted in ``copies`` before the shuffle.
    """
    identity = identity or IDENTITY
    rows = df.select(*[F.coalesce(trimmed(c), F.lit("")).alias(c) for c in identity])
    for name in identity:
        if name in REQUIRED:
            rows = rows.where(F.col(name) != "")
    return rows.groupBy(*identity).agg(F.count(F.lit(1)).alias("copies")).withColumn("logical_edge_id", logical_edge_id(identity))


def duplicate_edges(edges: DataFrame) -> DataFrame:
    """Logical edges stored more than once."""
    return edges.where("copies > 1")


def md5_bucket(column: Column, buckets: int) -> Column:
    """The first 8 hex digits of the MD5, modulo ``buckets``."""
    return F.conv(F.substring(F.md5(column), 1, 8), 16, 10).cast("bigint") % buckets


def sha256_bucket(column: Column, bits: int) -> Column:
    """The SHA-256 modulo 2 to the power of ``bits``, up to 32: its lowest bits."""
    return F.conv(F.substring(F.sha2(column, 256), 57, 8), 16, 10).cast("bigint") % (1 << bits)


def with_inverse(edges: DataFrame, mark: str = "~") -> DataFrame:
    """Edges in both directions; the inverse of a relation bears ``mark``."""
    forward = edges.select(*IDENTITY)
    return forward.unionByName(forward.select("graph_id", F.col("dst_id").alias("src_id"), F.concat(F.lit(mark), "relation").alias("relation"), F.col("src_id").alias("dst_id"), "source"))


def out_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("graph_id", "src_id").agg(F.count(F.lit(1)).alias("degree"), F.countDistinct("relation").alias("relations"))


def degree_summary(edges: DataFrame, high: int) -> DataFrame:
    """For each graph: sources, edges, least, median and greatest out-degree, and sources of at least ``high`` edges."""
    return out_degrees(edges).groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("n_sources"), F.sum("degree").alias("n_edges"), F.min("degree").alias("min_degree"), F.percentile("degree", F.lit(0.5)).alias("p50_degree"), F.max("degree").alias("max_degree"), F.sum((F.col("degree") >= high).cast("bigint")).alias("n_high")
    )


def in_degrees(edges: DataFrame) -> DataFrame:
    """The reverse lookup of every destination: edges, sources and relations that lead to it."""
    return edges.groupBy("graph_id", "dst_id").agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("src_id").alias("n_sources"), F.countDistinct("relation").alias("n_relations"))


def relation_histogram(edges: DataFrame) -> DataFrame:
    """Edges of each relation and their share in the whole."""
    whole = edges.agg(F.count(F.lit(1)).alias("_whole"))
    counts = edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n_edges"))
    return counts.join(F.broadcast(whole)).select("relation", "n_edges", F.round(F.col("n_edges") / F.col("_whole"), 6).alias("share"))


def relation_selectivity(edges: DataFrame, relation: str) -> DataFrame:
    """For each source: edges that a scan of the source reads, and those of ``relation`` that an index on it returns."""
    hit = (F.col("relation") == relation).cast("bigint")
    return edges.groupBy("graph_id", "src_id").agg(F.count(F.lit(1)).alias("raw_edges"), F.sum(hit).alias("returned_edges")).withColumn("selectivity", F.round(F.col("returned_edges") / F.col("raw_edges"), 6))


def neighbour_counts(edges: DataFrame) -> DataFrame:
    """Distinct neighbours of every entity, whichever way the edge points."""
    pairs = edges.select("graph_id", F.col("src_id").alias("entity"), F.col("dst_id").alias("other")).unionByName(edges.select("graph_id", F.col("dst_id").alias("entity"), F.col("src_id").alias("other"))).distinct()
    return pairs.groupBy("graph_id", "entity").agg(F.count(F.lit(1)).alias("n_neighbours"))


# the four access paths of the edge store and their order
LAYOUTS = {
    "by_src": ["graph_id", "src_id", "relation", "dst_id"],
    "by_dst": ["graph_id", "dst_id", "relation", "src_id"],
    "by_relation_bucket": ["graph_id", "relation", "bucket", "src_id", "dst_id"],
    "by_src_relation": ["graph_id", "src_id", "relation", "dst_id"],
}


def write_layouts(edges: DataFrame, folder: str, buckets: int = 16, only: list[str] | None = None) -> dict[str, str]:
    """Write the access paths of the edge store: by source, by destination, by relation bucket, by source and relation.

    Each is distributed and sorted by its own key, so that a filter on the key
    prunes row groups. ``only`` names those wanted. Returns the folder of each
    layout.
    """
    rows = edges.withColumn("bucket", md5_bucket(F.col("src_id"), buckets).cast("int"))
    paths = {}
    for name in only or LAYOUTS:
        order = LAYOUTS[name]
        frame = rows if name == "by_relation_bucket" else rows.drop("bucket")
        paths[name] = f"{folder}/{name}"
        # ranges split a hot source over several files where hashing would not
        frame.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(paths[name])
    return paths


def validate_layouts(spark: SparkSession, edges: DataFrame, paths: dict[str, str]) -> DataFrame:
    """``(layout, n_rows, n_tested, n_found, amplification)``: whether each layout finds the edges again that were written.

    Tested are the edges of every source whose number is divisible by 50, by
    all their columns. ``amplification`` is how many rows are written for an
    edge.
    """
    tested = edges.where(F.regexp_extract("src_id", r"(\d+)$", 1).try_cast("bigint") % 50 == 0).select(*IDENTITY).distinct()
    rows = None
    for name, path in paths.items():
        layout = spark.read.parquet(path)
        found = tested.join(layout.select(*IDENTITY), IDENTITY, "left_semi").agg(F.count(F.lit(1)).alias("n_found"))
        part = layout.agg(F.count(F.lit(1)).alias("n_rows")).join(F.broadcast(found)).join(F.broadcast(tested.agg(F.count(F.lit(1)).alias("n_tested"))))
        part = part.select(F.lit(name).alias("layout"), "n_rows", "n_tested", "n_found", F.lit(len(paths)).alias("amplification"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def read_relation(spark: SparkSession, path: str, seeds: DataFrame, relation: str) -> DataFrame:
    """Edges of ``seeds(graph_id, src_id)`` with one relation from the layout by source and relation; the filter reaches the scan."""
    return spark.read.parquet(path).where(F.col("relation") == relation).join(seeds, ["graph_id", "src_id"], "left_semi").select(*IDENTITY)


def skewed_sequence(degrees: DataFrame, draws: int, hot_share: float = 0.05, seed: int = 42) -> DataFrame:
    """``(draw, graph_id, src_id)``: a reproducible stream of seeds, four of five among the ``hot_share`` of sources with most edges.

    Sources are numbered in order of degree over all partitions; a draw meets
    its source by number.
    """
    order = F.concat_ws("\u0001", F.lpad((F.lit(2**62) - F.col("degree")).cast("string"), 20, "0"), "graph_id", "src_id")
    numbered = number_rows(degrees, order, payload=["graph_id", "src_id"]).select("row", "graph_id", "src_id")
    whole = degrees.agg(F.count(F.lit(1)).alias("_n"))
    number = lambda start: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), start, 8), 16, 10).cast("bigint")
    hot = F.greatest(F.lit(1), F.floor(F.col("_n") * hot_share))
    spots = degrees.sparkSession.range(draws).join(F.broadcast(whole)).where("_n > 0")
    spots = spots.select(F.col("id").alias("draw"), F.when(number(1) % 5 < 4, number(9) % hot).otherwise(number(9) % F.col("_n")).alias("row"))
    return numbered.join(spots, "row").select("draw", "graph_id", "src_id")
