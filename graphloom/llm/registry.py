"""Queries on the corpus, each over all documents and their whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.keys import as_key
from graphloom.llm import leakage, packing, reading_level, relative_quantiles
from graphloom.sources.tables import table

GROUP = ["experiment", "mode", "hop"]


def _daily_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """One sketch of latency for each group and day, which any other days can be merged with later."""
    rows = table(spark, sf, "b2a_raw").where("error = 0 and latency_ms >= 0 and not isnan(latency_ms)")
    by = {"experiment": F.col("experiment"), "mode": as_key("mode"), "hop": F.col("hop"), "run_day": F.col("run_day")}
    return relative_quantiles.merge_sketches(relative_quantiles.sketch(rows, by, F.col("latency_ms")), list(by))


def _bands(sketches: DataFrame, by: list[str], percents: list[int]) -> DataFrame:
    rows = relative_quantiles.percentiles(sketches, by, percents)
    return rows.where("value > 0 and value < double('infinity')").select(*by, "pct", F.floor(F.log2("value")).cast("int").alias("band"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """The power of two below the 50th, 90th and 99th percentile of latency, from merged sketches of the days."""
    return _bands(relative_quantiles.merge_sketches(_daily_sketches(spark, sf), GROUP), GROUP, [50, 90, 99])


def p3_daily_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """The same of each day, from the sketches that p3_found merges; exact where a day has few rows."""
    return _bands(_daily_sketches(spark, sf), [*GROUP, "run_day"], [50, 90, 99])


def p6_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's place in the containers."""
    return packing.pack(packing.token_counts(table(spark, sf, "documents")))


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers of each size are, and how even the step groups."""
    return packing.fill_report(p6_packing(spark, sf))


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Each container: its size, texts, tokens and unused space."""
    rows = p6_packing(spark, sf).where("container_id is not null").groupBy("container_id", "capacity", "step_group").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("tokens").alias("tokens"))
    return rows.withColumn("unused", F.col("capacity") - F.col("tokens"))


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf, "documents"), table(spark, sf, "heldout_items"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold part of an item."""
    return _leaks(spark, sf).select("doc_id", "item_id")


def p7_items(spark: SparkSession, sf: str) -> DataFrame:
    """For each leaked item: documents that hold part of it or all of it, and the greatest containment."""
    contained = F.col("shared_windows") / F.col("item_windows")
    return _leaks(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.sum((contained == 1).cast("bigint")).alias("n_whole"), F.max(contained).alias("max_containment"))


def p7_documents(spark: SparkSession, sf: str) -> DataFrame:
    """For each document concerned: how many items leaked into it, how many of them whole, and the greatest containment."""
    contained = F.col("shared_windows") / F.col("item_windows")
    return _leaks(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum((contained == 1).cast("bigint")).alias("n_whole"), F.max(contained).alias("max_containment"))


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    return reading_level.reading_levels(table(spark, sf, "documents"), table(spark, sf, "reading_labels"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """The reading level of every document of English prose."""
    return _levels(spark, sf).select("doc_id", "level")


def p8_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and words of prose by source and level."""
    source = table(spark, sf, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "source")
    return _levels(spark, sf).join(source, "doc_id").groupBy("source", "level").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("prose_words").alias("prose_words"))


QUERIES = {f.__name__: f for f in (p3_found, p3_daily_percentiles, p6_packing, p6_containers, p6_fill, p7_found, p7_documents, p7_items, p8_found, p8_profile)}

_MODE = "nullif(lower(regexp_replace(mode, '^\\s+|\\s+$', '', 'g')), '')"


def _bands_sql(by: str) -> str:
    return f"""
WITH b AS (SELECT experiment, {_MODE} AS mode, hop, run_day, latency_ms FROM b2a_raw WHERE error = 0 AND latency_ms >= 0 AND NOT isnan(latency_ms)),
q AS (SELECT {by}, unnest([50, 90, 99]) AS pct, unnest(quantile_disc(latency_ms, [0.5, 0.9, 0.99])) AS p FROM b GROUP BY {by})
SELECT {by}, CAST(pct AS INTEGER) AS pct, CAST(floor(log2(p)) AS INTEGER) AS band FROM q WHERE p > 0 AND NOT isinf(p)"""


#: Tokenising, text folding and fitted models have no SQL; tests/llm compares those queries with brute force and held-out labels.
SQL: dict[str, str] = {"p3_found": _bands_sql("experiment, mode, hop"), "p3_daily_percentiles": _bands_sql("experiment, mode, hop, run_day")}
