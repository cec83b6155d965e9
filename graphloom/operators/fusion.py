"""Fusion and reranking of rankings ``(query_id, rank, doc_id, score)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from graphloom.operators.evaluation import percentile_definitions
from graphloom.operators.retrieval import top_k
from graphloom.session import cut

_FLOOR = 1e-9


def _list() -> WindowSpec:
    return Window.partitionBy("query_id")


def reciprocal_rank(rankings: list[tuple[DataFrame, float]], k: float = 60.0) -> DataFrame:
    """``sum(weight / (k + rank))`` over the rankings that list a document: ``(query_id, doc_id, score)``."""
    rows = None
    for ranking, weight in rankings:
        part = ranking.select("query_id", "doc_id", (F.lit(float(weight)) / (F.lit(float(k)) + F.col("rank"))).alias("_s"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("query_id", "doc_id").agg(F.sum("_s").alias("score"))


def _both(first: DataFrame, second: DataFrame) -> DataFrame:
    a = first.select("query_id", "doc_id", F.col("rank").alias("ra"), F.col("score").alias("sa"))
    b = second.select("query_id", "doc_id", F.col("rank").alias("rb"), F.col("score").alias("sb"))
    return a.join(b, ["query_id", "doc_id"], "full")


def weighted_reciprocal_rank(first: DataFrame, second: DataFrame, alpha: float = 0.5, k: float = 10.0, absent: int = 999) -> DataFrame:
    """``alpha / (k + rank) + (1 - alpha) / (k + rank)``; a list that lacks the document counts as rank ``absent``."""
    rank = lambda c: F.coalesce(F.col(c), F.lit(absent)) + k
    return _both(first, second).select("query_id", "doc_id", (alpha / rank("ra") + (1 - alpha) / rank("rb")).alias("score"))


def _fused(first: DataFrame, second: DataFrame, alpha: float, shift: Column, spread: Column) -> DataFrame:
    def part(ranking: DataFrame, name: str) -> DataFrame:
        low = F.min("score").over(_list())
        scaled = (F.col("score") - shift) / spread
        return ranking.select("query_id", "doc_id", scaled.alias(name), ((low - shift) / spread).alias(f"{name}_low"))

    a, b = part(first, "a"), part(second, "b")
    both = a.join(b, ["query_id", "doc_id"], "full")
    # the least of a list stands for a document that it lacks; without a list, 0
    value = lambda c: F.coalesce(F.col(c), F.max(f"{c}_low").over(_list()), F.lit(0.0))
    return both.select("query_id", "doc_id", (alpha * value("a") + (1 - alpha) * value("b")).alias("score"))


def z_score(first: DataFrame, second: DataFrame, alpha: float = 0.6) -> DataFrame:
    """Scores in sample standard deviations from the mean of their list, mixed by ``alpha``.

    A list of one has deviation 1, a flat one 1e-9; a document missing from a
    list has that list's least score.
    """
    deviation = F.when(F.count("score").over(_list()) > 1, F.greatest(F.stddev_samp("score").over(_list()), F.lit(_FLOOR))).otherwise(1.0)
    return _fused(first, second, alpha, F.avg("score").over(_list()), deviation)


def min_max(first: DataFrame, second: DataFrame, alpha: float = 0.6) -> DataFrame:
    """Scores by their place between the least and greatest of their list, mixed by ``alpha``."""
    low, high = F.min("score").over(_list()), F.max("score").over(_list())
    return _fused(first, second, alpha, low, F.greatest(high - low, F.lit(_FLOOR)))


def boosted(scores: DataFrame, flagged: DataFrame, weight: float) -> DataFrame:
    """``score + weight`` for the documents of ``flagged(scope, doc_id)``; scores hold ``scope`` too."""
    flags = flagged.select("scope", "doc_id").distinct().withColumn("_f", F.lit(1))
    return scores.join(flags, ["scope", "doc_id"], "left").withColumn("score", F.col("score") + weight * F.coalesce("_f", F.lit(0))).drop("_f")


def reranked(base: DataFrame, extra: DataFrame, weight: float) -> DataFrame:
    """The listed documents by min-max of their score (1 for a flat list) plus ``weight`` times ``kg_score`` of ``extra``."""
    low, high = F.min("score").over(_list()), F.max("score").over(_list())
    norm = F.when(high - low < _FLOOR, 1.0).otherwise((F.col("score") - low) / (high - low))
    rows = base.withColumn("_n", norm).join(extra.select("query_id", "doc_id", "kg_score"), ["query_id", "doc_id"], "left")
    return rows.select("query_id", "doc_id", (F.col("_n") + weight * F.coalesce("kg_score", F.lit(0.0))).alias("score"))


def gated(base: DataFrame, rerank: DataFrame, top: float = 0.75, gap: float = 0.75, k: int = 10) -> DataFrame:
    """Reranking only where the base is unsure.

    A query keeps its base list if its best score and the gap to the second
    exceed the ``top`` and ``gap`` quantiles of all queries (in whole percent).
    """
    best = base.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("_top"), (F.max(F.when(F.col("rank") == 1, F.col("score"))) - F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0))).alias("_gap"))
    best = cut(best, "best")
    # one row each
    limit = lambda c, share, name: F.broadcast(percentile_definitions(best, [], c, [round(share * 100)], None).select(F.col("linear").alias(name)))
    sure = best.join(limit("_top", top, "_tq")).join(limit("_gap", gap, "_gq")).where((F.col("_top") > F.col("_tq")) & (F.col("_gap") > F.col("_gq"))).select("query_id")
    kept = base.where(F.col("rank") <= k).join(sure, "query_id", "left_semi").select("query_id", "rank", "doc_id")
    changed = top_k(rerank, k).join(sure, "query_id", "left_anti").select("query_id", "rank", "doc_id")
    return kept.unionByName(changed)
