"""Signals of a memory drawn from its edges, and rankings that use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators.skew import salted_join
from graphloom.session import cut

# fixed values: tokens of a question that ask for a relation
RELATION_WORDS = "went bought met talked liked visited attended worked lived called gave asked told remembered saw found lost sold read wrote learned taught moved traveled started finished".split()

_SINGLE = "^[a-z0-9]{2,}$"


def is_anchor(token: Column) -> Column:
    """An entity-like token that is neither a relation nor a temporal word."""
    return X.is_entity_like(token) & ~token.isin(*RELATION_WORDS, *X.TEMPORAL_WORDS)


def memory_signals(features: DataFrame, edges: DataFrame) -> DataFrame:
    """``(scope, doc_id, n_edges, n_anchors, temporal)`` of every memory that has edges."""
    counts = edges.groupBy("scope", "doc_id").agg(F.count(F.lit(1)).alias("n_edges"))
    tokens = features.groupBy("scope", "doc_id").agg(F.sum(F.when(is_anchor(F.col("token")), F.col("is_entity")).otherwise(0)).alias("n_anchors"), F.max(F.col("token").isin(*X.TEMPORAL_WORDS).cast("int")).alias("temporal"))
    return counts.join(tokens, ["scope", "doc_id"], "left").select("scope", "doc_id", "n_edges", F.coalesce("n_anchors", F.lit(0)).alias("n_anchors"), F.coalesce("temporal", F.lit(0)).alias("temporal"))


def salience(memories: DataFrame, signals: DataFrame, keywords: list[str]) -> DataFrame:
    """``(scope, doc_id, salience)``, at most 3: edges 1, temporal .5, two anchors .5, a keyword in the text .5 and .3, three anchors .3."""
    word = F.arrays_overlap(X.tokens(F.col("text")), F.array(*map(F.lit, keywords))).cast("int")
    rows = memories.join(signals, ["scope", "doc_id"], "left")
    n = F.coalesce("n_anchors", F.lit(0))
    score = F.col("n_edges").isNotNull().cast("int") * 1.0 + 0.5 * F.coalesce("temporal", F.lit(0)) + 0.5 * (n >= 2).cast("int") + 0.8 * word + 0.3 * (n >= 3).cast("int")
    return rows.select("scope", "doc_id", F.round(F.least(F.lit(3.0), score), 6).alias("salience"))


def selective(ranking: DataFrame, saliences: DataFrame, percent: int, k: int = 10) -> DataFrame:
    """The ranking with its most salient ``percent`` first, each part in its old order: ``(query_id, rank, doc_id)``."""
    rows = ranking.join(saliences.select("doc_id", "salience"), "doc_id", "left").withColumn("_s", F.coalesce("salience", F.lit(0.0)))
    by = Window.partitionBy("query_id")
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(by)).withColumn("_r", F.row_number().over(by.orderBy(F.desc("_s"), "rank")))
    kept = (F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * percent / 100))) & (F.col("_s") > 0)
    return rows.withColumn("_rank", F.row_number().over(by.orderBy(F.when(kept, 0).otherwise(1), "rank"))).where(F.col("_rank") <= k).select("query_id", F.col("_rank").alias("rank"), "doc_id")


def graph_native(queries: DataFrame, features: DataFrame, edges: DataFrame, signals: DataFrame) -> DataFrame:
    """``(scope, query_id, doc_id, score)``: memories found by the graph alone.

    Candidates share an anchor or a relation word with the query, or an anchor
    of a neighbour of one (only ids that are a single token have such
    neighbours). Score: 2 x share of anchors + 1.5 x share of relation words +
    1 for temporal on both sides + 1 for two shared anchors + ln(1 + edges)
    - 0.3 x path length (1 with a shared anchor, else 2).
    """
    # written, as they are counted for hot tokens and joined twice
    features = cut(features, "features")
    asked = queries.select("scope", "query_id", F.array_distinct(X.tokens(F.col("text"))).alias("_t"))
    asked = asked.select("scope", "query_id", F.size(F.filter("_t", is_anchor)).alias("na"), F.size(F.filter("_t", lambda t: t.isin(*RELATION_WORDS))).alias("nr"), X.is_temporal(F.col("_t")).alias("timed"), F.explode("_t").alias("token"))
    flags = asked.withColumn("a", is_anchor(F.col("token"))).withColumn("r", F.col("token").isin(*RELATION_WORDS)).where("a or r")
    direct = salted_join(features, flags, ["scope", "token"], "doc_id", "inner").select("scope", "query_id", "doc_id", "na", "nr", "timed", (F.col("a").cast("int") * F.col("is_entity")).alias("ea"), (F.col("r").cast("int") * F.col("is_relation")).alias("er"))
    pairs = edges.select("scope", F.lower("src_id").alias("token"), F.lower("dst_id").alias("other")).where(F.col("token").rlike(_SINGLE) & F.col("other").rlike(_SINGLE))
    pairs = cut(pairs.unionByName(pairs.select("scope", F.col("other").alias("token"), F.col("token").alias("other"))).distinct(), "pairs")
    reached = salted_join(pairs, flags.where("a"), ["scope", "token"], "other", "inner").select("scope", "query_id", F.col("other").alias("token"), "na", "nr", "timed").distinct()
    reached = salted_join(features.where("is_entity = 1"), reached, ["scope", "token"], "doc_id", "inner").select("scope", "query_id", "doc_id", "na", "nr", "timed", F.lit(0).alias("ea"), F.lit(0).alias("er"), F.lit(True).alias("_hop"))
    met = direct.where("ea + er > 0").withColumn("_hop", F.lit(False)).unionByName(reached).groupBy("scope", "query_id", "doc_id", "na", "nr", "timed").agg(F.sum("ea").alias("ea"), F.sum("er").alias("er"))
    met = met.join(signals, ["scope", "doc_id"])
    score = (
        2.0 * F.coalesce(F.col("ea") / F.nullif(F.col("na"), F.lit(0)), F.lit(0.0))
        + 1.5 * F.coalesce(F.col("er") / F.nullif(F.col("nr"), F.lit(0)), F.lit(0.0))
        + (F.col("timed") & (F.col("temporal") == 1)).cast("int")
        + ((F.col("na") >= 2) & (F.col("ea") >= 2)).cast("int")
        + F.log1p("n_edges")
        - 0.3 * F.when(F.col("ea") > 0, 1).otherwise(2)
    )
    return met.select("scope", "query_id", "doc_id", score.alias("score"))


def padded(ranking: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Rankings shorter than ``k`` filled up with further candidates ``(query_id, doc_id)`` in order of id: ``(query_id, rank, doc_id)``."""
    more = candidates.join(ranking.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id", F.lit(None).cast("int").alias("rank"))
    rows = ranking.select("query_id", "doc_id", "rank").unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.col("rank").isNull(), "rank", "doc_id")
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).select("query_id", F.col("_r").alias("rank"), "doc_id")


def prompts(questions: DataFrame, ranking: DataFrame, texts: DataFrame) -> DataFrame:
    """``(query_id, prompt)``: the question under its numbered evidence in order of rank.

    ``questions(query_id, question)``, ``texts(doc_id, text)``. A ranking holds
    a few texts a query, so the list of one query stays small.
    """
    evidence = ranking.join(texts, "doc_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("text", F.lit("")).alias("text")))).alias("_e"))
    numbered = F.transform(F.coalesce("_e", F.array().cast("array<struct<rank: int, text: string>>")), lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["text"]))
    rows = questions.join(evidence, "query_id", "left")
    # fixed values: the wording of the prompt
    head = "Answer the question using only the evidence below.\nIf the evidence does not contain the answer, respond exactly with 'Cannot answer'.\nReturn only the shortest answer. Do not explain.\n\nEvidence:\n"
    return rows.select("query_id", F.concat(F.lit(head), F.array_join(numbered, "\n\n"), F.lit("\n\nQuestion: "), F.coalesce("question", F.lit("")), F.lit("\nAnswer:")).alias("prompt"))
