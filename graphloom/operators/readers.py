"""Outcomes of answers given from retrieved evidence, and of rankings against gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as X


def wrong_abstentions(abstains: Column, f1: Column, gold: Column) -> dict[str, Column]:
    """Two definitions: an abstention where there is a gold answer, and one that also shares no word with it."""
    plain = abstains & (X.relaxed_answer(gold) != "")
    return {"wrong_abstention": plain.cast("int"), "wrong_abstention_f1": (plain & (f1 == 0)).cast("int")}


def adversarial_outcome(prediction: Column, adversarial: Column) -> Column:
    """What an answer to a question without an answer is.

    ``abstained``; ``leaked`` if it contains the adversarial answer;
    ``new_fact`` if it has none of that answer's first three words, else
    ``partial``. Without an adversarial answer nothing can leak: ``unknown``.
    """
    said, trap = X.relaxed_answer(prediction), X.relaxed_answer(adversarial)
    shares = F.exists(F.slice(F.split(trap, " "), 1, 3), lambda w: F.contains(said, w))
    return F.when(X.abstains(prediction), "abstained").when(trap == "", "unknown").when(F.contains(said, trap), "leaked").when(shares, "partial").otherwise("new_fact")


def answer_in_evidence(evidence: Column, answer: Column) -> Column:
    """Whether the answer, in relaxed form, stands in the evidence; null without an answer."""
    wanted = X.relaxed_answer(answer)
    return F.when(wanted != "", F.contains(X.relaxed_answer(evidence), wanted))


def rank_label(rank: Column, k: int = 10) -> Column:
    """A gold rank as text: the rank up to ``k``, ``>k`` beyond it, ``none`` without any."""
    return F.when(rank.isNull(), "none").when(rank > k, f">{k}").otherwise(rank.cast("string"))


def win_tie_loss(first: DataFrame, second: DataFrame, key: str, value: str, group: str) -> DataFrame:
    """``(group, n, wins, ties, losses)`` of ``second`` against ``first`` over the keys of both; ``first`` has the group."""
    rows = first.select(key, group, F.col(value).alias("_a")).join(second.select(key, F.col(value).alias("_b")), key)
    n = lambda c: F.sum(c.cast("bigint"))
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), n(F.col("_b") > F.col("_a")).alias("wins"), n(F.col("_b") == F.col("_a")).alias("ties"), n(F.col("_b") < F.col("_a")).alias("losses"))


def changed_share(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """``(n, n_changed, share)``: keys for which two runs give different values."""
    rows = first.select(key, F.col(value).alias("_a")).join(second.select(key, F.col(value).alias("_b")), key)
    changed = (~F.col("_a").eqNullSafe(F.col("_b"))).cast("bigint")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(changed).alias("n_changed"), F.round(F.avg(changed), 6).alias("share"))


def metric_differences(old: DataFrame, new: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """``(*keys, metric, old, new, delta, relative)`` of rows on both sides; ``relative`` in percent, 0 where the old value is 0."""
    side = lambda df, tag: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(tag)) for m in metrics])).alias("x")).select(*keys, "x.*")
    a, b = side(old, "old"), side(new, "new")
    named = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_{k}") for k in keys]
    both = a.select("*", *named).join(b.select("metric", "new", *named), ["metric", *[f"_{k}" for k in keys]])
    delta = F.col("new") - F.col("old")
    return both.select(*keys, "metric", "old", "new", F.round(delta, 6).alias("delta"), F.round(F.when(F.col("old") != 0, delta / F.abs("old") * 100).otherwise(0.0), 2).alias("relative"))


def covered_lists(ranking: DataFrame, covered: DataFrame) -> DataFrame:
    """``(query_id, n, n_covered, share)``: how many of a list's documents are among ``covered(doc_id)``."""
    flags = covered.select("doc_id").distinct().withColumn("_c", F.lit(1))
    rows = ranking.join(flags, "doc_id", "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("_c", F.lit(0))).alias("n_covered"))
    return rows.withColumn("share", F.round(F.col("n_covered") / F.col("n"), 6))


def hard_cases(rows: DataFrame, least_covered: int = 9, most_overlap: int = 3, most_f1: float = 0.1, first: int = 20, whole: int = 40) -> DataFrame:
    """``(query_id, reason)`` for inspection from ``rows(query_id, n_covered, overlap, f1, hit)``, in order of id.

    The first ``first`` queries whose list the graph covers, that shares little
    with the other list and whose answer is poor (``hard``); then hits up to
    ``whole`` in all, at most ``first`` (``hit``).
    """
    hard = rows.where((F.col("n_covered") >= least_covered) & (F.col("overlap") <= most_overlap) & (F.col("f1") <= most_f1)).select("query_id").distinct().orderBy("query_id").limit(first)
    hits = rows.where("hit = 1").select("query_id").distinct().join(hard, "query_id", "left_anti").orderBy("query_id").limit(min(first, whole - first))
    return hard.withColumn("reason", F.lit("hard")).unionByName(hits.withColumn("reason", F.lit("hit")))


def best_cell(cells: DataFrame, order: list[Column]) -> DataFrame:
    """The one row of ``cells`` that comes first in ``order``; there are few of them."""
    return cells.orderBy(*order).limit(1)


def upper_median(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """``(*by, n, median, iqr)`` by elements of the sorted list: the upper median, and the element at 3/4 less that at 1/4.

    For five values the spread is that of the fourth and the second. Meant for
    a few values a group, such as one for each day or repetition.
    """
    order = Window.partitionBy(*by).orderBy(value)
    rows = values.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(order) - 1).withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    at = lambda i: F.max(F.when(F.col("_r") == F.floor(i), F.col(value)))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), at(F.col("_k") / 2).alias("median"), (at(F.col("_k") * 3 / 4) - at(F.col("_k") / 4)).alias("iqr"))
