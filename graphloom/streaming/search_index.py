"""Postings of a text index kept up under inserts, updates and deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators.retrieval import Terms, postings


def refresh_postings(index: DataFrame, changed: DataFrame, terms: Terms = X.tokens) -> DataFrame:
    """The postings ``(scope, doc_id, length, term, tf)`` after ``changed(scope, doc_id, text, deleted)``.

    Postings of every changed document go, and those of its new text come
    unless it is deleted; no other text is tokenised. One row for each changed
    document; a null text has no terms, a null ``deleted`` is false.
    """
    kept = index.join(changed.select("scope", "doc_id").distinct(), ["scope", "doc_id"], "left_anti")
    fresh = postings(changed.where("not coalesce(deleted, false)"), terms)
    return kept.select("scope", "doc_id", "length", "term", "tf").unionByName(fresh.select("scope", "doc_id", "length", "term", "tf"))
