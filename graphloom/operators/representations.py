"""Texts made from memories for indexes, prompts and searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators.evidence import first_of_each

REPRESENTATIONS = ("raw", "summary", "raw_summary", "triples", "raw_triples", "erk_only", "raw_erk")


def merged_features(memories: DataFrame, features: dict[str, DataFrame], key: str = "memory_id") -> DataFrame:
    """``memories`` with a column for each of ``features`` (name to ``(key, text)``), null where there is none.

    Of several texts of a key the greatest is taken, so that no memory is repeated.
    """
    rows = memories
    for name, frame in features.items():
        rows = rows.join(frame.groupBy(key).agg(F.max("text").alias(name)), key, "left")
    return rows


def represented(df: DataFrame) -> DataFrame:
    """Each of ``df(..., raw, summary, entities, relations, keywords, triples)`` in seven representations: ``representation`` and ``text``.

    Missing parts count as empty. Without triples ``triples`` and
    ``raw_triples`` are the raw text; ``summary`` stays a bare heading.
    """
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    raw, summary, triples = part("raw"), F.concat(F.lit("Summary: "), part("summary")), part("triples")
    erk = F.concat_ws("\n", *[F.when(part(c) != "", F.concat(F.lit(f"{c.capitalize()}: "), F.col(c))) for c in ("entities", "relations", "keywords")])
    below = lambda a, b: F.concat(a, F.lit("\n"), b)
    texts = {"raw": raw, "summary": summary, "raw_summary": below(raw, summary), "triples": F.when(triples != "", triples).otherwise(raw), "raw_triples": F.when(triples != "", below(raw, triples)).otherwise(raw), "erk_only": erk, "raw_erk": below(raw, erk)}
    every = F.explode(F.array(*[F.struct(F.lit(n).alias("representation"), texts[n].alias("text")) for n in REPRESENTATIONS]))
    return df.select("*", every.alias("_x")).select(*df.columns, "_x.representation", "_x.text")


# fixed values: how many entities, relations, triples and keywords an enriched text names
LIMITS = {"entities": 15, "relations": 10, "triples": 10, "keywords": 20}


def enriched(memories: DataFrame, edges: DataFrame) -> DataFrame:
    """``(scope, doc_id, text, n_edges)``: the text of ``memories(scope, doc_id, text)`` with what ``edges`` say of it.

    Distinct entity and relation tokens in order, triples, a mark if any token
    is temporal, and keywords of text and entities. Only the first of each kind
    are gathered, cut before the shuffle, so a memory with very many edges is no
    large value. Memories without edges keep their text.
    """
    by = ["scope", "doc_id"]
    triple = F.concat(F.lit("("), F.concat_ws(", ", F.coalesce("src_id", F.lit("")), F.coalesce("relation", F.lit("")), F.coalesce("dst_id", F.lit(""))), F.lit(")"))
    tokens = lambda *c: F.concat(*[X.tokens(F.col(x)) for x in c])

    def listed(rows: DataFrame, name: str, mark: str) -> DataFrame:
        first = first_of_each(rows.where("value is not null").distinct(), by, ["value"], LIMITS[name])
        return first.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("value")), mark).alias(name))

    of = lambda c: edges.select(*by, c.alias("value"))
    entities = listed(of(F.explode_outer(tokens("src_id", "dst_id"))), "entities", ", ")
    relations = listed(of(F.explode_outer(tokens("relation"))), "relations", ", ")
    triples = listed(of(triple), "triples", "; ")
    flags = edges.groupBy(*by).agg(F.count(F.lit(1)).alias("n_edges"), F.max(X.is_temporal(tokens("src_id", "relation", "dst_id"))).alias("_timed"))
    rows = memories.join(flags, by, "left")
    for part in (entities, relations, triples):
        rows = rows.join(part, by, "left")
    text = F.coalesce("text", F.lit(""))
    keywords = F.array_join(F.slice(F.array_sort(F.array_distinct(F.concat(X.tokens(F.col("text")), X.tokens(F.col("entities"))))), 1, LIMITS["keywords"]), ", ")
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(c, F.lit("")))
    whole = F.concat_ws("\n", text, line("Entities", F.col("entities")), line("Relations", F.col("relations")), line("Triples", F.col("triples")), F.when(F.col("_timed"), "Temporal: true"), line("Keywords", keywords))
    return rows.select(*by, F.when(F.col("n_edges").isNull(), text).otherwise(whole).alias("text"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def rendered(fields: dict[str, Column], text: Column) -> Column:
    """``name=value | ...`` of the fields that are not blank, and the text on its own line; the text alone without any."""
    value = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit("")))
    head = F.concat_ws(" | ", *[F.when(value(c) != "", F.concat(F.lit(f"{name}="), value(c))) for name, c in fields.items()])
    return F.when(head != "", F.concat(head, F.lit("\nText: "), value(text))).otherwise(value(text))


def truncated(text: Column, limit: int) -> Column:
    """The trimmed text, or its first ``limit`` characters without trailing blanks and three dots."""
    text = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, limit)), F.lit("...")))


def flattened(observations: Column, limit: int = 8) -> Column:
    """``- speaker: fact`` lines of a map from speakers to lists of facts, blank ones left out, at most ``limit``."""
    lines = F.flatten(F.transform(F.map_entries(observations), lambda e: F.transform(F.filter(e["value"], lambda f: F.trim(f) != ""), lambda f: F.concat(F.lit("- "), e["key"], F.lit(": "), F.trim(f)))))
    return F.slice(F.coalesce(lines, F.array().cast("array<string>")), 1, limit)


def search_query(text: Column, most: int = 6) -> Column:
    """The first words of a text as a disjunction for a full-text index: ``"a1" OR "b2"``; ``""`` without any.

    Words are runs of ASCII letters, digits and underscores, or of Chinese characters, of at least two.
    """
    words = F.slice(F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z0-9_]+|[一-鿿]+)"), 1), lambda w: F.length(w) > 1), 1, most)
    return F.when(F.size(words) > 0, F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR ")).otherwise('""')
