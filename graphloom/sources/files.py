"""Edges, manifests, conversations and embeddings from files, and results into files."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.chunked_keys import number_rows
from graphloom.operators.edges import IDENTITY, REQUIRED, trimmed

# fixed values: the names under which edge files carry a column
ALIASES = {"graph_id": ["graph_id", "graph"], "src_id": ["src_id", "src", "source_id"], "relation": ["relation", "rel", "predicate"], "dst_id": ["dst_id", "dst", "target_id"], "source": ["source", "evidence"], "src_type": ["src_type"], "dst_type": ["dst_type"], "confidence": ["confidence"]}

MANIFEST = "query_id string, graph_id string, seed_id string, relation_path array<string>, hop int, fanout int, op_type string, random_seed long, cycle_policy string, write_edge struct<graph_id: string, src_id: string, relation: string, dst_id: string, source: string>"

CONVERSATION = "sample_id string, conversation map<string, string>"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all columns as text; a byte-order mark in front is no part of the first name."""
    df = spark.read.csv(path, header=True, escape='"', multiLine=True)
    return df.toDF(*[name.lstrip("﻿").strip() for name in df.columns])


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges from a CSV file under any of the known column names.

    A missing source is ``synthetic``, missing types are ``ENTITY``, and a
    confidence that is no number is 1. A file that lacks a required column is
    refused.
    """
    df = read_csv(spark, path)
    have = {name.lower(): name for name in df.columns}

    def column(name: str) -> Column | None:
        there = [F.col(f"`{have[a]}`") for a in ALIASES[name] if a in have]
        return F.nullif(F.trim(F.coalesce(*there)), F.lit("")) if there else None

    missing = [name for name in REQUIRED if column(name) is None]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    default = {"source": "synthetic", "src_type": "ENTITY", "dst_type": "ENTITY"}
    text = lambda name: F.coalesce(*[c for c in (column(name), F.lit(default.get(name))) if c is not None]).alias(name)
    confidence = column("confidence")
    confidence = F.lit(1.0) if confidence is None else F.coalesce(confidence.try_cast("double"), F.lit(1.0))
    return df.select(*[text(n) for n in (*IDENTITY, "src_type", "dst_type")], confidence.alias("confidence"))


def invalid_edges(edges: DataFrame) -> DataFrame:
    """Edges in which a required value is null or blank."""
    bad = F.lit(False)
    for name in REQUIRED:
        bad = bad | F.col(name).isNull() | (trimmed(name) == "")
    return edges.where(bad)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Queries from JSON lines; an empty relation path stands for any relation at each hop."""
    df = spark.read.schema(MANIFEST).json(path)
    anything = F.array_repeat(F.lit("*"), F.coalesce("hop", F.lit(1)))
    return df.withColumns({"relation_path": F.when(F.size(F.coalesce("relation_path", F.array().cast("array<string>"))) > 0, F.col("relation_path")).otherwise(anything), "cycle_policy": F.coalesce("cycle_policy", F.lit("path"))})


def invalid_queries(manifest: DataFrame) -> DataFrame:
    """``(query_id, problem)`` of repeated ids, path lengths unlike the hop count, and hop or fanout below 1."""
    repeated = manifest.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("query_id", F.lit("repeated id").alias("problem"))
    wrong = F.when(F.coalesce("hop", F.lit(0)) < 1, "hop below 1").when(F.coalesce("fanout", F.lit(0)) < 1, "fanout below 1").when(F.size("relation_path") != F.col("hop"), "path length is not the hop count").when(~F.col("cycle_policy").isin("path", "none"), "unknown cycle policy")
    return repeated.unionByName(manifest.select("query_id", wrong.alias("problem")).where("problem is not null"))


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """``(sample_id, session, turn, dia_id, speaker, text, at)``: the turns of nested conversations.

    Sessions are keys ``session_N`` with a list of turns, their times keys
    ``session_N_date_time``.
    """
    raw = spark.read.option("multiLine", True).schema(CONVERSATION).json(path)
    sessions = raw.select("sample_id", F.col("conversation").alias("all"), F.explode("conversation").alias("name", "value")).where(F.col("name").rlike(r"^session_\d+$"))
    number = F.regexp_extract("name", r"(\d+)$", 1).cast("int")
    turns = sessions.select("sample_id", number.alias("session"), F.try_element_at("all", F.concat("name", F.lit("_date_time"))).alias("at"), F.posexplode(F.from_json("value", "array<struct<speaker: string, dia_id: string, text: string>>")).alias("turn", "t"))
    return turns.select("sample_id", "session", (F.col("turn") + 1).alias("turn"), "t.dia_id", "t.speaker", "t.text", F.regexp_replace("at", '^"|"$', "").alias("at"))


def unit_vectors(df: DataFrame, vector: str) -> DataFrame:
    """``vector`` divided by its length; one of no length stays as it is."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return df.withColumn(vector, F.transform(vector, lambda x: x.cast("double") / F.when(length > 0, length).otherwise(1.0)))


def read_vectors(spark: SparkSession, vectors: str, ids: str, vector: str = "embedding") -> DataFrame:
    """``(id, vector)`` of unit length: a Parquet file of vectors with ``position`` and a text file with one id a line.

    The first line is the id at position 0. As many ids as vectors are
    required, no position twice; otherwise the files are refused.
    """
    names = spark.read.text(ids).select(F.monotonically_increasing_id().alias("_at"), F.trim("value").alias("id")).where("id <> ''")
    numbered = number_rows(names, F.lit("ids"), F.col("_at"), payload=["id"]).select(F.col("row").alias("position"), "id")
    held = spark.read.parquet(vectors).select(F.col("position").cast("bigint").alias("position"), vector)
    counts = held.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("position").alias("d")).collect()[0]
    both = numbered.join(held, "position")
    if not counts.n == counts.d == numbered.count() == both.count():
        raise ValueError(f"{ids} and {vectors} do not hold the same positions")
    return unit_vectors(both.select("id", vector), vector)


def write_canonical(edges: DataFrame, path: str) -> None:
    """Logical edges with their portable id as CSV, copies and other columns left out."""
    write_csv(edges, path, [*IDENTITY, "logical_edge_id"])


def write_json(spark: SparkSession, path: str, value: object) -> str:
    """One small JSON document in its final place in one step; returns its SHA-256."""
    text = json.dumps(value, sort_keys=True, ensure_ascii=False).encode()
    jvm = spark.sparkContext._jvm
    target, draft = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.draft")
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = files.create(draft, True)
    stream.write(bytearray(text))
    stream.close()
    files.delete(target, False)
    if not files.rename(draft, target):
        raise OSError(f"could not write {path}")
    return hashlib.sha256(text).hexdigest()


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "overwrite") -> None:
    """The named columns with a header; ``mode`` append adds files."""
    df.select(*columns).write.mode(mode).csv(path, header=True, escape='"')


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines, keys in order of their names."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)
