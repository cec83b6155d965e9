"""Integrity gates: set differences, expected hashes, file fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def set_difference(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, side)``: distinct keys that are ``missing`` in or ``unexpected`` of ``actual``."""
    a, b = expected.select(*keys).distinct(), actual.select(*keys).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("side", F.lit("unexpected")))


def equivalent(expected: DataFrame, actual: DataFrame, keys: list[str]) -> bool:
    """Whether both hold the same set of keys."""
    return set_difference(expected, actual, keys).isEmpty()


def hash_gate(actual: DataFrame, expected: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, passed)``: each expected hash against what is there; an unexpected or missing one fails."""
    a = actual.select(key, F.col(value).alias("_a"))
    return expected.select(key, F.col(value).alias("_e")).join(a, key, "full").select(key, F.coalesce(F.col("_a") == F.col("_e"), F.lit(False)).alias("passed"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length, sha256)`` of every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
