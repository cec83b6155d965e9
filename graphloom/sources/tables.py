"""The project's Parquet tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def identifier(name: str) -> str:
    """``name`` if it is a plain identifier, so that it can stand in a path or statement; anything else is refused."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]{0,127}", name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder/name.parquet``, a file or a folder of files."""
    return spark.read.parquet(f"{folder}/{identifier(name)}.parquet")
