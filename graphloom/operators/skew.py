"""Joins in which a few keys hold a large share of one side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with at least this share of the rows is salted, so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.01
#: Salts for each task's worth of rows that a hot key has, where tasks share the rows evenly.
OVERSPLIT = 2


def hot_keys(df: DataFrame, keys: str | list[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys with at least ``share`` of the rows of ``df``: ``(*keys, salts)``, at most ``1 / share`` rows.

    ``salts`` follows from the share and the number of shuffle tasks: as many
    as give each salt half of what a task gets on average. Counted with partial
    aggregation, so that a hot key is counted where it lies.
    """
    keys = [keys] if isinstance(keys, str) else keys
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    whole = df.agg(F.count(F.lit(1)).alias("_whole"))
    salts = F.greatest(F.lit(2), F.ceil(F.col("_n") / F.col("_whole") * tasks * OVERSPLIT)).cast("int")
    return counts.join(F.broadcast(whole)).where(F.col("_n") >= share * F.col("_whole")).select(*keys, salts.alias("salts"))


def salted_join(rows: DataFrame, few: DataFrame, keys: str | list[str], salt_by: str | Column, how: str = "left", share: float = HOT_SHARE, hot: DataFrame | None = None) -> DataFrame:
    """Join of ``rows`` to ``few`` (a few rows for each key) on ``keys``, left or inner.

    Rows of hot keys are spread by the hash of ``salt_by`` over as many tasks
    as their share asks for; the rows of ``few`` are copied to each. The list
    of hot keys has at most ``1 / share`` rows and is broadcast; all other keys
    are joined as they are. ``hot``, as :func:`hot_keys` gives it, saves
    counting again.
    """
    keys = [keys] if isinstance(keys, str) else keys
    hot = F.broadcast((hot_keys(rows, keys, share) if hot is None else hot).select(*keys, F.col("salts").alias("_salts")))
    salt = F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(salt_by), F.col("_salts"))).otherwise(F.lit(0)).cast("int")
    left = rows.join(hot, keys, "left").withColumn("_salt", salt).drop("_salts")
    right = few.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
