"""Per-key results where a few keys hold most of the records.

Hashing rows by key would put a hot key into one task. Here the rows are
range-partitioned on (key, order, arrival), so that a hot key spreads over as
many partitions as it needs. Keys are then counted per partition, prefix sums
give every row its exact number, equal-sized runs of rows are reduced to small
ordered states, and states of one key are merged in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.skew import salted_join
from graphloom.session import cut

CHUNK_ROWS = 100_000

_NUMBERS = ["chunk", "first_row", "n", "n_at", "first_at", "last_at", "longest_gap", "bursts", "n_values", "total"]
_STATE = "key string, " + ", ".join(f"{name} long" for name in _NUMBERS)


def number_rows(df: DataFrame, key: Column, order: Column | None = None, value: Column | None = None, payload: list[str] | None = None) -> DataFrame:
    """Rows of ``df`` in the order (key, ``order``), exactly numbered: ``(key, at, value, *payload, row)``.

    ``key`` is a text; rows whose key is null are left out. ``order`` is a
    number or timestamp (microseconds are kept; fractions are only in a double), ``value`` a whole number; both
    may be null. Equal rows are told apart by their arrival, so that even a key
    with one repeated row can be split. ``row`` counts from 0 over all keys;
    :func:`key_starts` has the number at which each key begins.
    """
    payload = payload or []
    at = F.lit(None).cast("bigint") if order is None else order
    value = F.lit(None).cast("bigint") if value is None else value
    rows = df.select(key.alias("key"), at.alias("at"), value.cast("bigint").alias("value"), *payload)
    if dict(rows.dtypes)["at"].startswith("timestamp"):
        rows = rows.withColumn("at", F.unix_micros(F.col("at").cast("timestamp")))
    if dict(rows.dtypes)["at"] != "double":
        rows = rows.withColumn("at", F.col("at").cast("bigint"))
    rows = rows.where("key is not null").withColumn("arrival", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("key", "at", "arrival").sortWithinPartitions("key", "at", "arrival").drop("arrival")
    # the identifier holds the partition in its upper bits and the row's place in the lower 33
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    rows = rows.select("key", "at", "value", *payload, F.shiftright("place", 33).cast("int").alias("part"), F.col("place").bitwiseAND((1 << 33) - 1).alias("place"))
    rows = cut(rows, "numbered")
    # one row for each partition, so the window without keys and the broadcast stay as small as the number of partitions
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("part", before.alias("before"))
    return rows.join(F.broadcast(offsets), "part").select("key", "at", "value", *payload, (F.col("before") + F.col("place")).alias("row"))


def key_starts(rows: DataFrame) -> DataFrame:
    """For each key of numbered rows the number of its first row and how many it has: ``(key, start, n)``.

    Keys are counted in each partition before the shuffle.
    """
    return rows.groupBy("key").agg(F.min("row").alias("start"), F.count(F.lit(1)).alias("n"))


def places(rows: DataFrame) -> DataFrame:
    """Numbered rows with ``place``, their number within their key from 0, and ``n``, how many the key has.

    A key with many rows meets its one start in as many tasks as it fills.
    """
    return salted_join(rows, key_starts(rows), "key", "row", "inner").withColumn("place", F.col("row") - F.col("start")).drop("start")


def _states(batches: Iterator[pa.RecordBatch], chunk_rows: int, burst_gap: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.string()), *((name, pa.int64()) for name in _NUMBERS)])
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        code = batch.column("key").dictionary_encode()
        codes = code.indices.to_numpy()
        row = batch.column("row").to_numpy()
        chunk = row // chunk_rows
        start = np.empty(n, bool)
        start[0] = True
        start[1:] = (codes[1:] != codes[:-1]) | (chunk[1:] != chunk[:-1]) | (row[1:] != row[:-1] + 1)
        first = np.flatnonzero(start)
        timed = batch.column("at").is_valid().to_numpy(zero_copy_only=False)
        at = pc.fill_null(batch.column("at"), 0).to_numpy()
        valued = batch.column("value").is_valid().to_numpy(zero_copy_only=False)
        value = pc.fill_null(batch.column("value"), 0).to_numpy()
        # nulls sort first, so a gap lies between neighbours of one run that both have a time
        gap = np.zeros(n, np.int64)
        inside = ~start[1:] & timed[1:] & timed[:-1]
        gap[1:][inside] = (at[1:] - at[:-1])[inside]
        burst = gap > burst_gap
        runs = np.add.reduceat
        n_at = runs(timed.astype(np.int64), first)
        low, high = np.iinfo(np.int64).max, np.iinfo(np.int64).min
        first_at = np.minimum.reduceat(np.where(timed, at, low), first)
        last_at = np.maximum.reduceat(np.where(timed, at, high), first)
        n_values = runs(valued.astype(np.int64), first)
        none = n_at == 0
        columns = [
            code.dictionary.take(pa.array(codes[first])),
            pa.array(chunk[first]),
            pa.array(row[first]),
            pa.array(np.diff(np.append(first, n))),
            pa.array(n_at),
            pa.array(first_at, mask=none),
            pa.array(last_at, mask=none),
            pa.array(np.maximum.reduceat(gap, first)),
            pa.array(runs(burst.astype(np.int64), first)),
            pa.array(n_values),
            pa.array(runs(value, first)),
        ]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _merge(states: DataFrame, by: list[str], burst_gap: int) -> DataFrame:
    """Merge ordered states: what lies between two neighbours is the gap from one's end to the other's start."""
    before = F.lag("last_at").over(Window.partitionBy(*by).orderBy("first_row"))
    between = F.coalesce(F.col("first_at") - before, F.lit(0))
    return (
        states.withColumn("between", between)
        .groupBy(*by)
        .agg(
            F.min("first_row").alias("first_row"),
            F.sum("n").alias("n"),
            F.sum("n_at").alias("n_at"),
            F.min("first_at").alias("first_at"),
            F.max("last_at").alias("last_at"),
            F.greatest(F.max("longest_gap"), F.max("between")).alias("longest_gap"),
            (F.sum("bursts") + F.sum((F.col("between") > burst_gap).cast("bigint"))).alias("bursts"),
            F.sum("n_values").alias("n_values"),
            F.sum("total").alias("total"),
        )
    )


def profile_keys(df: DataFrame, key: Column, order: Column | None = None, value: Column | None = None, burst_gap: int = 86_400_000_000, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row for each key: how often, when and how unevenly it occurs.

    Columns: ``key``, ``n`` (rows), ``first_at``, ``last_at`` (of ``order``;
    timestamps in microseconds), ``longest_gap`` between neighbouring rows of
    the key, ``bursts`` (runs of rows with no gap over ``burst_gap``; 0 without
    any order value), ``n_values`` and ``total`` of ``value``. Nulls in
    ``order`` and ``value`` count in ``n`` only. Null keys give no row, an empty
    table gives none. Exact for any skew: no task holds more than a range
    partition's or a chunk's rows of a key.
    """
    rows = number_rows(df, key, order, value).withColumn("at", F.col("at").cast("bigint"))
    states = rows.mapInArrow(lambda batches: _states(batches, chunk_rows, burst_gap), _STATE)
    merged = _merge(_merge(states, ["key", "chunk"], burst_gap), ["key"], burst_gap)
    bursts = F.when(F.col("n_at") > 0, F.col("bursts") + 1).otherwise(0)
    total = F.when(F.col("n_values") > 0, F.col("total"))
    return merged.select("key", "n", "first_at", "last_at", F.when(F.col("n_at") > 0, F.col("longest_gap")).alias("longest_gap"), bursts.alias("bursts"), "n_values", total.alias("total"))


def heavy_keys(df: DataFrame, key: Column, share: float, order: Column | None = None) -> DataFrame:
    """Keys that hold at least ``share`` of all rows, as ``(key, n)``.

    Null keys are no keys but their rows count in the whole. At most
    ``1 / share`` rows come out.
    """
    whole = df.agg(F.count(F.lit(1)).alias("rows"))
    return profile_keys(df, key, order).join(F.broadcast(whole)).where(F.col("n") >= share * F.col("rows")).select("key", "n")
