"""Update feeds: applied prefixes, backlogs and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.chunked_keys import number_rows


def applied_prefix(sequences: DataFrame, sequence: str) -> DataFrame:
    """``(checkpoint, n_applied, n_waiting)``: how far the feed is complete without a gap.

    Repeats count once. Sequences are numbered by range partitions and prefix
    sums, so no task sees them all; the prefix is where number and sequence
    advance together.
    """
    distinct = sequences.where(F.col(sequence).isNotNull()).select(F.col(sequence).cast("bigint").alias("s")).distinct()
    rows = number_rows(distinct, F.lit("feed"), F.col("s"))
    lead = rows.withColumn("_d", F.col("at") - F.col("row"))
    first = lead.agg(F.min("_d").alias("_first"))
    done = F.col("_d") == F.col("_first")
    return lead.join(F.broadcast(first)).agg(F.max(F.when(done, F.col("at"))).alias("checkpoint"), F.sum(done.cast("bigint")).alias("n_applied"), F.sum((~done).cast("bigint")).alias("n_waiting"))


def gap_starts(sequences: DataFrame, sequence: str) -> DataFrame:
    """``(missing)``: the first missing number of each gap below the greatest sequence."""
    distinct = sequences.where(F.col(sequence).isNotNull()).select(F.col(sequence).cast("bigint").alias("missing")).distinct()
    last = distinct.agg(F.max("missing").alias("_last"))
    after = distinct.select((F.col("missing") + 1).alias("missing")).join(distinct, "missing", "left_anti")
    return after.join(F.broadcast(last)).where(F.col("missing") < F.col("_last")).select("missing")


def backlog(feed: DataFrame, by: str, arrived: Column, finished: Column, width: str = "1 hour", span: str | None = None) -> DataFrame:
    """``(by, bucket, produced, applied, backlog)``: what arrives and ends in each time bucket, and what is open at its end.

    Arrivals and ends are counted by bucket before the running sum, which
    sees one row for each bucket that has any; between two of them the backlog
    stays. For short buckets ``span`` names a longer unit (such as ``day``):
    sums then run within a span and over the spans before it, so that no task
    sees all buckets of a group.
    """
    rows = feed.select(by, F.explode(F.array(F.struct(arrived.alias("t"), F.lit(1).alias("p"), F.lit(0).alias("a")), F.struct(finished.alias("t"), F.lit(0).alias("p"), F.lit(1).alias("a")))).alias("x")).where("x.t is not null")
    counts = rows.groupBy(by, F.window("x.t", width).start.alias("bucket")).agg(F.sum("x.p").alias("produced"), F.sum("x.a").alias("applied"))
    net = F.col("produced") - F.col("applied")
    if span is None:
        order = Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        return counts.withColumn("backlog", F.sum(net).over(order))
    counts = counts.withColumn("_span", F.date_trunc(span, "bucket"))
    earlier = Window.partitionBy(by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = counts.groupBy(by, "_span").agg(F.sum(net).alias("_net")).select(F.col(by).alias("_by"), F.col("_span").alias("_at"), F.coalesce(F.sum("_net").over(earlier), F.lit(0)).alias("_before"))
    order = Window.partitionBy(by, "_span").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.withColumn("_in", F.sum(net).over(order)).join(spans, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_span") == F.col("_at")))
    return rows.select(by, "bucket", "produced", "applied", (F.col("_before") + F.col("_in")).alias("backlog"))


def version_audit(expected: DataFrame, copies: dict[str, DataFrame], key: str) -> DataFrame:
    """Left joins of ``expected(key, version)`` with the versions of each copy: ``(key, version, <copy>..., passed)``."""
    rows = expected.select(key, "version")
    for name, copy in copies.items():
        rows = rows.join(copy.select(key, F.col("version").alias(name)), key, "left")
    passed = F.lit(True)
    for name in copies:
        passed = passed & F.col(name).eqNullSafe(F.col("version"))
    return rows.withColumn("passed", passed)
