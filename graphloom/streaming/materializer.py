"""A change feed as a stream: applied exactly once to a delete-vector table, restartable at any point."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.keys import as_key
from graphloom.operators.delete_vectors import DeleteVectorTable, first_deliveries

PAYLOAD = ["update_id", "operation"]


def read_feed(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Files of changes as they arrive in ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def changes(feed: DataFrame) -> DataFrame:
    """Rows of a feed as changes of a :class:`DeleteVectorTable`; rows without memory or version are none."""
    rows = feed.select(as_key("memory_id").alias("key"), "version", "sequence", "update_id", as_key("operation").alias("operation"))
    return rows.where("key is not null and version is not null").withColumn("deletes", F.col("operation").eqNullSafe("delete_memory"))


def placed(earlier: DataFrame | None, rows: DataFrame) -> DataFrame:
    """Changes of ``rows`` that ``earlier`` doesn't have, or has at a higher place, with the key that they stood under before.

    A change stands at its lowest sequence (of equal ones, at the least row, as
    in ``first_deliveries``). Rows without ``update_id`` are changes of their own.
    """
    columns = rows.columns
    image = F.struct(F.col("sequence").isNull().alias("_late"), F.col("sequence").alias("_at"), *[c for c in columns if c != "update_id"])
    both = rows.withColumn("_new", F.lit(True))
    if earlier is not None:
        both = both.unionByName(earlier.select(*columns).withColumn("_new", F.lit(False)))
    places = both.where("update_id is not null").groupBy("update_id").agg(F.min(image).alias("now"), F.min(F.when(~F.col("_new"), image)).alias("was"))
    moved = places.where(F.col("was").isNull() | (F.col("now") < F.col("was")))
    moved = moved.select(*[F.col(c) if c == "update_id" else F.col(f"now.{c}").alias(c) for c in columns], F.col("was.key").alias("old_key"))
    return moved.unionByName(rows.where("update_id is null").withColumn("old_key", F.lit(None).cast("string")))


#: Batches after which superseded images are left behind.
COMPACT_EVERY = 64


class _Log:
    """Changes kept beside the table, as ``batch=N/part=P``: where each change stands, and under which key it stood before.

    Parts follow from the hash of the change's id, so that a batch reads those
    of its own changes; there are as many as the table's index has.
    """

    def __init__(self, spark: SparkSession, folder: str, kinds: str, parts: int) -> None:
        self.spark, self.folder, self.kinds = spark, folder, kinds
        self.part = F.pmod(F.xxhash64("update_id"), F.lit(parts)).cast("int")

    def before(self, number: int, parts: list[int] | None = None) -> DataFrame | None:
        """What batches before ``number`` kept, in some parts or all."""
        if not number:
            return None
        rows = self.spark.read.schema(f"{self.kinds}, old_key string, batch long, part int").parquet(self.folder).where(F.col("batch") < number)
        return rows if parts is None else rows.where(F.col("part").isin(parts))

    def keep(self, rows: DataFrame, number: int) -> DataFrame:
        rows = rows.withColumn("part", self.part)
        rows.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/batch={number}")
        return self.spark.read.schema(f"{self.kinds}, old_key string").parquet(f"{self.folder}/batch={number}")


def _apply(rows: DataFrame, number: int, folder: str) -> None:
    """Apply batch ``number``; what it reads of earlier batches follows its own changes."""
    spark = rows.sparkSession
    table = DeleteVectorTable.open(spark, f"{folder}/table", PAYLOAD)
    rows = changes(rows)
    log = _Log(spark, f"{folder}/changes", ", ".join(f"{name} {kind}" for name, kind in rows.dtypes), table.parts)
    earlier = None
    if number:
        ids = rows.where("update_id is not null").select("update_id").distinct()
        parts = [row[0] for row in ids.select(log.part).distinct().collect()]  # at most one row for each part
        earlier = log.before(number, parts).join(ids, "update_id", "left_semi")
    fresh = log.keep(placed(earlier, rows), number)
    reopened = fresh.where("old_key is not null").select(F.col("old_key").alias("key")).distinct()
    if not number or reopened.isEmpty():
        table.apply(fresh.select(*rows.columns))
    else:
        # all changes that ever stood under a reopened key, each at its place of now
        every = log.before(number + 1).select(*rows.columns)
        near = every.join(reopened, "key", "left_semi")
        known = every.join(near.select("update_id").distinct(), "update_id", "left_semi").unionByName(near.where("update_id is null"))
        known = first_deliveries(known, "update_id", "sequence").join(reopened, "key", "left_semi")
        table.apply(fresh.select(*rows.columns).unionByName(known.select(*rows.columns)), reopened)
    if len(table.manifest.images) >= COMPACT_EVERY:
        table.compact()


def materialize(feed: DataFrame, folder: str, checkpoint: str) -> None:
    """Apply all that has arrived to the table in ``folder``, batch by batch, and stop.

    Spark's checkpoint advances only after a batch has been applied. A batch
    that is delivered again after a failure changes nothing: what it added to
    the changes kept beside the table is written anew. A change counts once, at
    the lowest sequence of all batches: a repeat that is not lower is left out;
    a lower one moves its change, and the keys that it stood under are decided
    anew among all changes of theirs. Rows that are no changes leave no trace.
    """
    query = feed.writeStream.foreachBatch(lambda batch, number: _apply(batch, number, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def prefix_end(sequences: DataFrame, reached: int) -> int:
    """The last of ``sequences(sequence)`` that follows ``reached`` without a gap; ``reached`` itself if the next is missing."""
    known = sequences.where(F.col("sequence") > reached).select("sequence").distinct()
    ends = known.unionByName(known.sparkSession.range(reached, reached + 1).toDF("sequence")).join(known.select((F.col("sequence") - 1).alias("sequence")), "sequence", "left_anti")
    return ends.agg(F.min("sequence")).collect()[0][0]


def materialize_in_order(feed: DataFrame, folder: str, checkpoint: str, first: int = 1) -> None:
    """The same, but strictly by sequence: a change is applied only when all before it have come.

    What comes after a gap waits in ``folder/waiting`` until the gap is filled;
    ``folder/reached`` holds the last applied sequence of each batch. Rows
    without a sequence can never be in order and are left out. Sequences begin
    with ``first``.
    """
    spark = feed.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        rows, reached = batch.where("sequence is not null"), first - 1
        if number:
            reached = spark.read.schema("reached long").parquet(f"{folder}/reached/batch={number - 1}").collect()[0][0]
            # repeats of what has been applied have a place already and do nothing
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{folder}/waiting/batch={number - 1}"))
        rows = rows.where(F.col("sequence") > reached)
        rows.write.mode("overwrite").parquet(f"{folder}/arrived/batch={number}")
        rows = spark.read.schema(batch.schema).parquet(f"{folder}/arrived/batch={number}")
        end = prefix_end(rows, reached)
        _apply(rows.where(F.col("sequence") <= end), number, folder)
        rows.where(F.col("sequence") > end).write.mode("overwrite").parquet(f"{folder}/waiting/batch={number}")
        spark.range(1).select(F.lit(end).cast("long").alias("reached")).write.mode("overwrite").parquet(f"{folder}/reached/batch={number}")

    query = feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that exist after all batches applied so far."""
    return DeleteVectorTable.open(spark, f"{folder}/table", PAYLOAD).read()
