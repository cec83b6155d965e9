"""A table kept current under inserts, updates and deletes by delete vectors.

Images of rows are only ever appended. An index leads from each key to the
file and position of its one live image. Applying a batch of changes looks up
the images that it supersedes, sets their bits in a bitmap for each file, and
appends the new images; a read filters the positions whose bit is set.

What a batch writes follows the size of the batch: images, index entries and
bits are added as new folders, and a manifest names those that hold. The index
is split by the hash of the key; a batch reads the parts of its own keys only.
Parts with many additions are merged now and then, and folders that no
manifest names any more are deleted.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import new_folder

#: Bitmaps of 4 KB cover 32768 positions each; up to this many are broadcast to a read, more are joined by file and block.
BROADCAST_BITMAPS = 4096
#: Least and greatest number of parts of the index by hash of the key. Unless it is given, a new table has as many as
#: shuffles have tasks, and keeps that number; the numbers of parts are all of the index that reaches the driver.
LEAST_PARTS, MOST_PARTS = 8, 4096
#: Additions to a part of the index, or to the bitmaps, after which they are merged into one.
MOST_ADDITIONS = 8

_INDEX = "key string, version bigint, sequence bigint, file string, place bigint, batch bigint"
_VECTORS = "file string, block bigint, bits binary"


def _marked(bits: str, place: str) -> Column:
    """Whether the bit of ``place`` (from 1) is set; null where there is no bitmap."""
    position = F.bitmap_bit_position(place).cast("int")
    byte = F.conv(F.hex(F.col(bits).substr((position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, position % 8) == 1


@dataclass
class _Manifest:
    """What holds after a batch: folders of images and bitmaps, and for each part of the index its folders, oldest first."""

    batches: int = 0
    parts: int = 0
    schema: str = ""
    images: list[str] = field(default_factory=list)
    index: dict[str, list[str]] = field(default_factory=dict)
    vectors: list[str] = field(default_factory=list)

    def folders(self) -> set[str]:
        return {*self.images, *self.vectors, *(name for names in self.index.values() for name in names)}


@dataclass
class DeleteVectorTable:
    """State in ``folder``: ``images-N``, ``index-N``, ``vectors-N`` of the batches and ``manifests/N``, of which the last holds.

    ``payload`` names the columns that an image carries besides ``key``,
    ``version`` and ``sequence``.
    """

    spark: SparkSession
    payload: list[str]
    folder: str = ""
    parts: int = 0
    manifest: _Manifest = field(default_factory=_Manifest, repr=False)

    def __post_init__(self) -> None:
        self.folder = self.folder or new_folder(self.spark, "delete-vectors")
        self.parts = self.parts or min(MOST_PARTS, max(LEAST_PARTS, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))

    @property
    def batches(self) -> int:
        return self.manifest.batches

    @classmethod
    def open(cls, spark: SparkSession, folder: str, payload: list[str], parts: int = 0) -> DeleteVectorTable:
        """The table that was kept in ``folder``, as of its last whole batch; an unfinished batch is written anew."""
        state = cls(spark, payload, folder, parts)
        known = [int(name) for name in state._names("manifests") if name.isdigit()]
        if known:
            jvm = spark.sparkContext._jvm
            stream = state._files().open(state._path(f"manifests/{max(known)}"))
            try:
                state.manifest = _Manifest(**json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
            state.parts = state.manifest.parts
        return state

    # the folder's files, over whatever file system it is on

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, name: str = "") -> list[str]:
        path = self._path(name) if name else self._path("x").getParent()
        return [status.getPath().getName() for status in self._files().listStatus(path)] if self._files().exists(path) else []

    def _commit(self, manifest: _Manifest) -> None:
        """Write the manifest under its final name in one step, then delete what neither it nor the one before names."""
        files, target = self._files(), self._path(f"manifests/{manifest.batches}")
        draft = self._path(f"manifests/.{manifest.batches}.draft")
        stream = files.create(draft, True)
        stream.write(bytearray(json.dumps(manifest.__dict__).encode()))
        stream.close()
        files.delete(target, False)
        if not files.rename(draft, target):
            raise OSError(f"could not write {target}")
        held = manifest.folders() | self.manifest.folders()
        for name in self._names():
            if name != "manifests" and name not in held:
                files.delete(self._path(name), True)
        for name in self._names("manifests"):
            if name.isdigit() and int(name) < manifest.batches - 1:
                files.delete(self._path(f"manifests/{name}"), False)
        self.manifest = manifest

    def _part(self, key: str = "key") -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int").alias("part")

    def _index(self, index: dict[str, list[str]], parts: list[str] | None = None) -> DataFrame:
        """All entries of the index, or of some parts of it; of one key the last batch's holds."""
        paths = [f"{self.folder}/{name}/part={part}" for part, names in index.items() for name in names if parts is None or part in parts]
        return self.spark.read.schema(_INDEX).parquet(*paths) if paths else self.spark.createDataFrame([], _INDEX)

    def _write_index(self, entries: DataFrame, name: str) -> list[str]:
        """Write entries by part; the parts written."""
        entries.withColumn("part", self._part()).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/{name}")
        return [entry.removeprefix("part=") for entry in self._names(name) if entry.startswith("part=")]

    def apply(self, changes: DataFrame, reopened: DataFrame | None = None) -> None:
        """Apply a batch: ``changes(key, version, sequence, deletes, *payload)`` in any order.

        The change with the greatest (version, sequence) decides a key, within
        the batch and against what was applied before; a repeated or stale
        change does nothing. A deleting change leaves a tombstone in the index,
        so that an older change arriving later doesn't revive the row. Changes
        with a null key or version are none; a null sequence counts as the
        lowest. Each key takes part in the joins once, as the batch is reduced
        before its shuffle, so a hot key costs no task more than another.

        ``reopened(key)``, distinct, names keys whose earlier decision no
        longer holds: the batch alone, which must have all that is known of
        them, decides them anew, and a key without any change is gone.
        """
        was, number = self.manifest, self.batches + 1
        image = F.struct("version", "sequence", "deletes", *self.payload)
        batch = (
            changes.where("key is not null and version is not null")
            .withColumns({"version": F.col("version").cast("bigint"), "sequence": F.coalesce(F.col("sequence").cast("bigint"), F.lit(-(2**63)))})
            .groupBy("key")
            .agg(F.max(image).alias("new"))
        )
        if reopened is not None:
            batch = batch.join(reopened.select("key", F.lit(True).alias("anew")), "key", "full")
        kinds = dict(changes.dtypes)
        schema = was.schema or ", ".join(f"`{c}` {t}" for c, t in [("key", "string"), ("version", "bigint"), ("sequence", "bigint"), *((c, kinds[c]) for c in self.payload)])
        anew = F.coalesce("anew", F.lit(False)) if reopened is not None else F.lit(False)
        if was.index:
            # written, as it is asked for its parts, looks up the index and is resolved
            batch.write.mode("overwrite").parquet(f"{self.folder}/batch-{number}")
            batch = self.spark.read.parquet(f"{self.folder}/batch-{number}")
            touched = [str(row[0]) for row in batch.select(self._part()).distinct().collect()]  # at most one row for each part
            # entries of other keys end at the scan or right after it, before any shuffle
            near = self._index(was.index, touched).join(batch.select("key"), "key", "left_semi")
            old = near.groupBy("key").agg(F.max_by(F.struct("version", "sequence", "file", "place"), "batch").alias("old"))
            batch = batch.join(old.where("old.version is not null"), "key", "left")
        else:
            batch = batch.withColumn("old", F.lit(None).cast("struct<version: bigint, sequence: bigint, file: string, place: bigint>"))
        newer = F.col("old").isNull() | (F.struct("new.version", "new.sequence") > F.struct("old.version", "old.sequence"))
        resolved = batch.select("key", "new", "old", (F.col("new").isNotNull() & (newer | anew)).alias("wins"), (F.col("new").isNull() & anew).alias("gone"))
        resolved.where("wins or gone").write.mode("overwrite").parquet(f"{self.folder}/resolved-{number}")
        resolved = self.spark.read.parquet(f"{self.folder}/resolved-{number}")

        winners = resolved.where("wins").select("key", "new.*")
        winners.where("not coalesce(deletes, false)").select("key", "version", "sequence", *self.payload).write.mode("overwrite").parquet(f"{self.folder}/images-{number}")
        located = self._located(f"images-{number}", schema)
        nowhere = [F.lit(None).cast("string").alias("file"), F.lit(None).cast("bigint").alias("place")]
        tombstones = winners.where("coalesce(deletes, false)").select("key", "version", "sequence", *nowhere)
        gone = resolved.where("gone").select("key", F.lit(None).cast("bigint").alias("version"), F.lit(None).cast("bigint").alias("sequence"), *nowhere)
        index = {part: list(names) for part, names in was.index.items()}
        for part in self._write_index(located.unionByName(tombstones).unionByName(gone).withColumn("batch", F.lit(number).cast("bigint")), f"index-{number}"):
            index.setdefault(part, []).append(f"index-{number}")

        superseded = resolved.where("old.file is not null").select("old.file", (F.col("old.place") + 1).alias("place"))
        fresh = superseded.groupBy("file", F.bitmap_bucket_number("place").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
        vectors = list(was.vectors)
        if was.images:
            fresh.write.mode("overwrite").parquet(f"{self.folder}/vectors-{number}")
            vectors.append(f"vectors-{number}")

        crowded = [part for part, names in index.items() if len(names) > MOST_ADDITIONS]
        if crowded:
            last = self._index(index, crowded).groupBy("key").agg(F.max_by(F.struct("version", "sequence", "file", "place", "batch"), "batch").alias("e")).where("e.version is not null")
            for part in crowded:
                del index[part]
            for part in self._write_index(last.select("key", "e.*"), f"index-{number}-merged"):
                index[part] = [f"index-{number}-merged"]
        if len(vectors) > MOST_ADDITIONS:
            self._bitmaps(vectors).write.mode("overwrite").parquet(f"{self.folder}/vectors-{number}-merged")
            vectors = [f"vectors-{number}-merged"]
        self._commit(_Manifest(number, self.parts, schema, [*was.images, f"images-{number}"], index, vectors))

    def _located(self, name: str, schema: str) -> DataFrame:
        """Entries of the index for the images in a folder."""
        images = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        return images.select("key", "version", "sequence", F.concat(F.lit(f"{name}/"), F.col("_metadata.file_name")).alias("file"), F.col("_metadata.row_index").alias("place"))

    def compact(self) -> None:
        """Write the live rows into new images, without the superseded ones; tombstones stay in the index."""
        was, number = self.manifest, self.batches + 1
        self.read().write.mode("overwrite").parquet(f"{self.folder}/images-{number}")
        last = self._index(was.index).groupBy("key").agg(F.max_by(F.struct("version", "sequence", "file", "place"), "batch").alias("e"))
        tombstones = last.where("e.version is not null and e.file is null").select("key", "e.*")
        entries = self._located(f"images-{number}", was.schema).unionByName(tombstones).withColumn("batch", F.lit(number).cast("bigint"))
        index = {part: [f"index-{number}"] for part in self._write_index(entries, f"index-{number}")}
        self._commit(_Manifest(number, self.parts, was.schema, [f"images-{number}"], index, []))

    def _bitmaps(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], _VECTORS)
        rows = self.spark.read.schema(_VECTORS).parquet(*[f"{self.folder}/{name}" for name in names])
        return rows.groupBy("file", "block").agg(F.bitmap_or_agg("bits").alias("bits")) if len(names) > 1 else rows

    def vectors(self) -> DataFrame:
        """The delete vectors: ``(file, block, bits)``."""
        return self._bitmaps(self.manifest.vectors)

    def read(self) -> DataFrame:
        """The live rows: ``(key, version, sequence, *payload)``."""
        if not self.batches:
            raise ValueError("nothing has been applied yet")
        images = self.spark.read.schema(self.manifest.schema).parquet(*[f"{self.folder}/{name}" for name in self.manifest.images])
        if not self.manifest.vectors:
            return images.select("key", "version", "sequence", *self.payload)
        file = F.regexp_extract(F.col("_metadata.file_path"), r"(images-\d+/[^/]+)$", 1)
        images = images.select("*", file.alias("file"), (F.col("_metadata.row_index") + 1).alias("place"))
        images = images.withColumn("block", F.bitmap_bucket_number("place"))
        vectors = self.vectors()
        if vectors.count() <= BROADCAST_BITMAPS:
            vectors = F.broadcast(vectors)
        dead = F.coalesce(_marked("bits", "place"), F.lit(False))
        return images.join(vectors, ["file", "block"], "left").where(~dead).select("key", "version", "sequence", *self.payload)


def first_deliveries(changes: DataFrame, change_id: str, sequence: str) -> DataFrame:
    """Repeats of a change are one change, placed at its lowest sequence.

    Rows without ``change_id`` cannot be known as repeats and are all kept.
    Reduced before the shuffle, so a change delivered many times stays cheap.
    """
    columns = changes.columns
    known = changes.where(F.col(change_id).isNotNull()).groupBy(change_id).agg(F.min(F.struct(F.col(sequence).isNull().alias("_late"), F.col(sequence).alias("_at"), *[c for c in columns if c != change_id])).alias("_row"))
    known = known.select(*[F.col(c) if c == change_id else F.col(f"_row.{c}").alias(c) for c in columns])
    return known.unionByName(changes.where(F.col(change_id).isNull()))
