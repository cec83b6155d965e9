"""Evaluation items whose passages turn up in corpus documents.

Containment search by MinHash over size partitions. A text's signature is the
set of MinHashes of its windows: of each run of 13 words the least hash of its
five-word shingles (of an item shorter than that, of all its words). Items are
partitioned by their number of words; a document is a candidate for an item if
the share of the item's signature found in the document's reaches the threshold
of the item's partition, which is the least share that a run in common leaves
in any item of that size. A run in common has the same MinHash on both sides,
so no item is lost. Candidates are verified by exact containment: a 128-bit
hash over all words of the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import words as W
from graphloom.session import cut

RUN = 13
SHINGLE = 5
#: Bits of the filter of MinHashes sent to all tasks, for each different one, and its least and greatest size (8 KB and 128 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 1024, 16, 30
#: Windows of items up to which they are broadcast to the verification (at most 24 MB); more are joined by shuffle.
BROADCAST_WINDOWS = 500_000
#: Upper ends of the partitions of items of 13 words and more; a shorter one is in that of its own size.
PARTITIONS = (16, 32, 64, 128, 256, 512, 1024)

_WINDOW = "id long, size int, minhash long, exact1 long, exact2 long"
_ASKED = "id long, n_words int, size int, minhash long, exact1 long, exact2 long"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _windows(hashes: np.ndarray, owner: np.ndarray, size: int, wanted: np.ndarray | None, bits: int = 0) -> tuple[np.ndarray, ...]:
    """``(owner, minhash, exact1, exact2)`` of the windows of ``size`` words whose MinHash passes the filter."""
    n = len(hashes) - size + 1
    if n <= 0:
        none = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), none, none, none
    width = min(SHINGLE, size)
    least = W.window_minimum(W.shingles(hashes, width), size - width + 1)
    keep = owner[:n] == owner[size - 1 :]
    if wanted is not None:
        spot = (least >> np.uint64(64 - bits)).astype(np.int64)
        keep &= (wanted[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)
    at = np.flatnonzero(keep)
    exact = []
    for kind in (0, 1):
        with np.errstate(over="ignore"):
            out = np.zeros(len(at), np.uint64)
            for i in range(size):
                out = out * W._WORD[kind] + hashes[at + i]
        exact.append(W.mixed(out + np.uint64(size)))
    return owner[at], least[at], *exact


def _batch(ids: np.ndarray, size: int, parts: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    owner, *rest = parts
    columns = [pa.array(ids[owner], pa.int64()), pa.array(np.full(len(owner), size, np.int32)), *(pa.array(_signed(x)) for x in rest)]
    return pa.RecordBatch.from_arrays(columns, names=["id", "size", "minhash", "exact1", "exact2"])


def item_windows(items: DataFrame, item_id: str, passage: str) -> DataFrame:
    """``(id, n_words, size, minhash, exact1, exact2)``: every window by which an item is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            texts = [W.fold(W.plain(t)).replace("\n", " ") for t in batch.column(1).to_pylist()]
            hashes, owner = W.words(texts)
            lengths = np.bincount(owner, minlength=len(texts))
            required = np.minimum(lengths, RUN)
            for size in np.unique(required[required > 0]).tolist():
                mine = required[owner] == size
                parts = _windows(hashes[mine], owner[mine], size, None)
                yield pa.RecordBatch.from_arrays([*(c := _batch(ids, size, parts).columns)[:1], pa.array(lengths[parts[0]].astype(np.int32)), *c[1:]], names=["id", "n_words", "size", "minhash", "exact1", "exact2"])

    rows = items.where(F.col(item_id).isNotNull() & F.col(passage).isNotNull()).select(F.col(item_id).cast("bigint"), passage)
    return rows.mapInArrow(run, _ASKED).distinct()


def size_partition(n_words: Column) -> Column:
    """The upper end of an item's size partition: its own size below 13 words, then doubling; the last is open."""
    ends = F.coalesce(*[F.when(n_words <= end, F.lit(end)) for end in PARTITIONS], F.lit(2**31 - 1))
    return F.when(n_words < RUN, n_words).otherwise(ends)


def signatures(windows: DataFrame) -> DataFrame:
    """``(item_id, partition, signature, threshold)``: how many MinHashes an item has, and the least share of them that makes a candidate.

    A run in common has at least one of them. The threshold is that share in
    the items of the partition that have most; there are a few partitions.
    """
    sizes = windows.groupBy(F.col("id").alias("item_id"), size_partition(F.col("n_words")).alias("partition")).agg(F.countDistinct("minhash").alias("signature"))
    most = sizes.groupBy("partition").agg((1.0 / F.max("signature")).alias("threshold"))
    return sizes.join(F.broadcast(most), "partition").select("item_id", "partition", "signature", "threshold")


def _filter(windows: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of the leading bits of all MinHashes and how many bits lead; rows of 4 KB come to the driver, 128 MB at most."""
    different = windows.select("minhash").distinct().count()
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * different).bit_length()))
    spot = F.expr(f"shiftrightunsigned(minhash, {64 - bits})") + 1
    parts = windows.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
    bitmap = np.zeros((1 << bits) // 8, np.uint8)
    for block, part in parts.collect():
        bitmap[(block - 1) * 4096 : block * 4096] = np.frombuffer(part, np.uint8)
    return bitmap, bits


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage") -> DataFrame:
    """``(doc_id, item_id, estimate, shared_windows, item_windows)`` for each document that holds part of an item.

    A document holds part of an item if ``RUN`` consecutive words of its
    passage, or all words of a shorter one, stand in the text in that order.
    Letter case, punctuation, layout, markup, invisible characters and the
    encoding of characters make no difference. ``estimate`` is the share of the
    item's signature found in the document's; ``shared_windows`` of the item's
    ``item_windows`` different windows are in the document: their ratio is the
    exact containment. Null ids and texts, and items without words, match
    nothing; whole texts are searched, whatever their length.
    """
    spark = documents.sparkSession
    windows = cut(item_windows(items, item_id, passage), "item-windows")
    sizes = sorted(row[0] for row in windows.select("size").distinct().collect())  # at most RUN rows
    wanted = spark.sparkContext.broadcast(_filter(windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, bits = wanted.value
        for batch in batches:
            all_ids = batch.column(0).to_numpy()
            texts = ((i, W.fold(W.plain(t)).replace("\n", " ")) for i, t in enumerate(batch.column(1).to_pylist()))
            for block in W.blocks(texts):
                hashes, owner = W.words([t for _, t in block])
                ids = all_ids[[i for i, _ in block]]
                for size in sizes:
                    parts = _windows(hashes, owner, size, bitmap, bits)
                    if len(parts[0]):
                        yield _batch(ids, size, parts)

    rows = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint"), text)
    # what passes the filter is little; it is written, as candidates are found in it and then verified
    found = cut(rows.mapInArrow(run, _WINDOW).withColumnRenamed("id", "doc_id"), "document-windows")
    asked = windows.withColumnRenamed("id", "item_id")
    few = windows.count() <= BROADCAST_WINDOWS
    side = F.broadcast if few else (lambda df: df)
    minima = side(asked.select("item_id", "size", "minhash").distinct())
    shared = found.select("doc_id", "size", "minhash").distinct().join(minima, ["size", "minhash"]).groupBy("doc_id", "item_id").agg(F.countDistinct("minhash").alias("_s"))
    candidates = shared.join(side(signatures(windows)), "item_id").withColumn("estimate", F.col("_s") / F.col("signature")).where(F.col("estimate") >= F.col("threshold"))
    exact = found.join(side(asked.drop("n_words")), ["size", "minhash", "exact1", "exact2"]).select("doc_id", "item_id", "exact1").distinct()
    exact = exact.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared_windows"))
    whole = windows.groupBy(F.col("id").alias("item_id")).agg(F.count(F.lit(1)).alias("item_windows"))
    pairs = candidates.join(exact, ["doc_id", "item_id"]).join(side(whole), "item_id")
    return pairs.select("doc_id", "item_id", "estimate", "shared_windows", "item_windows")
