"""Filling containers of fixed capacity with texts of varying length.

Hierarchical packing by lengths: each text goes to the smallest context size
that holds it. The longest size is packed first, its gaps are filled with texts
of the shorter sizes, and what is left of those is packed in its turn. The
packing is worked out on how many texts there are of each length, which is as
large as the greatest capacity, not as the corpus; each text then finds its
container by its exact number among the texts of its length.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.chunked_keys import number_rows
from graphloom.session import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
TIERS = (1024, 4096, 16384)
STEP_CONTAINERS = 64


@cache
def _encoding(vocabulary: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, n_tokens)`` for every document, in the byte-level vocabulary at the path ``vocabulary``.

    The file, of less than 1 MB, is read where the job starts and sent along.
    Null texts have no tokens. The strings of special tokens are ordinary text.
    """
    import public_tokenizers

    with open(vocabulary, "rb") as file:
        shared = documents.sparkSession.sparkContext.broadcast((file.read(), public_tokenizers.PATTERN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(*shared.value).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), text).mapInArrow(run, "doc_id long, n_tokens long")


class _Bins:
    """Open containers of one capacity, many alike at a time: ``gap -> [(contents, how many)]``."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.by_gap: dict[int, list[tuple[tuple, int]]] = {}
        self.gaps: list[int] = []

    def put(self, gap: int, contents: tuple, many: int) -> None:
        if gap not in self.by_gap:
            self.by_gap[gap] = []
            insort(self.gaps, gap)
        self.by_gap[gap].append((contents, many))

    def take(self, length: int) -> tuple[int, tuple, int] | None:
        at = bisect_left(self.gaps, length)
        if at == len(self.gaps):
            return None
        gap = self.gaps[at]
        contents, many = self.by_gap[gap].pop()
        if not self.by_gap[gap]:
            del self.by_gap[gap]
            del self.gaps[at]
        return gap, contents, many

    def place(self, length: int, count: int, may_open: bool) -> int:
        """Best fit for ``count`` texts of one length; returns how many found no place."""
        while count:
            found = self.take(length)
            if found is None:
                if not may_open:
                    return count
                found = self.capacity, (), count // max(1, self.capacity // length) + 1
                fresh = True
            else:
                fresh = False
            gap, contents, many = found
            each = gap // length
            full = min(many, count // each)
            if full:
                self.put(gap - each * length, (*contents, (length, each)), full)
            count -= full * each
            many -= full
            if many and count and count < each:
                self.put(gap - count * length, (*contents, (length, count)), 1)
                many, count = many - 1, 0
            if many and not fresh:
                self.put(gap, contents, many)
        return 0


@dataclass
class Plan:
    """Where the texts of each length go, sorted by (length, first): ``each`` of them per container from ``container`` on, at ``offset``."""

    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    container: np.ndarray
    offset: np.ndarray
    tier: np.ndarray
    starts: np.ndarray
    tiers: np.ndarray
    containers: np.ndarray


def plan(counts: dict[int, int], tiers: tuple[int, ...] = TIERS) -> Plan:
    """Pack ``counts`` of texts by length (1 to the greatest tier) into the ``tiers``."""
    tiers = tuple(sorted(tiers))
    left = dict(counts)
    rows, total = [], 0
    used: dict[int, int] = {}
    containers = {}
    for level in range(len(tiers) - 1, -1, -1):
        capacity, below = tiers[level], tiers[level - 1] if level else 0
        bins = _Bins(capacity)
        for length in sorted(left, reverse=True):
            if left[length]:
                left[length] = bins.place(length, left[length], may_open=length > below)
        patterns = [(contents, many) for gap in bins.gaps for contents, many in bins.by_gap[gap]]
        # costliest containers first, so that step groups can be dealt out evenly
        patterns.sort(key=lambda p: (-sum(each * length * length for length, each in p[0]), p[0]))
        first = total
        for contents, many in patterns:
            offset = 0
            for length, each in contents:
                rows.append((length, used.get(length, 0), each, total, offset, level))
                used[length] = used.get(length, 0) + each * many
                offset += length * each
            total += many
        containers[level] = (first, total - first)
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 6).T
    starts = np.zeros(tiers[-1] + 2, np.int64)
    for length, count in counts.items():
        starts[length + 1] = count
    bounds = np.array([containers[level] for level in range(len(tiers))], np.int64)
    return Plan(*columns, starts=np.cumsum(starts), tiers=np.array(tiers, np.int64), containers=bounds)


def _pieces(lengths: DataFrame, largest: int) -> DataFrame:
    """Texts as pieces: only one longer than the largest capacity is split, into full containers and a rest."""
    many = F.ceil(F.col("n_tokens") / largest).cast("int")
    piece = F.explode(F.when(F.col("n_tokens") > largest, F.sequence(F.lit(0), many - 1)).otherwise(F.array(F.lit(0))))
    rows = lengths.where("n_tokens > 0").select("doc_id", "n_tokens", piece.alias("piece"))
    return rows.select("doc_id", "piece", F.least(F.lit(largest), F.col("n_tokens") - F.col("piece") * largest).cast("int").alias("tokens"))


def pack(lengths: DataFrame, tiers: tuple[int, ...] = TIERS, step_containers: int = STEP_CONTAINERS) -> DataFrame:
    """Pack ``lengths(doc_id, n_tokens)``: ``(doc_id, piece, tokens, capacity, container_id, position, step_group)``.

    One row for each text, or for each piece of a text longer than the greatest
    capacity; no other text is split. ``position`` is the first token's place
    in the container. ``step_group`` deals out the containers of a tier to
    groups of about ``step_containers``, costly and cheap ones alike (the cost
    is the sum of squared lengths). Texts without tokens take no space: their
    container is null. Every text comes out, rows with a null id and equal rows
    too; an empty table gives an empty result. ``tiers`` up to some hundred
    thousand tokens keep the driver's part, a count for each length, small.
    """
    largest = max(tiers)
    lengths = cut(lengths.select("doc_id", "n_tokens"), "lengths")
    pieces = _pieces(lengths, largest)
    # at most one row for each length up to the largest capacity
    made = plan({row["tokens"]: row["n"] for row in pieces.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()}, tiers)
    shared = lengths.sparkSession.sparkContext.broadcast(made)
    rows = number_rows(pieces, F.lpad(F.col("tokens").cast("string"), 9, "0"), F.col("doc_id"), payload=["doc_id", "piece", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            tokens = batch.column("tokens").to_numpy().astype(np.int64)
            rank = batch.column("row").to_numpy() - p.starts[tokens]
            # rows of the plan are sorted by (length, first): both in one number
            at = np.searchsorted(p.length * (1 << 40) + p.first, tokens * (1 << 40) + rank, side="right") - 1
            inside = rank - p.first[at]
            container = p.container[at] + inside // p.each[at]
            position = p.offset[at] + inside % p.each[at] * tokens
            first, many = p.containers[p.tier[at]].T
            groups = np.maximum(1, -(-many // step_containers))
            turn, place = np.divmod(container - first, groups)
            step = np.where(turn % 2 == 0, place, groups - 1 - place)
            columns = [batch.column("doc_id"), batch.column("piece"), batch.column("tokens"), pa.array(p.tiers[p.tier[at]].astype(np.int32)), pa.array(container), pa.array(position.astype(np.int32)), pa.array(step)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "tokens", "capacity", "container_id", "position", "step_group"])

    placed = rows.select("doc_id", "piece", "tokens", "row").mapInArrow(run, "doc_id long, piece int, tokens int, capacity int, container_id long, position int, step_group long")
    none = lengths.where("n_tokens = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).alias("tokens"), *[F.lit(None).cast(t).alias(c) for c, t in (("capacity", "int"), ("container_id", "bigint"), ("position", "int"), ("step_group", "bigint"))])
    return placed.unionByName(none)


def fill_report(packed: DataFrame) -> DataFrame:
    """``(capacity, n_containers, n_pieces, tokens, fill, max_step_tokens, min_step_tokens)`` of each tier."""
    steps = packed.where("container_id is not null").groupBy("capacity", "step_group").agg(F.sum("tokens").alias("_t"), F.count(F.lit(1)).alias("_p"), F.sum((F.col("position") == 0).cast("bigint")).alias("_c"))
    return steps.groupBy("capacity").agg(
        F.sum("_c").alias("n_containers"), F.sum("_p").alias("n_pieces"), F.sum("_t").alias("tokens"), (F.sum("_t") / (F.sum("_c") * F.first("capacity"))).alias("fill"), F.max("_t").alias("max_step_tokens"), F.min("_t").alias("min_step_tokens")
    )
