"""Mergeable quantile sketches whose rank error shrinks towards one tail.

The sketch is a stack of relative compactors (Cormode, Karnin, Liberty, Thaler
and Vesely: Relative Error Streaming Quantiles, 2021). Level h holds values of
weight 2^h. A full compactor sorts its values, keeps those nearest the
protected tail and passes every other one of the rest to the next level; how
many sections take part follows the schedule of its compaction count. Which
ones of the pairs go up is decided by a coin that follows from the sketch's
seed, so that the errors of many sketches merged into one cancel instead of
adding up. With the upper tail protected, the rank error at rank r of n is a
small share of n - r, so extreme percentiles come out nearly exact.

Sketches of files, days or partitions merge level by level into the sketch of
their union, in any grouping.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECTION = 48
_HEAD = struct.Struct("<qQddHH")
_LEVEL = struct.Struct("<qdHI")


_ALL = (1 << 64) - 1


def _mixed(x: int) -> int:
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _ALL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _ALL
    return x ^ x >> 31


class _Level:
    """A relative compactor: values, count of compactions, section size and number of sections."""

    __slots__ = ("count", "parts", "section", "sections")

    def __init__(self, section: float) -> None:
        self.parts: list[np.ndarray] = []
        self.count, self.section, self.sections = 0, float(section), 3

    @property
    def size(self) -> int:
        return sum(map(len, self.parts))

    def width(self) -> int:
        return max(4, 2 * round(self.section / 2))

    def capacity(self) -> int:
        return 2 * self.sections * self.width()

    def grow(self) -> None:
        """More and smaller sections once the schedule has used those there are."""
        while self.count >= 1 << (self.sections - 1) and self.section / 2**0.5 >= 4:
            self.section /= 2**0.5
            self.sections *= 2

    def compact(self, upper: bool, coin: int) -> np.ndarray:
        """Take the unprotected values out and return every other one of them, from the first or second on."""
        values = np.sort(np.concatenate(self.parts))
        if not upper:
            values = values[::-1]
        trailing = (~self.count & (self.count + 1)).bit_length() - 1
        protected = self.capacity() // 2 + max(0, self.sections - trailing - 1) * self.width()
        taken = max(2, len(values) - protected)
        taken -= taken % 2
        out = values[coin:taken:2]
        self.parts = [values[taken:]]
        self.count += 1
        self.grow()
        return out


class RelativeSketch:
    """A quantile sketch of numbers; ``upper`` protects the upper tail, else the lower.

    Sketches that are to be merged should differ in ``seed``; equal ones give
    right results too, only with a greater error.
    """

    def __init__(self, section: int = SECTION, upper: bool = True, seed: int = 0) -> None:
        self.section, self.upper, self.seed = section, upper, seed & _ALL
        self.n, self.low, self.high = 0, np.inf, -np.inf
        self.levels = [_Level(section)]

    def add(self, values: np.ndarray) -> None:
        """Take in numbers; the caller leaves nulls and not-a-numbers out."""
        values = np.asarray(values, np.float64)
        if not len(values):
            return
        self.n += len(values)
        self.low, self.high = min(self.low, values.min()), max(self.high, values.max())
        start = 0
        while start < len(values):
            step = max(1, self.levels[0].capacity() - self.levels[0].size)
            self.levels[0].parts.append(values[start : start + step])
            start += step
            self._settle()

    def merge(self, other: RelativeSketch) -> None:
        """Take in another sketch of the same parameters."""
        if not other.n:
            return
        self.n += other.n
        self.seed = _mixed(self.seed + 0x9E3779B97F4A7C15 + _mixed(other.seed) & _ALL)
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        while len(self.levels) < len(other.levels):
            self.levels.append(_Level(self.section))
        for mine, theirs in zip(self.levels, other.levels):
            mine.parts += theirs.parts
            mine.count |= theirs.count
            mine.grow()
        self._settle()

    def _settle(self) -> None:
        at = 0
        while at < len(self.levels):
            while self.levels[at].size >= self.levels[at].capacity():
                if at + 1 == len(self.levels):
                    self.levels.append(_Level(self.section))
                level = self.levels[at]
                coin = _mixed(self.seed ^ _mixed(self.n << 6 ^ at) ^ level.count << 32 & _ALL) & 1
                self.levels[at + 1].parts.append(level.compact(self.upper, coin))
            at += 1

    def quantiles(self, fractions: list[float]) -> list[float]:
        """The values at the fractions of the rank; not-a-number for an empty sketch."""
        if not self.n:
            return [float("nan")] * len(fractions)
        values = np.concatenate([part for level in self.levels for part in level.parts])
        weights = np.concatenate([np.full(level.size, 1 << h, np.int64) for h, level in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        ranks = np.cumsum(weights[order])
        wanted = np.maximum(1, np.ceil(np.array(fractions) * ranks[-1]))
        found = values[order][np.minimum(np.searchsorted(ranks, wanted), len(order) - 1)]
        return [self.low if f <= 0 else self.high if f >= 1 else float(v) for f, v in zip(fractions, found)]

    def to_bytes(self) -> bytes:
        out = [_HEAD.pack(self.n, self.seed, self.low, self.high, self.section, len(self.levels) << 1 | self.upper)]
        for level in self.levels:
            out.append(_LEVEL.pack(level.count, level.section, level.sections, level.size))
            out += [np.ascontiguousarray(part, np.float64).tobytes() for part in level.parts]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> RelativeSketch:
        n, seed, low, high, section, packed = _HEAD.unpack_from(data)
        sketch = cls(section, bool(packed & 1), seed)
        sketch.n, sketch.low, sketch.high, sketch.levels = n, low, high, []
        at = _HEAD.size
        for _ in range(packed >> 1):
            level = _Level(section)
            level.count, level.section, level.sections, size = _LEVEL.unpack_from(data, at)
            at += _LEVEL.size
            level.parts = [np.frombuffer(data, np.float64, size, at)]
            at += 8 * size
            sketch.levels.append(level)
        return sketch


#: Sketches that a task holds at once; past it they are put out and begun anew, so memory doesn't follow the number of groups.
OPEN_SKETCHES = 2048


def sketch(df: DataFrame, by: dict[str, Column], value: Column, section: int = SECTION, upper: bool = True) -> DataFrame:
    """Partial sketches of ``value`` for the groups ``by``: ``(*by, n, sketch)``.

    Null and not-a-number values count nowhere; a group of none gives no row.
    Null group values form groups of their own. One group may come out several
    times, once for each task that saw it: :func:`merge_sketches` combines them.
    Nothing is shuffled, so a group that holds most rows costs nothing extra.
    """
    names = list(by)
    rows = df.select(*[c.alias(k) for k, c in by.items()], value.cast("double").alias("_value")).where("_value is not null and not isnan(_value)")
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in names) + ", n long, sketch binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        open_: dict[tuple, RelativeSketch] = {}
        types: list[pa.DataType] = []
        begun = 0

        def put() -> pa.RecordBatch:
            columns = [pa.array([group[i] for group in open_], types[i]) for i in range(len(names))]
            columns += [pa.array([s.n for s in open_.values()], pa.int64()), pa.array([s.to_bytes() for s in open_.values()], pa.binary())]
            open_.clear()
            return pa.RecordBatch.from_arrays(columns, names=[*names, "n", "sketch"])

        for batch in batches:
            types = [batch.column(k).type for k in names]
            codes = np.zeros(batch.num_rows, np.int64)
            for k in names:
                column = batch.column(k).dictionary_encode(null_encoding="encode")
                # made dense after each column: fewer codes than rows, so that no product can overflow
                codes = np.unique(codes * max(1, len(column.dictionary)) + column.indices.to_numpy(), return_inverse=True)[1]
            order = np.argsort(codes, kind="stable")
            values = batch.column("_value").to_numpy()[order]
            starts = np.unique(codes[order], return_index=True)[1]
            chosen = batch.take(pa.array(order[starts]))
            groups = zip(*[chosen.column(k).to_pylist() for k in names]) if names else [()] * len(starts)
            for group, part in zip(groups, np.split(values, starts[1:])):
                if group not in open_:
                    begun += 1
                    seed = hashlib.blake2b(repr((task, begun, group)).encode(), digest_size=8).digest()
                    open_[group] = RelativeSketch(section, upper, int.from_bytes(seed))
                open_[group].add(part)
            if len(open_) > OPEN_SKETCHES:
                yield put()
        if open_:
            yield put()

    return rows.mapInArrow(run, schema)


#: Parts into which the sketches of one group are split for the first merge.
SPLIT = 32


def merge_sketches(sketches: DataFrame, by: list[str], split: int = SPLIT) -> DataFrame:
    """Merge the sketches of each group ``by`` into one: ``(*by, n, sketch)``.

    A tree of two levels: the sketches of a group are split over ``split``
    parts by their hash, each merged by itself, and then the parts, so that a
    group seen by very many tasks is the work of no single one. A task folds
    one sketch after another and holds one merged sketch and a batch of rows,
    however many a group has. With few sketches a group, ``split`` 1 saves the
    first level.
    """
    kinds = dict(sketches.dtypes)
    for level in ([True, False] if split > 1 else [False]):
        part = F.pmod(F.xxhash64("sketch"), F.lit(split)).alias("_part")
        sketches = _folded(sketches.select(*by, "sketch", *([part] if level else [])), by, kinds, level)
    return sketches


def _folded(rows: DataFrame, by: list[str], kinds: dict[str, str], parted: bool) -> DataFrame:
    keys = [*by, "_part"] if parted else by
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, F.xxhash64("sketch")) if keys else rows.coalesce(1)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in by), "n long", "sketch binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, held = None, None

        def put() -> pa.RecordBatch:
            columns = [held.column(k) for k in by] + [pa.array([whole.n], pa.int64()), pa.array([whole.to_bytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=[*by, "n", "sketch"])

        for batch in batches:
            groups = list(zip(*[batch.column(k).to_pylist() for k in keys])) if keys else [()] * batch.num_rows
            # compared as written out, as not-a-number equals itself there
            before = None if whole is None else repr(tuple(held.column(k)[0].as_py() for k in keys))
            for i, group in enumerate(map(repr, groups)):
                part = RelativeSketch.from_bytes(batch.column("sketch")[i].as_py())
                if whole is not None and group == before:
                    whole.merge(part)
                    continue
                if whole is not None:
                    yield put()
                whole, held, before = part, batch.slice(i, 1), group
        if whole is not None:
            yield put()

    return rows.mapInArrow(run, schema)


def percentiles(sketches: DataFrame, by: list[str], percents: list[int]) -> DataFrame:
    """The percentiles of merged sketches: ``(*by, n, pct, value)``."""
    wanted = list(percents)

    @F.pandas_udf("array<double>")
    def values(data: pd.Series) -> pd.Series:
        return data.map(lambda x: RelativeSketch.from_bytes(x).quantiles([p / 100 for p in wanted]))

    pairs = F.arrays_zip(F.array(*map(F.lit, wanted)).alias("pct"), values("sketch").alias("value"))
    rows = sketches.select(*by, "n", F.explode(pairs).alias("_pair"))
    return rows.select(*by, "n", F.col("_pair.pct").alias("pct"), F.col("_pair.value").alias("value"))
