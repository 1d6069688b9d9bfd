"""Most frequent items among billions: a hierarchical count-sketch and a verifying scan.

Values are hashed to 64 bits in the JVM.  For growing prefixes of the hash a sketch counts how many entries share the
prefix: exactly where all prefixes have a counter of their own, by a count-sketch (several rows, signed hashes, median)
beyond.  Heavy prefixes are descended level by level; whatever is frequent must lie below heavy prefixes only.  A second
scan counts the values under the surviving prefixes exactly.

Memory is bounded by the share asked for, never by the data: a sketch is about 4 MB for a share of 0.2%, and at most
about 2 / share prefixes survive a level.  Sketches are linear, so that partial ones of map tasks simply add up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = 8192
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _scramble(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixer (multiply and xor-shift rounds); one independent function for each seed."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) * _MIX
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(29))


@dataclass(frozen=True)
class SketchShape:
    """``exact_bits``: prefix length counted exactly.  ``prefixes``: longer prefix lengths, each with its sketch."""

    width: int
    depth: int = 5
    exact_bits: int = 16
    prefixes: tuple[int, ...] = (24, 32, 40)

    @classmethod
    def for_share(cls, share: Fraction) -> SketchShape:
        """Wide enough that the standard error stays below a tenth of the share, whatever the other items are.

        Once the 2 / share largest prefixes are set aside, any other holds less than share / 2 of the entries, so that
        the root of the rest's second moment is below share * sqrt(1 / (2 * share)), and that of one counter below
        share * sqrt(1 / (2 * share * width)).  Every task holds a sketch, and so does the driver: it takes 126 MB for a
        share of 2**-14, the least that is accepted.
        """
        if share < Fraction(1, 1 << 14):
            raise ValueError("a share below 2**-14 needs a sketch of more than 126 MB; count all values instead")
        return cls(width=1 << max(10, math.ceil(math.log2(64 / share))))


class HierarchicalSketch:
    """Counters of all levels in one flat array of 64-bit integers."""

    def __init__(self, shape: SketchShape, cells: np.ndarray | None = None):
        self.shape = shape
        self.exact = 1 << shape.exact_bits
        size = self.exact + len(shape.prefixes) * shape.depth * shape.width
        self.cells = np.zeros(-(-size // _BLOCK) * _BLOCK, np.int64) if cells is None else cells

    def _row(self, level: int, row: int) -> slice:
        start = self.exact + (level * self.shape.depth + row) * self.shape.width
        return slice(start, start + self.shape.width)

    def _place(self, prefix: np.ndarray, level: int, row: int) -> tuple[np.ndarray, np.ndarray]:
        mixed = _scramble(prefix, 1 + level * self.shape.depth + row)
        return (mixed % np.uint64(self.shape.width)).astype(np.int64), np.where(mixed >> np.uint64(63), 1, -1)

    def add(self, hashes: np.ndarray) -> None:
        unique, counts = np.unique(hashes.view(np.uint64), return_counts=True)
        top = (unique >> np.uint64(64 - self.shape.exact_bits)).astype(np.int64)
        np.add.at(self.cells[: self.exact], top, counts)
        for level, bits in enumerate(self.shape.prefixes):
            prefix = unique >> np.uint64(64 - bits)
            for row in range(self.shape.depth):
                cell, sign = self._place(prefix, level, row)
                np.add.at(self.cells[self._row(level, row)], cell, sign * counts)

    def estimate(self, prefix: np.ndarray, level: int) -> np.ndarray:
        rows = []
        for row in range(self.shape.depth):
            cell, sign = self._place(prefix, level, row)
            rows.append(self.cells[self._row(level, row)][cell] * sign)
        return np.median(rows, axis=0)

    @property
    def total(self) -> int:
        return int(self.cells[: self.exact].sum())

    def noise(self, level: int, aside: int) -> float:
        """Standard error of an estimate, from the counters without the ``aside`` largest."""
        errors = []
        for row in range(self.shape.depth):
            squares = np.sort(np.square(self.cells[self._row(level, row)].astype(float)))
            errors.append(math.sqrt(squares[: max(0, len(squares) - aside)].sum() / self.shape.width))
        return float(np.median(errors))

    def descend(self, share: Fraction) -> tuple[np.ndarray, np.ndarray]:
        """The longest prefixes that may hold ``share`` of the entries, with their estimated counts.

        The cut lies six standard errors below the share.  The width makes that at least 0.4 of the share, which bounds
        how many prefixes survive.
        """
        wanted = float(self.total * share)
        prefix = np.nonzero(self.cells[: self.exact] >= wanted)[0].astype(np.uint64)
        estimates, bits = self.cells[prefix.astype(np.int64)].astype(float), self.shape.exact_bits
        for level, longer in enumerate(self.shape.prefixes):
            children = (prefix[:, None] << np.uint64(longer - bits)) | np.arange(1 << (longer - bits), dtype=np.uint64)
            estimates = self.estimate(children.ravel(), level)
            cut = max(wanted - 6 * self.noise(level, math.ceil(2 / share)), 0.4 * wanted)
            kept = estimates >= cut
            prefix, estimates, bits = children.ravel()[kept], estimates[kept], longer
        return prefix, estimates


def _partial(shape: SketchShape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = HierarchicalSketch(shape)
        for batch in batches:
            if batch.num_rows:
                sketch.add(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
        for slot, block in enumerate(sketch.cells.reshape(-1, _BLOCK)):
            if block.any():
                yield pa.RecordBatch.from_pydict({"slot": pa.array([slot], pa.int32()), "cells": pa.array([block.tobytes()])})

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for slot, cells in zip(batch["slot"].to_pylist(), batch["cells"]):
            block = np.frombuffer(cells.as_buffer(), np.int64)
            if slot in sums:
                sums[slot] += block
            else:
                sums[slot] = block.copy()
    if sums:
        yield pa.RecordBatch.from_pydict({"slot": pa.array(sums, pa.int32()), "cells": pa.array([b.tobytes() for b in sums.values()])})


#: Input of one partial sketch: little enough to be read again when a task is lost, much beside the sketch's 4 MB.
_INPUT = 8 << 30


def _tasks(hashes: DataFrame) -> int:
    """Four partial sketches a core or one for each shuffle partition, and more where they would read more than 8 GB each."""
    spark = hashes.sparkSession
    size = int(str(hashes._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # as Spark estimates it, without a job
    least = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(least, min(1 << 15, math.ceil(size / _INPUT)))


def build_sketch(hashes: DataFrame, shape: SketchShape, tasks: int | None = None) -> HierarchicalSketch:
    """The sketch of a one-column table of 64-bit hashes.

    At most ``tasks`` partial sketches are made (by default as many as ``_tasks`` says), so that what is shuffled does not
    grow with the number of input splits; only the finished sketch, whose size ``shape`` fixes, comes to the driver.
    """
    tasks = tasks or _tasks(hashes)
    slots = len(HierarchicalSketch(shape).cells) // _BLOCK
    partial = hashes.coalesce(tasks).mapInArrow(_partial(shape), "slot INT, cells BINARY")
    sketch = HierarchicalSketch(shape)
    for slot, cells in partial.repartition(min(slots, 64), "slot").mapInArrow(_merge, "slot INT, cells BINARY").collect():
        sketch.cells[slot * _BLOCK : (slot + 1) * _BLOCK] = np.frombuffer(cells, np.int64)
    return sketch


def frequent_values(df: DataFrame, value: Column | str, share: float | str, shape: SketchShape | None = None) -> DataFrame:
    """(value, n, approx_n, share): the values that make up at least ``share`` of the non-null ``value`` entries of ``df``.

    ``approx_n`` is the sketch's estimate, ``n`` the exact count of the second scan, by which values are admitted;
    ``share`` counts as the decimal fraction that it is written as.  Null values are no entries; empty ones are.  Ties
    are all returned.  An empty table gives an empty result.
    """
    wanted = Fraction(str(share))
    if not 0 < wanted <= 1:
        raise ValueError("share must lie in (0, 1]")
    spark = df.sparkSession
    shape = shape or SketchShape.for_share(wanted)
    entries = df.select((F.col(value) if isinstance(value, str) else value).cast("string").alias("value")).where("value IS NOT NULL")
    sketch = build_sketch(entries.select(F.xxhash64("value").alias("h")), shape)
    total = sketch.total
    prefix, estimates = sketch.descend(wanted) if total else (np.zeros(0, np.uint64), np.zeros(0))
    bits = shape.prefixes[-1]
    of_entry = F.shiftrightunsigned(F.xxhash64("value"), 64 - bits)
    found = [int(p) for p in prefix]
    counted = entries.where(of_entry.isin(found)).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    heavy = counted.where(F.col("n") * F.lit(wanted.denominator) >= F.lit(total * wanted.numerator))
    approx = spark.createDataFrame(list(zip(found, (int(e) for e in estimates))), "prefix BIGINT, approx_n BIGINT")
    joined = heavy.withColumn("prefix", of_entry).join(F.broadcast(approx), "prefix")  # as many rows as prefixes: at most some 2.5 / share
    return joined.select("value", "n", "approx_n", (F.col("n") / F.lit(total or 1)).alias("share"))
