"""Has this key been seen before?  Partitioned, blocked Bloom filters over a stream of records.

1. *Combine.*  Each map task looks at its own batches: of the rows of one key in one batch only the earliest goes on,
   the others are certainly repeats.  A key that holds a third of all rows sends one row per batch.  The outcome is
   written once, as batches need not be the same when the table is read again.
2. *Route.*  Keys are hash-partitioned, so that all arrivals of a key meet the same filter, and each partition is read
   in order of arrival.
3. *Query, then insert.*  A partition owns one split-block Bloom filter: a key selects a block of eight 32-bit words and
   sets one bit in each.  The filter is sized for its share of the keys at the wanted false-positive rate; should a
   partition hold more distinct keys than planned, further and tighter filters are stacked on it, so that the rate
   holds at any size.
4. *Measure.*  Keys known to be absent are asked of the finished filters; the share of wrong answers is reported.
5. *Verify* (optional).  Only what the filters suspect is compared exactly.

Filters hold about 11 bits per key at 1% and never the keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.durable import durable

_WORDS = 8
# The odd multipliers of the split-block Bloom filter in the public Parquet specification, one for each word of a block.
_SALTS = np.array(
    [0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], dtype=np.uint32
)


def bits_per_key(fpr: float) -> float:
    """Bits per key at which a split-block filter stays below ``fpr``; blocking costs about a quarter over a plain one."""
    return 1.25 * -_WORDS / math.log(1 - fpr ** (1 / _WORDS))


class BlockedBloom:
    """A split-block Bloom filter over 64-bit key hashes."""

    def __init__(self, capacity: int, fpr: float):
        self.capacity = max(64, capacity)
        self.inserted = 0
        self.table = np.zeros((max(1, math.ceil(self.capacity * bits_per_key(fpr) / (32 * _WORDS))), _WORDS), np.uint32)

    def _place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = hashes.view(np.uint64)
        block = ((h >> np.uint64(32)) * np.uint64(len(self.table))) >> np.uint64(32)
        low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return block.astype(np.int64), np.uint32(1) << ((low[:, None] * _SALTS) >> np.uint32(27))

    def query(self, hashes: np.ndarray) -> np.ndarray:
        block, mask = self._place(hashes)
        return ((self.table[block] & mask) == mask).all(axis=1)

    def insert(self, hashes: np.ndarray) -> None:
        block, mask = self._place(hashes)
        for word in range(_WORDS):
            np.bitwise_or.at(self.table[:, word], block, mask[:, word])
        self.inserted += len(hashes)


class StackedBloom:
    """Filters of doubling capacity and halving error, so that the overall rate holds however many keys arrive."""

    def __init__(self, capacity: int, fpr: float):
        self.fpr = fpr
        self.layers = [BlockedBloom(capacity, fpr / 2)]

    def query(self, hashes: np.ndarray) -> np.ndarray:
        found = self.layers[0].query(hashes)
        for layer in self.layers[1:]:
            found |= layer.query(hashes)
        return found

    def insert(self, hashes: np.ndarray) -> None:
        while len(hashes):
            top = self.layers[-1]
            room = top.capacity - top.inserted
            if room <= 0:
                top = BlockedBloom(2 * top.capacity, self.fpr / 2 ** (len(self.layers) + 1))
                self.layers.append(top)
                room = top.capacity
            top.insert(hashes[:room])
            hashes = hashes[room:]

    def query_then_insert(self, hashes: np.ndarray) -> np.ndarray:
        """For each hash in order, whether it may have come before; then it counts as seen."""
        first = np.sort(np.unique(hashes, return_index=True)[1])  # in order of arrival: sorted hashes would fill block by block
        seen = np.ones(len(hashes), bool)
        unique = hashes[first]
        known = self.query(unique)
        seen[first] = known
        self.insert(unique[~known])
        return seen

    @property
    def bits(self) -> int:
        return sum(layer.table.size * 32 for layer in self.layers)


@dataclass(frozen=True)
class SeenResult:
    """``flags``: one row per input row (ord, key, maybe_seen, certain).  ``probes``: one row per absent key."""

    rows: DataFrame

    @property
    def flags(self) -> DataFrame:
        return self.rows.where("kind <> 2").select("ord", "key", "maybe_seen", "certain")

    @property
    def probes(self) -> DataFrame:
        return self.rows.where("kind = 2").select("key", F.col("maybe_seen").alias("wrong"))


_OUT = "kind INT, ord BIGINT, key STRING, maybe_seen BOOLEAN, certain BOOLEAN"


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mark the rows of each batch that come later than another row of their key as certain repeats."""
    for batch in batches:
        frame = batch.select(["ord", "key"]).to_pandas()
        again = frame["ord"] > frame.groupby("key", sort=False)["ord"].transform("min")
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(again.to_numpy(bool))], names=[*batch.schema.names, "again"])


def _filtered(capacity: int, fpr: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom: StackedBloom | None = None
        for batch in batches:
            if bloom is None:
                bloom = StackedBloom(capacity, fpr)
            kind = batch["kind"].to_numpy()
            h = batch["h"].to_numpy(zero_copy_only=False).astype(np.int64)
            seen = np.zeros(len(kind), bool)
            key, probe = kind == 1, kind == 2
            if key.any():
                seen[key] = bloom.query_then_insert(h[key])
            if probe.any():
                seen[probe] = bloom.query(h[probe])
            yield pa.RecordBatch.from_arrays(
                [batch["kind"], batch["ord"], batch["key"], pa.array(seen), pa.array(~seen)],
                names=["kind", "ord", "key", "maybe_seen", "certain"],
            )

    return run


def seen_before(
    df: DataFrame,
    order: str,
    key: str,
    *,
    fpr: float = 0.01,
    keys_per_filter: int = 2_000_000,
    absent: DataFrame | None = None,
    absent_key: str | None = None,
) -> SeenResult:
    """Decide for every row of ``df`` whether its ``key`` occurred in a row with a smaller ``order``.

    ``order`` is an integer column; of rows with equal ``order`` none comes before the other.  A null or empty key is no
    key, and a row without an order comes after nothing: it is neither seen nor remembered.  A false ``maybe_seen`` is
    always right; a true one is wrong with probability ``fpr`` at most, unless ``certain`` is true.  ``absent``: rows whose ``absent_key`` is known not to occur
    in ``df``, for measuring errors; null and empty ones are left out.  Other columns are never read.  Empty tables give
    empty results.

    The number of filters follows the number of rows: one for every ``keys_per_filter`` keys at most (3 MB at 1%), which
    is all that a task keeps in memory, and one for every core where each then has 20,000 rows.
    """
    spark = df.sparkSession
    expected = df.select(F.lit(1)).count()
    parts = max(1, min(spark.sparkContext.defaultParallelism, expected // 20_000), math.ceil(expected / keys_per_filter))
    capacity = math.ceil(1.2 * expected / parts) + 1024

    rows = df.select(F.col(order).cast("long").alias("ord"), F.col(key).cast("string").alias("key"))
    usable = (F.length("key") > 0) & F.col("ord").isNotNull()
    keyed = rows.where(usable).select(F.lit(1).alias("kind"), "ord", "key")
    # Which rows are repeats depends on the batches of the run, so both halves come from one.
    combined = durable(keyed.mapInArrow(_combine, "kind INT, ord BIGINT, key STRING, again BOOLEAN"))
    routed = combined.where("NOT again").select("kind", "ord", "key")
    if absent is not None:
        probes = absent.select(F.lit(2).alias("kind"), F.lit(0).cast("long").alias("ord"), F.col(absent_key).cast("string").alias("key"))
        routed = routed.unionByName(probes.where(usable))
    filtered = (
        routed.withColumn("h", F.xxhash64("key"))
        .repartition(parts, "h")
        .sortWithinPartitions("kind", "ord")
        .mapInArrow(_filtered(capacity, fpr), _OUT)
    )
    filtered = durable(filtered)
    known = F.lit(True)
    repeats = combined.where("again").select("kind", "ord", "key", known.alias("maybe_seen"), known.alias("certain"))
    keyless = rows.where(~F.coalesce(usable, F.lit(False))).select(
        F.lit(0).alias("kind"), "ord", "key", F.lit(False).alias("maybe_seen"), known.alias("certain")
    )
    return SeenResult(filtered.unionByName(repeats).unionByName(keyless))


def _checked(result: SeenResult) -> DataFrame:
    """(ord, key, seen): the rows that the filters suspect, compared exactly.

    The earliest arrival of every key is taken from the first rows of each batch, combined in the map tasks, and kept
    where the key is suspected at all; certain repeats take no part.
    """
    routed = result.rows.where("kind = 1 AND NOT (maybe_seen AND certain)").select("key", "ord", "maybe_seen")
    suspects = routed.where("maybe_seen").select("ord", "key")
    earliest = routed.groupBy("key").agg(F.min("ord").alias("first"), F.max("maybe_seen").alias("suspected")).where("suspected")
    return suspects.join(earliest, "key").select("ord", "key", (F.col("ord") > F.col("first")).alias("seen"))


def verified(result: SeenResult, order: str = "ord") -> DataFrame:
    """(``order``, key, seen): ``result`` with its suspicions compared exactly."""
    rest = result.flags.where("certain").select("ord", "key", F.col("maybe_seen").alias("seen"))
    return _checked(result).unionByName(rest).select(F.col("ord").alias(order), "key", "seen")


def error_report(result: SeenResult) -> DataFrame:
    """One row: how many answers there were, how many were wrong, and the error rate measured on absent keys.

    An answer is wrong where the filters suspect a key that the exact check clears; they err in no other way.  All
    counts but that of the suspicions that hold come from one pass over the answers.
    """
    answer, probe = F.col("kind") != 2, F.col("kind") == 2
    counts = result.rows.agg(
        F.count_if(answer).alias("n_rows"),
        F.count_if(answer & F.col("maybe_seen") & F.col("certain")).alias("n_certain"),
        F.count_if(answer & F.col("maybe_seen") & ~F.col("certain")).alias("n_suspected"),
        F.count_if(probe).alias("n_absent"),
        F.count_if(probe & F.col("maybe_seen")).alias("n_absent_wrong"),
    )
    held = _checked(result).agg(F.count_if("seen").alias("n")).scalar()
    wrong = (F.col("n_suspected") - held).alias("n_wrong")
    return counts.select(
        "n_rows",
        (F.col("n_certain") + held).alias("n_seen"),
        wrong,
        F.try_divide(wrong, F.col("n_rows")).alias("wrong_share"),
        "n_absent",
        "n_absent_wrong",
        F.try_divide("n_absent_wrong", "n_absent").alias("absent_error_rate"),
    )
