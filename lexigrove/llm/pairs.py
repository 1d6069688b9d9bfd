"""Items that appear together: pair counts by heavy-light decomposition, and their lift.

Items are coded by a 64-bit hash in the JVM.  The frequent ones are *heavy*: at least one record in 64 holds each, and of
those the 2,048 most frequent are taken; which items are heavy decides how a pair is counted, not whether.  Map tasks take
records in blocks and count

* heavy-heavy pairs in a dense bit matrix (a row of bits per heavy item): AND and popcount,
* mixed pairs by probing: the records of a light item, looked up in the bit matrix read by records,
* light-light pairs by hash counting of what each record holds.

Each block sends one count per pair; the counts of all blocks add up.  No side of a pair is ever gathered in one place:
a hot item only means a full row of bits.  Records of any length are walked in bounded steps.

Pairs below ``min_count`` cannot be reached by items below it, so items below it are left out before pairs are formed
(exactly, by their record counts).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.durable import durable

HEAVY_PART = 64
HEAVY_MOST = 2048
_ROWS = 1 << 15
_ENTRIES = 1 << 19
_PAIRS = 1 << 21
_COUNTS = "a BIGINT, b BIGINT, n BIGINT"
#: Bits of the largest filter of items (64 MB).
_FILTER_BITS = 1 << 29


def _tally(a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs with their counts."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.nonzero(np.r_[True, (np.diff(a) != 0) | (np.diff(b) != 0)])[0]
    counts = np.diff(np.r_[first, len(a)]) if n is None else np.add.reduceat(n[order], first)
    return a[first], b[first], counts


class BlockCounter:
    """Counts the pairs of one block of records, given in CSR form: record r holds codes[start[r]:start[r + 1]]."""

    def __init__(self, heavy: np.ndarray):
        self.heavy = np.sort(heavy)

    def count(self, start: np.ndarray, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        n_rows = len(start) - 1
        row = np.repeat(np.arange(n_rows), np.diff(start))
        place = np.searchsorted(self.heavy, codes)
        place[place == len(self.heavy)] = 0
        is_heavy = self.heavy[place] == codes if len(self.heavy) else np.zeros(len(codes), bool)
        by_record = np.zeros((n_rows, len(self.heavy)), bool)
        by_record[row[is_heavy], place[is_heavy]] = True
        yield from self._heavy_heavy(by_record)
        light_row, light = row[~is_heavy], codes[~is_heavy]
        yield from self._mixed(by_record, light_row, light)
        yield from self._light_light(light_row, light)

    def _heavy_heavy(self, by_record: np.ndarray) -> Iterator:
        """Bit matrix, one row of 64-bit words for each heavy item; popcounts of its rows' intersections."""
        h = by_record.shape[1]
        if h < 2:
            return
        packed = np.packbits(by_record.T, axis=1)
        words = np.zeros((h, -(-packed.shape[1] // 8) * 8), np.uint8)
        words[:, : packed.shape[1]] = packed
        words = words.view(np.uint64)
        for i in range(h - 1):
            both = np.bitwise_count(words[i + 1 :] & words[i]).sum(axis=1, dtype=np.int64)
            some = np.nonzero(both)[0]
            if len(some):
                yield np.full(len(some), self.heavy[i]), self.heavy[i + 1 + some], both[some]

    def _mixed(self, by_record: np.ndarray, row: np.ndarray, light: np.ndarray) -> Iterator:
        """Probe the records of each light item in the bit matrix."""
        h = by_record.shape[1]
        if not h or not len(light):
            return
        by_record = np.packbits(by_record, axis=1)
        order = np.argsort(light, kind="stable")
        row, light = row[order], light[order]
        step = max(1, _PAIRS * 8 // h)
        for at in range(0, len(light), step):
            item = light[at : at + step]
            first = np.nonzero(np.r_[True, np.diff(item) != 0])[0]
            bits = np.unpackbits(by_record[row[at : at + step]], axis=1, count=h)
            both = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
            i, j = np.nonzero(both)
            a, b = item[first][i], self.heavy[j]
            yield np.minimum(a, b), np.maximum(a, b), both[i, j]

    def _light_light(self, row: np.ndarray, light: np.ndarray) -> Iterator:
        """Pairs at growing distance within the records' sorted lists; tallied whenever the buffer is full."""
        order = np.lexsort((light, row))
        row, light = row[order], light[order]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        at = np.arange(len(row))
        distance = 1
        while len(at):
            at = at[at + distance < len(row)]
            at = at[row[at] == row[at + distance]]
            for k in range(0, len(at), _PAIRS):
                some = at[k : k + _PAIRS]
                held.append((light[some], light[some + distance]))
                n += len(some)
                if n >= _PAIRS:
                    yield _tally(*(np.concatenate(x) for x in zip(*held)))
                    held, n = [], 0
            distance += 1
        if n:
            yield _tally(*(np.concatenate(x) for x in zip(*held)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Records in blocks of bounded numbers of records and items; the codes of a record are distinct."""
    sizes: list[np.ndarray] = []
    codes: list[np.ndarray] = []
    n_rows = n_codes = 0
    for batch in batches:
        column = batch.column(0)
        sizes.append(np.diff(column.offsets.to_numpy()))
        codes.append(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
        n_rows += len(sizes[-1])
        n_codes += len(codes[-1])
        if n_rows >= _ROWS or n_codes >= _ENTRIES:
            yield np.r_[0, np.cumsum(np.concatenate(sizes))], np.concatenate(codes)
            sizes, codes, n_rows, n_codes = [], [], 0, 0
    if n_rows:
        yield np.r_[0, np.cumsum(np.concatenate(sizes))], np.concatenate(codes)


def _pruned(start: np.ndarray, codes: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the codes that are not in ``kept``: a sorted array, or a filter (bytes) that lets a few others through."""
    if kept.dtype == np.uint8:
        bit = np.mod(codes, 8 * len(kept))
        stays = kept[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1
    else:
        place = np.searchsorted(kept, codes)
        place[place == len(kept)] = 0
        stays = kept[place] == codes if len(kept) else np.zeros(len(codes), bool)
    return np.r_[0, np.cumsum(stays)][start], codes[stays]


def _filter(codes: DataFrame, n: int) -> np.ndarray:
    """A bit for each remainder of ``codes``, of 16 bits a code as long as that takes 64 MB at most."""
    bits = min(_FILTER_BITS, max(1 << 15, 1 << (16 * n).bit_length()))
    at = F.pmod("code", F.lit(bits)) + 1
    parts = codes.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for bucket, part in parts.toLocalIterator():  # 64 MB in all
        out[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(part, np.uint8)
    return out


def _counted(heavy: np.ndarray, kept: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = BlockCounter(heavy)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            a, b, c = _tally(*(np.concatenate(x) for x in zip(*parts)))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c.astype(np.int64))], names=["a", "b", "n"])

        for start, codes in _blocks(batches):
            for part in counter.count(*_pruned(start, codes, kept)):
                parts.append(part)
                n += len(part[0])
                if n >= _PAIRS:
                    parts = [tuple(np.asarray(c) for c in flush().columns)]
                    n = len(parts[0][0])
                    if n >= _PAIRS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in parts[0]], names=["a", "b", "n"])
                        parts, n = [], 0
        if n:
            yield flush()

    return run


def together(
    df: DataFrame,
    items: Column | str,
    *,
    min_count: int = 1,
    keep_at_most: int = 1_000_000,
    seed: int = 0,
) -> DataFrame:
    """(name_a, value_a, name_b, value_b, n_a, n_b, n_ab, n_rows, lift) of the pairs that ``min_count`` rows or more hold.

    ``items`` is an ARRAY<STRUCT<name, value>> of the items of a row; repeated ones count once, and ones with a null part
    are left out.  A pair is listed once, the item smaller by (name, value) first.  ``n_rows`` counts all rows of ``df``,
    those without items included; lift is n_ab * n_rows / (n_a * n_b).  Repeated rows count as they stand.  An empty
    table gives an empty result.

    The items that reach ``min_count`` are sent to the tasks as a sorted array of hashes if there are ``keep_at_most`` at
    most (8 MB), beyond that as a filter of 64 MB at most that lets some rarer items through; their pairs drop out when
    names are joined.  An item that reaches ``min_count`` must not share its hash with any other: if one does, the
    operator starts again with another seed.  Clashes of rarer items do no harm.  With F items that reach it among N, F N
    / 2**64 clashes are to be expected, so that a second attempt is rare and a ninth is taken for a fault.
    """
    spark = df.sparkSession
    n_rows = df.select(F.lit(1)).count()
    listed = df.select((F.col(items) if isinstance(items, str) else items).alias("items"))
    if listed.schema["items"].dataType.elementType.names != ["name", "value"]:
        listed = listed.select(F.transform("items", lambda i: F.struct(i["name"].alias("name"), i["value"].alias("value"))).alias("items"))
    rows = listed.select(F.array_distinct(F.filter("items", lambda i: i["name"].isNotNull() & i["value"].isNotNull())).alias("items"))
    counted = rows.select(F.explode("items").alias("i")).groupBy("i.name", "i.value").agg(F.count(F.lit(1)).alias("n_item"))
    code = lambda name, value: F.xxhash64(F.lit(seed), name, value)
    known = durable(counted.withColumn("code", code(F.col("name"), F.col("value"))))
    frequent = known.where(F.col("n_item") >= min_count)
    by_code = known.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.max("n_item").alias("n_item"))
    reached = F.col("n_item") >= min_count
    clashes, n_frequent = by_code.agg(F.count_if((F.col("n") > 1) & reached), F.count_if(reached)).first()
    if clashes:
        if seed >= 8:
            raise RuntimeError("items clash whatever the seed of their hash")
        return together(df, items, min_count=min_count, keep_at_most=keep_at_most, seed=seed + 1)
    if n_frequent <= keep_at_most:
        kept = np.sort(np.asarray(frequent.select("code").toPandas()["code"], np.int64))
    else:
        kept = _filter(frequent.select("code"), n_frequent)
    dense = known.where(F.col("n_item") * HEAVY_PART >= max(n_rows, HEAVY_PART * min_count))
    heavy = dense.orderBy(F.desc("n_item"), "code").limit(HEAVY_MOST).select("code").toPandas()["code"].to_numpy(np.int64)

    coded = rows.select(F.transform("items", lambda i: code(i["name"], i["value"])).alias("codes")).where(F.size("codes") > 1)
    sc = spark.sparkContext
    heavy_sent, kept_sent = sc.broadcast(heavy), sc.broadcast(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _counted(heavy_sent.value, kept_sent.value)(batches)

    counts = coded.mapInArrow(run, _COUNTS).groupBy("a", "b").agg(F.sum("n").alias("n_ab")).where(F.col("n_ab") >= min_count)
    named = frequent.select("code", F.struct("name", "value").alias("item"), "n_item")
    left = named.select(F.col("code").alias("a"), F.col("item").alias("x"), F.col("n_item").alias("n_x"))
    right = named.select(F.col("code").alias("b"), F.col("item").alias("y"), F.col("n_item").alias("n_y"))
    joined = counts.join(left, "a").join(right, "b")
    swap = F.col("x") > F.col("y")
    pair = joined.select(
        F.when(swap, F.col("y")).otherwise(F.col("x")).alias("p"),
        F.when(swap, F.col("x")).otherwise(F.col("y")).alias("q"),
        F.when(swap, F.col("n_y")).otherwise(F.col("n_x")).alias("n_a"),
        F.when(swap, F.col("n_x")).otherwise(F.col("n_y")).alias("n_b"),
        "n_ab",
    )
    return pair.select(
        F.col("p.name").alias("name_a"),
        F.col("p.value").alias("value_a"),
        F.col("q.name").alias("name_b"),
        F.col("q.value").alias("value_b"),
        "n_a",
        "n_b",
        "n_ab",
        F.lit(n_rows).cast("long").alias("n_rows"),
        (F.col("n_ab").cast("double") * F.lit(float(n_rows)) / (F.col("n_a").cast("double") * F.col("n_b").cast("double"))).alias("lift"),
    )
