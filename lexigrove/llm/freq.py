"""Frequency of every distinct term: record-identifier bitmaps per term with parallel occurrence counters.

The collection is laid out vertically.  Record identifiers are split into chunks of 65,536; for each (field, term,
chunk) a map task builds one compressed container of the identifiers' low 16 bits, and counts occurrences beside it.
Containers of the same key are united; their cardinality is the number of records.  A term that nearly every record
carries is spread over its chunks, so that no task ever holds more than one chunk of it, and a container never exceeds
8 KB.

Container format: one byte for the kind, then for ``A`` the sorted 16-bit numbers, for ``R`` pairs of 16-bit numbers
(first, last of each run), for ``B`` a bitmap of 8,192 bytes; whichever is smallest is stored.  All are little-endian.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BITS = 16
_BITMAP = 1 << (CHUNK_BITS - 3)


def pack(low: np.ndarray) -> bytes:
    """The container of sorted, distinct 16-bit numbers."""
    n = len(low)
    if n <= 2:
        return b"A" + low.astype("<u2").tobytes()
    low = low.astype(np.int32)
    breaks = np.nonzero(np.diff(low) != 1)[0]
    runs = len(breaks) + 1
    if 4 * runs < min(2 * n, _BITMAP):
        ends = np.empty((runs, 2), "<u2")
        ends[:, 0] = low[np.r_[0, breaks + 1]]
        ends[:, 1] = low[np.r_[breaks, n - 1]]
        return b"R" + ends.tobytes()
    if 2 * n <= _BITMAP:
        return b"A" + low.astype("<u2").tobytes()
    bits = np.zeros(1 << CHUNK_BITS, np.uint8)
    bits[low] = 1
    return b"B" + np.packbits(bits, bitorder="little").tobytes()


def unpack(container: bytes) -> np.ndarray:
    """The sorted numbers in a container."""
    kind, body = container[:1], container[1:]
    if kind == b"A":
        return np.frombuffer(body, "<u2")
    if kind == b"R":
        ends = np.frombuffer(body, "<u2").reshape(-1, 2).astype(np.int64)
        return np.concatenate([np.arange(a, b + 1) for a, b in ends]).astype("<u2")
    return np.nonzero(np.unpackbits(np.frombuffer(body, np.uint8), bitorder="little"))[0].astype("<u2")


def union(containers: list[bytes]) -> bytes:
    """The container of all numbers that any of ``containers`` holds."""
    if len(containers) == 1:
        return containers[0]
    if all(c[:1] == b"A" for c in containers) and sum(map(len, containers)) <= _BITMAP:
        return pack(np.unique(np.frombuffer(b"".join(c[1:] for c in containers), "<u2")))
    bits = np.zeros(1 << CHUNK_BITS, np.uint8)
    for c in containers:
        bits[unpack(c)] = 1
    return pack(np.nonzero(bits)[0])


def cardinality(container: bytes) -> int:
    if container[:1] == b"A":
        return (len(container) - 1) // 2
    if container[:1] == b"R":
        ends = np.frombuffer(container[1:], "<u2").reshape(-1, 2).astype(np.int64)
        return int((ends[:, 1] - ends[:, 0] + 1).sum())
    return int(np.bitwise_count(np.frombuffer(container[1:], np.uint8)).sum())


_LAYOUT = "field STRING, term STRING, chunk BIGINT, bitmap BINARY, n_records BIGINT, occurrences BIGINT"
_FLUSH = 500_000


def _containers(rid: np.ndarray, field: pa.Array, term: pa.Array) -> pa.RecordBatch:
    """One row for each (field, term, chunk) among the entries."""
    f, t = field.dictionary_encode(), term.dictionary_encode()
    fc, tc = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (f, t))
    code = fc * len(t.dictionary) + tc
    order = np.lexsort((rid, code))
    code, rid = code[order], rid[order]
    chunk, low = rid >> CHUNK_BITS, rid & ((1 << CHUNK_BITS) - 1)
    new_rid = np.r_[True, (np.diff(code) != 0) | (np.diff(rid) != 0)]
    new_key = np.r_[True, (np.diff(code) != 0) | (np.diff(chunk) != 0)]
    starts = np.nonzero(new_key)[0]
    occurrences = np.diff(np.r_[starts, len(code)])
    distinct = low[new_rid].astype("<u2")
    bounds = np.r_[np.cumsum(new_rid)[starts] - 1, len(distinct)].tolist()
    raw = distinct.tobytes()
    packed = [b"A" + raw[2 * a : 2 * b] if b - a <= 2 else pack(distinct[a:b]) for a, b in zip(bounds, bounds[1:])]
    return pa.RecordBatch.from_arrays(
        [
            f.dictionary.take(pa.array(code[starts] // len(t.dictionary))).cast(pa.string()),
            t.dictionary.take(pa.array(code[starts] % len(t.dictionary))).cast(pa.string()),
            pa.array(chunk[starts]),
            pa.array(packed, pa.binary()),
            pa.array(np.diff(bounds)),
            pa.array(occurrences),
        ],
        names=["field", "term", "chunk", "bitmap", "n_records", "occurrences"],
    )


def _vertical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Collect entries of some batches, so that containers fill up; memory stays bounded by _FLUSH entries and a batch."""
    held: list[pa.RecordBatch] = []
    n = 0

    def flush() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        return _containers(*(whole[c].chunk(0) if c != "rid" else whole[c].to_numpy() for c in ("rid", "field", "term")))

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= _FLUSH:
            yield flush()
            held, n = [], 0
    if n:
        yield flush()


def _unite(parts: pa.Array) -> pa.Array:
    """The union of each list of containers, with its cardinality; null for null."""
    parts = parts.combine_chunks() if isinstance(parts, pa.ChunkedArray) else parts
    ends = np.cumsum(pc.fill_null(pc.list_value_length(parts), 0).to_numpy()).tolist()
    flat = parts.flatten().to_pylist()
    bitmaps = [union(flat[a:b]) if b > a else None for a, b in zip([0, *ends], ends)]
    counts = [None if b is None else cardinality(b) for b in bitmaps]
    return pa.StructArray.from_arrays([pa.array(bitmaps, pa.binary()), pa.array(counts, pa.int64())], names=["bitmap", "n_records"])


def vertical_index(entries: DataFrame, rid: str, field: str, term: str) -> DataFrame:
    """(field, term, chunk, bitmap, n_records, occurrences): the united containers of ``entries``.

    ``rid`` is a non-negative integer that identifies a record; entries with a null in any of the three columns are left
    out.  Repeated entries count as occurrences, once as records.
    """
    narrow = entries.select(F.col(rid).cast("long").alias("rid"), F.col(field).cast("string").alias("field"), F.col(term).cast("string").alias("term"))
    partial = narrow.dropna().mapInArrow(_vertical, _LAYOUT)
    sums = (F.sum("n_records").alias("n_records"), F.sum("occurrences").alias("occurrences"))
    keyed = partial.groupBy("field", "term", "chunk").agg(F.collect_list("bitmap").alias("parts"), *sums)
    # most keys are rare and have one container, which is final as it is and never leaves the JVM
    unite = F.arrow_udf(_unite, "bitmap BINARY, n_records BIGINT")
    united = keyed.withColumn("united", unite(F.when(F.size("parts") > 1, F.col("parts"))))
    return united.select(
        "field",
        "term",
        "chunk",
        F.coalesce("united.bitmap", F.col("parts")[0]).alias("bitmap"),
        F.coalesce("united.n_records", "n_records").alias("n_records"),
        "occurrences",
    )


def term_frequencies(
    entries: DataFrame, rid: str, field: str, term: str, n_records: int, *, rare: int = 2, common: float | str = "0.3"
) -> DataFrame:
    """(field, term, n_records, occurrences, mark) of every distinct (field, term).

    ``mark`` is ``rare`` where at most ``rare`` records hold the term, else ``common`` where at least the share
    ``common`` of ``n_records`` do, else null.  An empty table gives an empty result.
    """
    share = Fraction(str(common))
    index = vertical_index(entries, rid, field, term)
    totals = index.groupBy("field", "term").agg(F.sum("n_records").alias("n_records"), F.sum("occurrences").alias("occurrences"))
    n = F.col("n_records")
    mark = F.when(n <= rare, "rare").when(n * share.denominator >= F.lit(n_records * share.numerator), "common")
    return totals.withColumn("mark", mark)
