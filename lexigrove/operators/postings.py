"""Set algebra over postings: DataFrames of document ordinals, each a set."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.model import EmptyPostings

_ORD = "doc_ord"


def postings(spark: SparkSession, ordinals: Iterator[int] | list[int] = ()) -> DataFrame:
    """The set of the given ordinals."""
    return spark.createDataFrame([(int(i),) for i in sorted(set(ordinals))], f"{_ORD} BIGINT")


def ordinal_range(spark: SparkSession, low: int, high: int) -> DataFrame:
    """The ordinals from ``low`` up to, not including, ``high``; empty where low >= high."""
    return spark.range(low, max(low, high)).withColumnRenamed("id", _ORD)


def insert(p: DataFrame, ordinal: int) -> DataFrame:
    return union(p, postings(p.sparkSession, [ordinal]))


def union(p: DataFrame, q: DataFrame) -> DataFrame:
    return p.unionByName(q).distinct()


def intersect(p: DataFrame, q: DataFrame) -> DataFrame:
    return p.intersect(q.select(*p.columns))


def difference(p: DataFrame, q: DataFrame) -> DataFrame:
    return p.subtract(q.select(*p.columns))


def add_range(p: DataFrame, low: int, high: int) -> DataFrame:
    return union(p, ordinal_range(p.sparkSession, low, high))


def remove_range(p: DataFrame, low: int, high: int) -> DataFrame:
    return p.where(~((F.col(_ORD) >= low) & (F.col(_ORD) < high)))


def bounded(p: DataFrame, low: int, high: int) -> DataFrame:
    """The members from ``low`` up to, not including, ``high``."""
    return p.where((F.col(_ORD) >= low) & (F.col(_ORD) < high))


def cleared(p: DataFrame) -> DataFrame:
    return p.where(F.lit(False))


def contains(p: DataFrame, ordinal: int) -> bool:
    return not p.where(F.col(_ORD) == ordinal).isEmpty()


def is_empty(p: DataFrame) -> bool:
    return p.isEmpty()


def bounds(p: DataFrame) -> tuple[int, int]:
    """The least and the greatest member; EmptyPostings if there is none."""
    low, high = p.agg(F.min(_ORD), F.max(_ORD)).first()
    if low is None:
        raise EmptyPostings("an empty set has no bounds")
    return low, high


def size(p: DataFrame) -> int:
    return p.distinct().count()


def ascending(p: DataFrame) -> Iterator[int]:
    """The members in ascending order, fetched partition by partition."""
    return (row[0] for row in p.select(_ORD).distinct().orderBy(_ORD).toLocalIterator(prefetchPartitions=True))


def equal(p: DataFrame, q: DataFrame) -> bool:
    p, q = p.select(_ORD).distinct(), q.select(_ORD).distinct()
    return p.exceptAll(q).isEmpty() and q.exceptAll(p).isEmpty()


def bitmap_counts(p: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n): distinct ordinals per group, counted in fixed bitmaps of 32,768 ordinals each.

    A group's bitmaps are built in the map tasks and united by bucket; no ordinal is shuffled.  For groups that hold a
    good part of their range (4 KB a bucket); others are cheaper to count by rows.
    """
    at = F.col(_ORD) + 1
    buckets = p.groupBy(*by, F.bitmap_bucket_number(at).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("__bits"))
    return buckets.groupBy(*by).agg(F.sum(F.bitmap_count("__bits")).alias("n"))
