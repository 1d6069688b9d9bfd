"""Segments as folders of Parquet files.

::

    <root>/segment=<id>/docs/      documents
    <root>/segment=<id>/postings/  postings, range-partitioned and sorted by (field, term, doc_ord)
    <root>/segment=<id>/meta/      one row: version, format, number of documents; written last, as the commit

A term look-up reads the row groups whose statistics admit it; ids have postings too.  What is written later in place of
a segment lies beside it, with a number (``docs.1`` and so on), and holds from the moment its ``meta`` is finished, so
that readers see the old segment or the new one and a crash leaves the old one.  Numbers without a finished ``meta`` are
unfinished writes and are not read.  ``vacuum`` removes what is superseded.

Any number of segments is opened by one listing and one job.  How tables are written and read is a ``Format``.
"""

from __future__ import annotations

import re
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrove.model import DOCS, POSTINGS, LexigroveError
from lexigrove.operators.ingest import to_postings
from lexigrove.sources.snapshot import Snapshot, merged

MAJOR, MINOR = 1, 0
FORMAT = "parquet"
_META = "segment_id BIGINT, major INT, minor INT, format STRING, num_docs BIGINT"


class StoreError(LexigroveError):
    """A folder that is no segment this version can read."""


class Format(Protocol):
    """How the tables of a segment are written and read.  ``name`` is recorded with the segment."""

    name: str

    def write(self, df: DataFrame, path: str) -> None: ...

    def read(self, spark: SparkSession, schema: T.StructType, paths: list[str]) -> DataFrame: ...


class FileFormat:
    """A file format that Spark knows by name (``parquet``, ``orc``, ...)."""

    def __init__(self, name: str):
        self.name = name

    def write(self, df: DataFrame, path: str) -> None:
        df.write.format(self.name).mode("overwrite").save(path)

    def read(self, spark: SparkSession, schema: T.StructType, paths: list[str]) -> DataFrame:
        return spark.read.format(self.name).schema(schema).load(paths)


_FORMATS: dict[str, Format] = {name: FileFormat(name) for name in ("parquet", "orc")}


def register_format(fmt: Format) -> None:
    """Make segments of that format readable, and writable by its name."""
    _FORMATS[fmt.name] = fmt


def _path(root: str, segment_id: int) -> str:
    return f"{root.rstrip('/')}/segment={segment_id}"


def _folders(spark: SparkSession, root: str, pattern: str) -> list:
    """What matches a glob pattern under ``root``, as Hadoop paths."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{pattern}")
    return [s.getPath() for s in where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []]


def _number(name: str, table: str) -> int | None:
    """The number of a folder of ``table``: 0 for the plain name."""
    m = re.fullmatch(rf"{table}(?:\.(\d+))?", name)
    return None if m is None else int(m[1] or 0)


def _numbered(table: str, number: int) -> str:
    return f"{table}.{number}" if number else table


def _current(spark: SparkSession, root: str) -> dict[int, int]:
    """The current number of every finished segment."""
    found: dict[int, int] = {}
    for done in _folders(spark, root, "segment=*/meta*/_SUCCESS"):
        number, segment = _number(done.getParent().getName(), "meta"), re.fullmatch(r"segment=(\d+)", done.getParent().getParent().getName())
        if segment and number is not None:
            found[int(segment[1])] = max(number, found.get(int(segment[1]), 0))
    return found


def save(docs: DataFrame, root: str, segment_id: int, overwrite: bool = False, fmt: str = FORMAT) -> None:
    """Write the documents (doc_ord, id, fields) and their postings as one segment.

    With ``overwrite`` they take the place of what the segment holds, if anything; without, that is an error.
    """
    spark, path = docs.sparkSession, _path(root, segment_id)
    taken = [n for p in _folders(spark, root, f"segment={segment_id}/*") for t in ("docs", "postings", "meta") if (n := _number(p.getName(), t)) is not None]
    if taken and not overwrite:
        raise StoreError(f"{path} exists")
    number = max(taken, default=-1) + 1
    table = lambda name: f"{path}/{_numbered(name, number)}"
    fmt_ = _FORMATS[fmt]
    own = docs.select(F.lit(segment_id).cast("long").alias("segment_id"), F.col("doc_ord").cast("long").alias("doc_ord"), "id", "fields")
    fmt_.write(own, table("docs"))
    written = fmt_.read(spark, DOCS, [table("docs")])
    order = ("field", "term", "doc_ord")
    fmt_.write(to_postings(written).repartitionByRange(*order).sortWithinPartitions(*order), table("postings"))
    meta = spark.createDataFrame([(segment_id, MAJOR, MINOR, fmt, written.count())], _META)
    meta.coalesce(1).write.mode("overwrite").parquet(table("meta"))


def segments(spark: SparkSession, root: str) -> list[int]:
    """The ids of the finished segments under ``root``."""
    return sorted(_current(spark, root))


def _checked(spark: SparkSession, root: str, chosen: list[int] | None) -> tuple[dict[int, int], dict[int, dict]]:
    """The current numbers and the metadata of segments; StoreError where this version cannot read one."""
    current = _current(spark, root)
    chosen = sorted(current) if chosen is None else chosen
    for s in chosen:
        if s not in current:
            raise StoreError(f"{_path(root, s)} holds no finished segment")
    if not chosen:
        return {}, {}
    paths = [f"{_path(root, s)}/{_numbered('meta', current[s])}" for s in chosen]
    rows = {r["segment_id"]: r.asDict() for r in spark.read.schema(_META).parquet(*paths).collect()}  # one row a segment
    for meta in rows.values():
        if meta["major"] != MAJOR:
            raise StoreError(f"version {meta['major']}.{meta['minor']} cannot be read")
        if meta["format"] not in _FORMATS:
            raise StoreError(f"unknown format: {meta['format']}")
    return {s: current[s] for s in chosen}, rows


def metadata(spark: SparkSession, root: str, segment_id: int) -> dict:
    """version, format and number of documents of a segment; StoreError where this version cannot read it."""
    return _checked(spark, root, [segment_id])[1][segment_id]


def all_metadata(spark: SparkSession, root: str) -> DataFrame:
    """(segment_id, major, minor, format, num_docs) of all finished segments."""
    current = _current(spark, root)
    if not current:
        return spark.createDataFrame([], _META)
    return spark.read.schema(_META).parquet(*[f"{_path(root, s)}/{_numbered('meta', n)}" for s, n in sorted(current.items())])


def load(spark: SparkSession, root: str, segment_ids: list[int] | None = None) -> Snapshot:
    """The given segments, by default all finished ones, as one snapshot."""
    numbers, meta = _checked(spark, root, segment_ids)
    if not numbers:
        return Snapshot(spark.createDataFrame([], DOCS), spark.createDataFrame([], POSTINGS), ids_posted=True)
    docs = postings = None
    for fmt in sorted({m["format"] for m in meta.values()}):
        own = [s for s in numbers if meta[s]["format"] == fmt]
        tables = [
            _FORMATS[fmt].read(spark, schema, [f"{_path(root, s)}/{_numbered(name, numbers[s])}" for s in own])
            for name, schema in (("docs", DOCS), ("postings", POSTINGS))
        ]
        docs, postings = tables if docs is None else (docs.unionByName(tables[0]), postings.unionByName(tables[1]))
    return Snapshot(docs, postings, ids_posted=True)


def remove(spark: SparkSession, root: str, segment_ids: list[int]) -> None:
    """Remove segments.  Their metadata go first, so that a crash leaves nothing that is read in part."""
    for s in segment_ids:
        folders = _folders(spark, root, f"segment={s}/*")
        for p in sorted(folders, key=lambda p: _number(p.getName(), "meta") is None) + _folders(spark, root, f"segment={s}"):
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def vacuum(spark: SparkSession, root: str) -> int:
    """Remove the folders of segments that newer ones have superseded, and return their number.  Not while they are read."""
    current, removed = _current(spark, root), 0
    for p in _folders(spark, root, "segment=*/*"):
        segment = re.fullmatch(r"segment=(\d+)", p.getParent().getName())
        number = next((n for t in ("docs", "postings", "meta") if (n := _number(p.getName(), t)) is not None), None)
        if segment and number is not None and number < current.get(int(segment[1]), 0):
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
            removed += 1
    return removed


def merge(spark: SparkSession, root: str, segment_ids: list[int], target: int) -> None:
    """Write the documents of several segments as one new segment, in the order given; of one id the first stays.

    The sources stay as they are; ``remove`` them once readers have moved on.
    """
    if target in segment_ids:
        raise StoreError("a segment cannot be merged into itself")
    save(merged([load(spark, root, [s]).docs for s in segment_ids], target), root, target)
