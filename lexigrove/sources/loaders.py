"""Documents from other shapes of data."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.model import LexigroveError
from lexigrove.operators.ingest import new_id


def entries(columns: Mapping[str, Column]) -> Column:
    """``fields`` from columns: one entry for each column that is not null, in order."""
    listed = F.array(*[F.struct(F.lit(name).alias("name"), c.cast("string").alias("value")) for name, c in columns.items()])
    return F.filter(listed, lambda e: e["value"].isNotNull())


def rows_as_documents(df: DataFrame, id: str, columns: Mapping[str, Column | str], segment: Column | int = 0) -> DataFrame:
    """(segment_id, doc_ord, id, fields): one document per row; ``id`` is an integer column and the ordinal too."""
    named = {name: F.col(c) if isinstance(c, str) else c for name, c in columns.items()}
    segment = F.lit(segment) if isinstance(segment, int) else segment
    return df.select(segment.cast("long").alias("segment_id"), F.col(id).cast("long").alias("doc_ord"), F.col(id).cast("string").alias("id"), entries(named).alias("fields"))


def read_json_lines(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """(id, fields) of a file with one flat JSON object of strings per line.

    Pairs with an empty or null key or value are dropped; ids are random and differ each time the result is evaluated.
    With ``n``, that many documents are taken, and fewer are an error.  A line that is no such object is an error.
    """
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    if n is not None:
        lines = lines.limit(n)
    parsed = F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})
    pairs = F.transform(F.map_entries(parsed), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    kept = F.filter(pairs, lambda e: (F.length(e["name"]) > 0) & (F.length(e["value"]) > 0))
    docs = lines.select(new_id().alias("id"), kept.alias("fields"))
    if n is not None and (found := lines.count()) != n:
        raise LexigroveError(f"{n} documents were asked for, {found} found")
    return docs
