"""Column expressions over ``fields ARRAY<STRUCT<name, value>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def usable_entries(fields: Column | str) -> Column:
    """The entries whose name and value are neither null nor empty, as listed; an empty array where ``fields`` is null."""
    kept = F.filter(_col(fields), lambda e: (F.length(e["name"]) > 0) & (F.length(e["value"]) > 0))
    return F.coalesce(kept, F.filter(F.array(F.struct(F.lit("").alias("name"), F.lit("").alias("value"))), lambda e: F.lit(False)))


def distinct_items(fields: Column | str) -> Column:
    """The distinct usable (name, value) pairs of a row."""
    return F.array_distinct(usable_entries(fields))
