"""Figures per key when a few keys hold most rows.

Every figure is algebraic: Spark aggregates in bounded hash tables inside each map task (spilling to a sort when they
fill up), and only one compact partial state per key and task is shuffled.  A key that holds a third of all rows thus
arrives at its reducer as one state per map task.  Distinct counts are not algebraic; they take a step of their own on
(key, counted value), which spreads a hot key over all tasks by what is counted and carries nothing else.  Its rows, one
for each distinct value, join the rows of the other figures in the last aggregate, combined in the map tasks like them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FIGURES = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}


def key_stats(
    df: DataFrame,
    keys: Sequence[str],
    figures: Mapping[str, tuple[str, str | None]] | None = None,
    distinct: Sequence[str] = (),
    distinct_name: str = "n_distinct",
    rows_name: str = "n_rows",
) -> DataFrame:
    """One row per key: row count, ``figures`` and optionally the number of distinct ``distinct`` combinations.

    ``figures`` maps an output name to (``count`` | ``sum`` | ``min`` | ``max``, column).  Null keys form a key of their
    own, as in GROUP BY; nulls are ignored by the figures, while a combination in ``distinct`` counts once even if parts
    are null.  Repeated rows count as they stand.  Columns that are not named are never read, so extra columns with the
    names of outputs do no harm.  An empty table gives an empty result.
    """
    figures = dict(figures or {})
    bad = [kind for kind, _ in figures.values() if kind not in _FIGURES]
    if bad:
        raise ValueError(f"not an algebraic figure: {bad[0]}")
    key = {f"__k{i}": c for i, c in enumerate(keys)}
    unit = {f"__u{i}": c for i, c in enumerate(distinct)}
    value = {f"__v{i}": c for i, (_, c) in enumerate(figures.values()) if c is not None}
    narrow = df.select(*[df[c].alias(a) for a, c in (key | unit | value).items()])
    rows, n_rows = narrow.select(*key, *value), F.count(F.lit(1))
    if unit:
        rows, n_rows = rows.select("*", F.lit(1).alias("__n"), F.lit(0).alias("__d")), F.sum("__n")
        units = narrow.select(*key, *unit).distinct()
        nothing = [F.lit(None).cast(narrow.schema[v].dataType).alias(v) for v in value]
        rows = rows.unionByName(units.select(*key, *nothing, F.lit(0).alias("__n"), F.lit(1).alias("__d")))

    def figure(i: int, kind: str, c: str | None) -> Column:
        return n_rows if c is None else _FIGURES[kind](f"__v{i}")

    computed = [n_rows, *(figure(i, kind, c) for i, (kind, c) in enumerate(figures.values())), *([F.sum("__d")] if unit else [])]
    result = rows.groupBy(*key).agg(*[c.alias(f"__o{i}") for i, c in enumerate(computed)])
    outputs = [rows_name, *figures, *([distinct_name] if unit else [])]
    return result.select(*[F.col(a).alias(c) for a, c in key.items()], *[F.col(f"__o{i}").alias(c) for i, c in enumerate(outputs)])


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float | str, rows_name: str = "n_rows") -> DataFrame:
    """The keys that hold at least ``share`` of all rows, with their row counts.

    The comparison is exact: ``share`` is taken as the decimal fraction that it is written as.
    """
    part = Fraction(str(share))
    total = df.select(F.count(F.lit(1)).alias("n")).scalar()
    counted = key_stats(df, keys, rows_name=rows_name)
    return counted.where(F.col(rows_name) * F.lit(part.denominator) >= total * F.lit(part.numerator))
