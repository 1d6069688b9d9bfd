"""Comparison of a query with its SQL on DuckDB."""

from pathlib import Path

import duckdb
import pandas as pd

FOLDER = "/root/testdata/sf0.001"


def connection(folder=FOLDER):
    con = duckdb.connect()
    for f in Path(folder).iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(frame):
    def plain(x):
        if pd.api.types.is_scalar(x) and pd.isna(x):
            return None
        if isinstance(x, float):
            return str(int(x)) if x.is_integer() else f"{x:.9g}"
        return str(x)

    return sorted((tuple(plain(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


def same(spark, query, sql, folder=FOLDER):
    ours, theirs = query(spark, folder).toPandas(), connection(folder).execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
