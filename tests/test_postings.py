"""Set algebra on postings and statistics per key."""

from collections import Counter

import pytest

from lexigrove.model import EmptyPostings
from lexigrove.operators import postings as sets
from lexigrove.operators.keystats import heavy_keys, key_stats


def _list(p):
    return list(sets.ascending(p))


def test_algebra(spark):
    p = lambda *x: sets.postings(spark, x)
    assert _list(sets.intersect(p(1, 2), p(1, 3))) == [1] and _list(sets.difference(p(1, 2, 3), p(1))) == [2, 3]
    assert _list(sets.union(p(1, 2), p(1, 3))) == [1, 2, 3] and _list(sets.insert(p(1), 1)) == [1]
    assert _list(sets.add_range(p(1), 3, 5)) == [1, 3, 4] and _list(sets.add_range(p(1), 5, 3)) == [1]
    assert _list(sets.remove_range(p(1, 2, 7, 8, 9), 2, 8)) == [1, 8, 9] and _list(sets.bounded(p(42, 47, 57), 0, 50)) == [42, 47]
    assert sets.contains(p(1), 1) and not sets.contains(p(1), 2) and sets.is_empty(p()) and sets.is_empty(sets.cleared(p(1)))
    assert sets.bounds(p(5, 3, 9)) == (3, 9) and sets.size(p(5, 5, 3)) == 2 and sets.equal(p(1, 2), p(2, 1)) and not sets.equal(p(1), p(1, 2))
    with pytest.raises(EmptyPostings):
        sets.bounds(p())


def test_bitmap_counts(spark):
    rows = [("a", 0), ("a", 0), ("a", 32767), ("a", 32768), ("a", 100_000), ("b", 1), (None, 5)]
    df = spark.createDataFrame(rows, "g STRING, doc_ord BIGINT")
    assert {r.g: r.n for r in sets.bitmap_counts(df, ["g"]).collect()} == {"a": 4, "b": 1, None: 1}


ROWS = [("f", "x", 1, 10), ("f", "x", 1, None), ("f", "x", 2, 5), (None, "x", None, 1), ("f", None, 3, None), ("", "", 4, 2), (None, "x", None, 1)]
SCHEMA = "field STRING, term STRING, doc INT, n_rows INT"


def test_key_stats_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    figures = {"low": ("min", "n_rows"), "high": ("max", "n_rows"), "total": ("sum", "n_rows"), "known": ("count", "n_rows"), "all": ("count", None)}
    got = {(r.field, r.term): r for r in key_stats(df, ["field", "term"], figures, distinct=["doc"], distinct_name="docs").collect()}
    for key in {r[:2] for r in ROWS}:
        mine = [r for r in ROWS if r[:2] == key]
        values = [r[3] for r in mine if r[3] is not None]
        r = got.pop(key)
        assert (r.n_rows, r.docs, r.known, r.all) == (len(mine), len({m[2] for m in mine}), len(values), len(mine))
        assert (r.low, r.high, r.total) == ((min(values), max(values), sum(values)) if values else (None, None, None))
    assert not got


def test_heavy_keys(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    n = Counter(r[:2] for r in ROWS)
    for share in ("0.3", 0.28, "1"):
        assert {(r.field, r.term): r.n_rows for r in heavy_keys(df, ["field", "term"], share).collect()} == {k: c for k, c in n.items() if c >= float(share) * len(ROWS)}
    assert heavy_keys(df.where("false"), ["field", "term"], 0.1).count() == key_stats(df.where("false"), ["field"]).count() == 0


def test_hot_key_and_long_text(spark):
    df = spark.range(20_000).selectExpr("IF(id % 3 = 0, repeat('hot', 10000), CAST(id AS STRING)) AS k", "id AS extra", "id AS n_rows")
    (r,) = heavy_keys(df, ["k"], "0.01").collect()
    assert r.n_rows == 6667 and len(r.k) == 30_000


def test_hot_key_plan_combines_before_the_shuffle(spark, capsys):
    key_stats(spark.createDataFrame(ROWS, SCHEMA), ["field", "term"]).explain()
    plan = capsys.readouterr().out
    assert plan.index("functions=[count(1)]") < plan.index("Exchange hashpartitioning") < plan.index("partial_count(1)")


def test_unknown_figure(spark):
    with pytest.raises(ValueError):
        key_stats(spark.createDataFrame(ROWS, SCHEMA), ["field"], {"m": ("median", "doc")})
