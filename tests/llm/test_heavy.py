"""Frequent values: the sketch's bounds, and whole results."""

from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrove.llm.heavy import HierarchicalSketch, SketchShape, frequent_values


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from(["0.002", "0.01", "0.05"]))
def test_every_heavy_hash_lies_under_a_surviving_prefix(seed, share):
    rng, share = np.random.default_rng(seed), Fraction(share)
    values = (rng.pareto(0.6, 40_000) * 5).astype(np.uint64)
    hashes = (values * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    shape = SketchShape.for_share(share)
    sketch = HierarchicalSketch(shape)
    for part in np.array_split(hashes, 3):
        sketch.add(part)
    assert sketch.total == len(hashes)
    prefix, estimates = sketch.descend(share)
    found = dict(zip(prefix.tolist(), estimates.tolist()))
    for h, n in Counter(hashes.view(np.uint64).tolist()).items():
        if n >= share * len(hashes):
            assert abs(found[h >> 24] - n) < 0.6 * share * len(hashes)
    assert len(found) <= 4 / share


def test_sketches_add_up():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(2**63), 2**63, (2, 1000), dtype=np.int64)
    shape = SketchShape(width=1024)
    x, y, z = (HierarchicalSketch(shape) for _ in range(3))
    x.add(a), y.add(b), z.add(np.r_[a, b])
    assert ((x.cells + y.cells) == z.cells).all()


ROWS = ["a"] * 40 + ["b"] * 40 + ["", "A", "a ", "x" * 50_000] * 5 + [None] * 30 + [f"r{i}" for i in range(300)]


@pytest.mark.parametrize("share", ["0.1", "0.0125", 0.5, "0.005"])
def test_against_brute_force(spark, share):
    df = spark.createDataFrame([(v, 1, "e") for v in ROWS], "value STRING, n INT, prefix STRING").repartition(5)
    counts = Counter(v for v in ROWS if v is not None)
    total = sum(counts.values())
    got = {r.value: r for r in frequent_values(df, "value", share).collect()}
    assert {v: r.n for v, r in got.items()} == {v: c for v, c in counts.items() if c >= Fraction(str(share)) * total}
    assert all(abs(r.approx_n - r.n) <= 3 and r.share == r.n / total for r in got.values())


def test_edges(spark):
    none = spark.createDataFrame([(None,)], "value STRING")
    assert frequent_values(none, "value", 0.1).count() == frequent_values(none.where("false"), "value", 0.1).count() == 0
    for bad in (0, 1.5, -1):
        with pytest.raises(ValueError):
            frequent_values(none, "value", bad)


def test_shares_that_need_too_wide_a_sketch_are_refused():
    assert HierarchicalSketch(SketchShape.for_share(Fraction(1, 1 << 14))).cells.nbytes < 127 << 20
    with pytest.raises(ValueError):
        SketchShape.for_share(Fraction(1, 1 << 15))


def test_partial_sketches_follow_the_input(spark, monkeypatch):
    from lexigrove.llm import heavy

    hashes = spark.range(1000).selectExpr("id AS h")
    usual = heavy._tasks(hashes)
    assert usual == max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    monkeypatch.setattr(heavy, "_INPUT", 80)
    assert heavy._tasks(hashes) == 100
    assert heavy.build_sketch(hashes, SketchShape(1 << 10)).total == 1000
