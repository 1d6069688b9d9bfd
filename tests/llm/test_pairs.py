"""Pairs of items: block counting and the whole operator against brute force."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrove.llm import pairs


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), max_size=12), max_size=40), st.sets(st.integers(0, 30), max_size=10), st.integers(1, 40))
def test_block_counter(records, heavy, buffer):
    old, pairs._PAIRS = pairs._PAIRS, buffer
    try:
        start = np.r_[0, np.cumsum([len(r) for r in records])].astype(np.int64)
        codes = np.array([c for r in records for c in r], np.int64)
        got = Counter()
        for a, b, n in pairs.BlockCounter(np.array(sorted(heavy), np.int64)).count(start, codes):
            for x, y, k in zip(a.tolist(), b.tolist(), n.tolist()):
                assert x < y
                got[x, y] += k
    finally:
        pairs._PAIRS = old
    assert got == Counter(p for r in records for p in combinations(sorted(r), 2))


SCHEMA = "k INT, n_a STRING, items ARRAY<STRUCT<name: STRING, value: STRING>>"


def _rows():
    rng = np.random.default_rng(2)
    rows = [(i, "x", [("hot", "1"), *[(f"n{rng.integers(3)}", f"v{rng.zipf(1.5) % 50}") for _ in range(rng.integers(0, 8))]]) for i in range(400)]
    rows += [(0, "x", None), (0, "x", []), (0, "x", [("a", None), (None, "b"), ("", ""), ("", ""), ("long" * 5000, "z"), ("a", "b")])] * 2
    return [*rows, (1, "x", [("many", str(i)) for i in range(400)])]


@pytest.mark.parametrize(("least", "keep"), [(1, 10**6), (1, 0), (3, 10**6), (3, 5)])
def test_against_brute_force(spark, least, keep):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    sets_ = [sorted({tuple(i) for i in r[2] or [] if None not in i}) for r in rows]
    single = Counter(i for s in sets_ for i in s)
    both = {p: n for p, n in Counter(p for s in sets_ for p in combinations(s, 2)).items() if n >= least}
    got = pairs.together(df, "items", min_count=least, keep_at_most=keep).collect()
    assert len(got) == len(both)
    for r in got:
        a, b = (r.name_a, r.value_a), (r.name_b, r.value_b)
        assert (r.n_ab, r.n_a, r.n_b, r.n_rows) == (both[a, b], single[a], single[b], len(rows))
        assert r.lift == pytest.approx(r.n_ab * len(rows) / (r.n_a * r.n_b))


def test_hash_clash_takes_another_seed(spark, monkeypatch):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(_rows()[:50], SCHEMA)
    expected = {tuple(r) for r in pairs.together(df, "items").collect()}
    real = F.xxhash64
    seeds = []

    def clashing(seed, *columns):
        seeds.append(seed)
        weak = "CAST(0 AS INT)" in str(seed) or "'0'" in str(seed) or str(seed) == "Column<'0'>"
        return F.pmod(real(seed, *columns), F.lit(3)) if weak else real(seed, *columns)

    monkeypatch.setattr(pairs.F, "xxhash64", clashing)
    assert {tuple(r) for r in pairs.together(df, "items").collect()} == expected
    assert len({str(s) for s in seeds}) == 2


def test_clashes_of_rare_items_do_no_harm(spark, monkeypatch):
    """All rare items share two hashes: no second attempt, right counts, with the array and with the filter."""
    from pyspark.sql import functions as F

    rows = [(i, "x", [("common", str(i % 3)), ("also", str(i % 2)), *[("rare", f"{i}-{k}") for k in range(4)]]) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    expected = {tuple(r) for r in pairs.together(df, "items", min_count=10).collect()}
    assert len(expected) == 6
    real, seeds = F.xxhash64, set()

    def clashing(seed, name, value):
        seeds.add(str(seed))
        return F.when(name == "rare", F.pmod(real(value), F.lit(2))).otherwise(real(seed, name, value))

    monkeypatch.setattr(pairs.F, "xxhash64", clashing)
    for keep in (10**6, 2):
        assert {tuple(r) for r in pairs.together(df, "items", min_count=10, keep_at_most=keep).collect()} == expected
    assert len(seeds) == 1


def test_filter(spark):
    codes = np.random.default_rng(3).integers(-(2**63), 2**63, 20_000, dtype=np.int64)
    kept = pairs._filter(spark.createDataFrame([(int(c),) for c in codes[:5_000]], "code BIGINT"), 5_000)
    _, stays = pairs._pruned(np.array([0, len(codes)]), codes, kept)
    assert set(codes[:5_000].tolist()) <= set(stays.tolist()) and len(stays) < 5_000 + 0.1 * 15_000


def test_empty(spark):
    assert pairs.together(spark.createDataFrame([], SCHEMA), "items").count() == 0
    assert pairs.together(spark.createDataFrame([(1, "x", None)], SCHEMA), "items").count() == 0
