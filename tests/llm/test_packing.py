"""Packing: sizes, configurations, pieces, and how full containers get."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrove.llm.packing import best_configurations, pack, pack_sizes, packing_report
from lexigrove.llm.tokens import with_token_counts


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=200), st.sampled_from([3, 8]), st.sampled_from([2, 10, 60]))
def test_packings_are_valid(sizes, part, groups):
    sizes = np.array(sizes)
    where = pack_sizes(sizes, 100, groups, part)
    load = np.bincount(where, weights=sizes)
    assert where.min() == 0 and load.max() <= 100 and load.min() > 0
    assert len(load) <= max(1.7 * sizes.sum() / 100 + 2 + (sizes > 50).sum(), 1)


def test_configurations_solve_the_linear_program():
    plan = best_configurations([60, 40, 20], [10, 10, 10], 100)
    assert sum(t for _, t in plan) == pytest.approx(12.0, abs=1e-6)
    for j, need in enumerate([10, 10, 10]):
        assert sum(c[j] * t for c, t in plan) == pytest.approx(need, abs=1e-6)
    assert all(c[0] * 60 + c[1] * 40 + c[2] * 20 <= 100 for c, _ in plan)
    assert sum(t for _, t in best_configurations([45, 35, 25], [97, 211, 305], 100)) == pytest.approx(97 / 2 + 211 * 3 / 8 + 305 / 4)


@pytest.mark.parametrize("seed", [1, 2])
def test_containers_are_nearly_full(seed):
    rng = np.random.default_rng(seed)
    sizes = np.clip(rng.gamma(1.2, 210, 20_000).astype(int) + 4, 1, 1024)
    n = pack_sizes(sizes, 1024).max() + 1
    assert n <= 1.005 * math.ceil(sizes.sum() / 1024)


SCHEMA = "doc_id BIGINT, n_tokens BIGINT, shard STRING"


def test_pieces(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), int(rng.integers(0, 400)), "x") for i in range(2000)] + [(5000, 1024, "x"), (5001, 1025, "x"), (5002, 2048, "x"), (5003, 300_000, "x"), (5004, 0, "x"), (7, 9, "x"), (7, 9, "x"), (None, 30, "x"), (None, 2000, "x"), (6000, None, "x")]
    packed = pack(spark.createDataFrame(rows, SCHEMA), 1024, shard_items=500)
    assert packing_report(packed).collect() == [(len(rows), 0, 0, True, True)]
    assert all(len({r.shard for r in part}) == 1 for part in packed.select("shard").rdd.glom().collect() if part)
    got = packed.collect()
    load, pieces = defaultdict(int), defaultdict(list)
    assert [(r.n_tokens, r.container) for r in got if r.doc_id == 6000] == [(0, None)]
    rows[-1] = (6000, 0, "x")
    for r in got:
        pieces[r.doc_id, r.n_tokens].append(r)
        if r.container is None:
            assert r.n_pieces == r.n_tokens == r.piece_tokens == 0
        else:
            load[r.shard, r.container] += r.piece_tokens
    assert max(load.values()) == 1024 and set(pieces) == {r[:2] for r in rows}
    for (_, n), rs in pieces.items():
        copies = sum(1 for r in rows if r[:2] == (rs[0].doc_id, n))
        assert len(rs) == copies * max(1, math.ceil(n / 1024)) and sum(r.piece_tokens for r in rs) == copies * n
        assert all(r.n_pieces == math.ceil(n / 1024) for r in rs)
        if copies == 1:
            assert sorted(r.piece for r in rs) == list(range(len(rs)))
    assert sum(load.values()) / 1024 / len(load) > 0.97


def test_null_and_repeated_ids_are_spread(spark):
    rows = [(None, 30, "x")] * 1500 + [(7, 30, "x")] * 1500 + [(i, 30, "x") for i in range(1000)]
    got = pack(spark.createDataFrame(rows, SCHEMA), 1024, shard_items=500).collect()
    sizes = Counter(r.shard for r in got)
    assert len(sizes) == 8 and max(sizes.values()) < 650
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter(r[:2] for r in rows)


def test_token_counts(spark):
    rows = [(1, None, 3), (2, "", 3), (3, "Hello world", 3), (4, "<|endoftext|>", 3), (5, "word " * 5000, 3)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, n_tokens INT")
    got = {r.doc_id: r.n_tokens for r in with_token_counts(df, "doc_id", "text").collect()}
    assert got[1] == got[2] == 0 and got[3] == 2 and got[4] > 1 and 5000 <= got[5] <= 5002


def test_empty(spark):
    assert pack(spark.createDataFrame([], SCHEMA)).count() == 0
