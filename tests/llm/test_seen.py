"""Seen keys: filters, order, repeats, hot keys, errors."""

import numpy as np
import pytest

from lexigrove.llm.seen import BlockedBloom, StackedBloom, error_report, seen_before, verified

SCHEMA = "seq BIGINT, id STRING, key STRING"


def _hashes(n, seed):
    return np.random.default_rng(seed).integers(-(2**63), 2**63, n, dtype=np.int64)


@pytest.mark.parametrize("fpr", [0.1, 0.01, 0.001])
def test_filter_keeps_its_rate(fpr):
    bloom = BlockedBloom(100_000, fpr)
    keys = _hashes(100_000, 1)
    bloom.insert(keys)
    assert bloom.query(keys).all()
    assert bloom.query(_hashes(200_000, 2)).mean() < 1.5 * fpr


def test_stack_grows_and_keeps_its_rate():
    bloom = StackedBloom(1_000, 0.01)
    keys = _hashes(100_000, 3)
    assert bloom.query_then_insert(keys).mean() < 0.015
    assert len(bloom.layers) > 3 and bloom.query(keys).all() and bloom.query(_hashes(100_000, 4)).mean() < 0.015
    assert bloom.bits < 40 * 100_000


def test_batch_order():
    assert StackedBloom(100, 0.01).query_then_insert(np.array([5, 5, 7, 5], np.int64)).tolist() == [False, True, False, True]


def _brute(rows):
    first = {}
    for seq, id, _ in rows:
        if id:
            first[id] = min(seq, first.get(id, seq))
    return {(seq, id, bool(id) and seq > first[id]) for seq, id, _ in rows}


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "hot" if rng.random() < 0.34 else f"k{rng.integers(4000)}", "x") for i in range(6000)]
    rows += [(6000, None, "x"), (6001, "", "x"), (6002, None, "x"), (6003, "a" * 100_000, "x"), (6004, "a" * 100_000, "x"), (6005, "tie", "x"), (6005, "tie", "x"), (6006, "Hot", "x")]
    no_order = [(None, "hot", "x"), (None, "late", "x")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(a), b, c) for a, b, c in rows] + no_order, SCHEMA).repartition(7)
    absent = spark.createDataFrame([(f"absent{i}",) for i in range(3000)] + [(None,), ("",)], "id STRING")
    for fpr in (0.5, 0.01):
        result = seen_before(df, "seq", "id", fpr=fpr, keys_per_filter=500, absent=absent, absent_key="id")
        got = [tuple(r) for r in verified(result, "seq").collect()]
        expected = _brute([(int(a), b, c) for a, b, c in rows]) | {(None, "hot", False), (None, "late", False)}
        assert len(got) == len(rows) + 2 and set(got) == expected
        flags = {(r.ord, r.key): r for r in result.flags.collect()}
        assert all(flags[a, b].maybe_seen for a, b, c in got if c)  # never a wrong "new"
        (report,) = error_report(result).collect()
        assert report.n_rows == len(rows) + 2 and report.n_absent == 3000 and report.absent_error_rate <= 1.5 * fpr and report.wrong_share <= fpr


def test_other_batches_on_a_second_reading(spark):
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    rows = [(i, f"k{i % 50}", "x") for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    try:
        for first, second in ((10, 1000), (1000, 10)):
            spark.conf.set(size, first)
            result = seen_before(df, "seq", "id")
            spark.conf.set(size, second)
            got = [tuple(r) for r in verified(result, "seq").collect()]
            assert len(got) == len(rows) and set(got) == _brute(rows)
    finally:
        spark.conf.set(size, before)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    result = seen_before(df, "seq", "id")
    assert verified(result).count() == 0
    (report,) = error_report(result).collect()
    assert report.n_rows == 0 and report.wrong_share is None and report.absent_error_rate is None
