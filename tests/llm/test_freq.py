"""Term frequencies: containers, and the whole operator against brute force."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrove.llm import freq

runs = st.builds(lambda a, n: set(range(a, min(a + n, 65536))), st.integers(0, 65535), st.integers(0, 9000))
numbers = st.one_of(st.sets(st.integers(0, 65535), max_size=50), st.lists(runs, max_size=4).map(lambda x: set().union(*x)), st.integers(2, 5).map(lambda k: set(range(0, 65536, k))))


@settings(max_examples=80, deadline=None)
@given(numbers, numbers)
def test_containers(x, y):
    pack = lambda s: freq.pack(np.array(sorted(s), np.int64))
    for s in (x, y):
        assert set(freq.unpack(pack(s)).tolist()) == s and freq.cardinality(pack(s)) == len(s) and len(pack(s)) <= 8193
    assert set(freq.unpack(freq.union([pack(x), pack(y)])).tolist()) == x | y


def test_containers_are_compressed():
    assert len(freq.pack(np.arange(65536))) == 5 and len(freq.pack(np.array([7]))) == 3


SCHEMA = "seq BIGINT, field STRING, term STRING, mark STRING"


def _rows():
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(200_000)), "f", "hot", "x") for _ in range(3000)]
    rows += [(int(rng.integers(200_000)), f"f{rng.integers(3)}", f"t{rng.zipf(1.3) % 500}", "x") for _ in range(6000)]
    rows += [(5, "f", "hot", "x")] * 3 + [(7, None, "a", "x"), (7, "a", None, "x"), (None, "a", "b", "x"), (7, "", "", "x"), (8, "long" * 20_000, "é", "x")]
    return rows


@pytest.mark.parametrize("flush", [100, 500_000])
def test_against_brute_force(spark, flush, monkeypatch):
    monkeypatch.setattr(freq, "_FLUSH", flush)
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    records, occurrences = defaultdict(set), Counter()
    for seq, f, t, _ in rows:
        if None not in (seq, f, t):
            records[f, t].add(seq)
            occurrences[f, t] += 1
    n = 8000
    got = {(r.field, r.term): (r.n_records, r.occurrences, r.mark) for r in freq.term_frequencies(df, "seq", "field", "term", n).collect()}
    mark = lambda k: "rare" if k <= 2 else "common" if k >= 0.3 * n else None
    assert got == {k: (len(s), occurrences[k], mark(len(s))) for k, s in records.items()}


def test_index_and_empty(spark):
    df = spark.createDataFrame([(i, "f", "t", "x") for i in range(0, 200_000, 2)], SCHEMA)
    chunks = {r.chunk: r for r in freq.vertical_index(df, "seq", "field", "term").collect()}
    assert set(chunks) == {0, 1, 2, 3} and sum(r.n_records for r in chunks.values()) == 100_000
    assert sorted(int(x) + (c << 16) for c, r in chunks.items() for x in freq.unpack(bytes(r.bitmap))) == list(range(0, 200_000, 2))
    assert freq.term_frequencies(df.where("false"), "seq", "field", "term", 0).count() == 0
