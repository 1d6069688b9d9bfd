"""Training-data queries against SQL, and that nothing else needs the package."""

import pathlib
import re

import pytest
from oracle import FOLDER, connection, same

from lexigrove.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.SQL[name])


def test_nothing_else_imports_the_package():
    root = pathlib.Path(__file__).resolve().parents[2] / "lexigrove"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"lexigrove\.llm|from \.+llm", p.read_text()), p


def _run(spark, name):
    return queries.QUERIES[name](spark, FOLDER).toPandas()


def test_queries_without_sql(spark):
    """Every query that SQL cannot express, on whole tables, against what it must fulfil."""
    from lexigrove.llm.glyphs import consistent
    from lexigrove.llm.leak import words
    from lexigrove.llm.tokens import DEFAULT_RANKS, encoding

    assert set(queries.QUERIES) - set(queries.SQL) == {"p2_error_rate", "p6_packed", "p7_leaks", "p7_scrubbed", "p8_consistent"}
    documents = connection().execute("SELECT doc_id, text FROM documents").df().set_index("doc_id")["text"]
    documents = {k: None if t is None or t != t else t for k, t in documents.items()}

    (report,) = _run(spark, "p2_error_rate").itertuples()
    counts = _run(spark, "p2_counts").iloc[0]
    assert (report.n_rows, report.n_seen) == (counts.n_rows, counts.n_seen) and report.n_absent > 0 and report.absent_error_rate <= 0.2 and report.wrong_share <= 0.02

    enc = encoding(DEFAULT_RANKS)
    tokens = {k: len(enc.encode_ordinary(t)) if t else 0 for k, t in documents.items()}
    assert set(_run(spark, "p6_found").doc_id) == {k for k, n in tokens.items() if n > 1024}
    packed = _run(spark, "p6_packed")
    assert packed.groupby("doc_id").piece_tokens.sum().to_dict() == tokens and packed.groupby(["shard", "container"]).piece_tokens.sum().max() <= 1024

    leaks, found = _run(spark, "p7_leaks"), _run(spark, "p7_found")
    assert set(leaks[["doc_id", "item_id"]].itertuples(index=False, name=None)) == set(found.itertuples(index=False, name=None)) and (leaks.coverage >= 0.5).all()
    scrubbed = dict(_run(spark, "p7_scrubbed").itertuples(index=False, name=None))
    removed = {}
    for r in leaks.itertuples():
        removed.setdefault(r.doc_id, set()).update(range(r.first_word, r.last_word + 1))
    for k, t in documents.items():
        left = [w for i, w in enumerate(words(t or "")) if i not in removed.get(k, ())]
        assert words(scrubbed[k] or "") == left and (k in removed or scrubbed[k] == t)

    forms = dict(_run(spark, "p8_consistent").itertuples(index=False, name=None))
    assert forms == {k: consistent(t) for k, t in documents.items()}
    pairs = set(_run(spark, "p8_found").itertuples(index=False, name=None))
    by_form = {}
    for k, f in forms.items():
        if f is not None:
            by_form.setdefault(f, []).append(k)
    assert pairs == {(min(a, b), max(a, b)) for ks in by_form.values() for a in ks for b in ks if documents[a] != documents[b]}
