"""Search: three plans and a model in plain Python agree; segments, bounds and quirks."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lexigrove.model import DOCS, ID_FIELD, ClosedError, DocumentNotFound
from lexigrove.operators.ingest import to_postings
from lexigrove.query import And, Not, Or, Regexp, Term
from lexigrove.sources.snapshot import Snapshot, merged

DATA = [
    (0, 0, "a", [("fruit", "banana"), ("color", "yellow")]),
    (0, 1, "b", [("fruit", "apple"), ("color", "red")]),
    (0, 2, "42", [("fruit", "pineapple"), ("color", "yellow")]),
    (0, 3, None, [("fruit", "apple"), ("fruit", "banana")]),
    (0, 4, "", []),
    (1, 0, "a", [("fruit", "apple"), ("color", None), (None, "apple"), ("", "")]),
    (1, 1, "c", None),
    (1, 2, "d", [("color", "green"), ("color", "green"), None]),
]


@pytest.fixture(scope="module")
def snapshot(spark):
    docs = spark.createDataFrame(DATA, DOCS).cache()
    return Snapshot(docs, to_postings(docs).cache())


def _model(q, doc):
    _, _, id, fields = doc
    values = [f for f in fields or [] if f and None not in f] + ([(ID_FIELD, id)] if id is not None else [])
    if isinstance(q, Term):
        return (q.field, q.value) in values
    if isinstance(q, Regexp):
        return any(n == q.field and re.search(q.pattern, v) for n, v in values)
    if isinstance(q, Not):
        return not _model(q.query, doc)
    parts = [_model(c, doc) for c in q.queries]
    return bool(parts) and (all(parts) if isinstance(q, And) else any(parts))


terms = st.builds(Term, st.sampled_from(["fruit", "color", "none", "", ID_FIELD]), st.sampled_from(["apple", "banana", "yellow", "a", ""]))
queries = st.recursive(
    terms | st.builds(Regexp, st.sampled_from(["fruit", "color", ID_FIELD]), st.sampled_from(["^a", "pple", "n.*a", "^$", "."])),
    lambda q: st.builds(Not, q) | st.lists(q, max_size=3).map(lambda x: And(*x)) | st.lists(q, max_size=3).map(lambda x: Or(*x)),
    max_leaves=5,
)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(queries)
def test_plans_agree_with_model(snapshot, q):
    expected = sorted((d[0], d[1]) for d in DATA if _model(q, d))
    for strategy in ("scan", "flags", "joins", "lookup"):
        found = sorted((r.segment_id, r.doc_ord) for r in snapshot.match(q, strategy).collect())
        assert found == expected, (strategy, str(q))


def _ids(df):
    return sorted((r.segment_id, r.doc_ord) for r in df.collect())


def test_empty_intersection_in_one_segment(snapshot):
    q = And(Term("fruit", "apple"), Regexp(ID_FIELD, "^a$"))
    assert _ids(snapshot.search(q, "joins")) == _ids(snapshot.search(q)) == [(1, 0)]


def test_nested_negation_is_kept(snapshot):
    q = And(And(Term("fruit", "apple"), Not(Term("fruit", "banana"))), Term("color", "red"))
    assert _ids(snapshot.search(q)) == [(0, 1)]


def test_search_without_postings(spark):
    assert _ids(Snapshot(spark.createDataFrame(DATA, DOCS)).search(Not(Term("fruit", "apple")))) == [(0, 0), (0, 2), (0, 4), (1, 1), (1, 2)]
    with pytest.raises(ValueError):
        Snapshot(spark.createDataFrame(DATA, DOCS)).search(Term("a", "b"), "fast")


def test_empty_collection(spark):
    s = Snapshot(spark.createDataFrame([], DOCS))
    assert s.search(Not(Term("a", "b"))).count() == s.size() == s.fields().count() == 0


def test_dictionary(snapshot):
    assert {r.field for r in snapshot.fields().collect()} == {"fruit", "color", "", ID_FIELD}
    assert {r.term for r in snapshot.terms("color").collect()} == {"yellow", "red", "green"}
    assert snapshot.terms("none").count() == 0 and snapshot.terms(ID_FIELD).count() == 6
    assert snapshot.contains_id("42") and not snapshot.contains_id("43")
    assert snapshot.contains_term("fruit", "apple") and not snapshot.contains_term("color", "apple")
    assert snapshot.contains_field("fruit") and not snapshot.contains_field("none")
    assert {(r.field, r.term): r.n for r in snapshot.document_frequency().collect()}["fruit", "apple"] == 3


def test_lookup_by_ordinal(snapshot):
    assert snapshot.doc(0, 2).id == "42"
    with pytest.raises(DocumentNotFound):
        snapshot.doc(0, 99)


def test_bound_applies_to_documents_and_postings(spark):
    docs = spark.createDataFrame(DATA, DOCS)
    s = Snapshot(docs, to_postings(docs), bound=2)
    assert s.size() == 4 and _ids(s.search(Term("fruit", "apple"))) == [(0, 1), (1, 0)]
    assert {r.n for r in s.document_frequency().where("field = 'fruit' AND term = 'apple'").collect()} == {2}
    assert _ids(s.fetch(docs.select("segment_id", "doc_ord"))) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_closing(spark):
    with Snapshot(spark.createDataFrame(DATA, DOCS)) as s:
        assert s.size() == 8
    for use in (s.close, s.all_docs, lambda: s.search(Term("a", "b")), s.fields):
        with pytest.raises(ClosedError):
            use()
    assert s.size() == 0


def test_merge_keeps_the_first(spark):
    docs = spark.createDataFrame(DATA, DOCS)
    one, two = docs.where("segment_id = 1"), docs.where("segment_id = 0")
    found = merged([one, two], 7).orderBy("doc_ord").collect()
    assert [r.id for r in found] == ["a", "c", "d", "b", "42", None, ""] and [r.doc_ord for r in found] == list(range(7))
    assert found[0].fields[0].value == "apple" and {r.segment_id for r in found} == {7}


def test_extra_columns_pass_through(spark, snapshot):
    docs = spark.createDataFrame(DATA, DOCS).selectExpr("*", "id AS term", "doc_ord AS field")
    found = Snapshot(docs, to_postings(docs)).search(Term("color", "red"))
    assert found.columns == docs.columns and found.count() == 1


def test_a_rare_term_moves_no_documents(spark, tmp_path, capsys):
    from lexigrove.plans import compile as plans
    from lexigrove.sources import store

    store.save(spark.createDataFrame([d for d in DATA if d[0] == 0], DOCS), str(tmp_path), 0)
    stored = store.load(spark, str(tmp_path))
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before, limit = spark.conf.get(threshold), plans.LOOKUP_KEYS
    spark.conf.set(threshold, -1)
    try:
        found = stored.search(And(Term("fruit", "apple"), Not(Term("color", "red"))), "lookup")
        found.explain("formatted")
        plan = capsys.readouterr().out
        assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
        assert "GreaterThanOrEqual(doc_ord,3)" in plan and ("In(segment_id" in plan or "EqualTo(segment_id,0)" in plan)
        assert _ids(found) == [(0, 3)] and _ids(stored.search(Term("fruit", "none"), "lookup")) == []
        plans.LOOKUP_KEYS = 0
        assert _ids(stored.search(Term("fruit", "apple"), "lookup")) == [(0, 1), (0, 3)]
    finally:
        plans.LOOKUP_KEYS = limit
        spark.conf.set(threshold, before)
