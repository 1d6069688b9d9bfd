"""Queries, their equality, text and codecs."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrove.codec import from_json, marshal, to_json, unmarshal
from lexigrove.query import And, Not, Or, Regexp, Term

A, B, C = Term("fruit", "apple"), Term("fruit", "banana"), Regexp("color", ".*ow")


def test_equality_of_normal_forms():
    assert And(A) == A == Or(A) and Or(Or(A), B) == Or(A, B) and And(And(A, B), C) == And(A, B, C)
    assert And(A, B) != And(B, A) and And(A) != And(A, Not(B)) and A != And(A, Not(B))
    assert And() == And() and And() != Or() and And(And()) == And()
    assert hash(And(A)) == hash(A) and Term("a", "b") != Term("a", "c") and A != "apple"
    assert Regexp("a", "b") != Regexp("a", "b", anchored=True)


def test_text_shows_every_operand():
    assert str(And(A, Not(B))) == "conjunction(term(fruit, apple), negation(term(fruit, banana)))"
    assert str(Or(A, C)) == "disjunction(term(fruit, apple), regexp(color, .*ow))"
    assert repr(And(A)) == f"And({A!r},)"


def test_operators():
    assert (A & ~B) == And(A, Not(B)) and (A | B) == Or(A, B)


def test_operands_must_be_queries():
    for make in (lambda: Not(None), lambda: And(A, "x"), lambda: Or(None)):
        with pytest.raises(TypeError):
            make()


def test_wire_format_is_proto3():
    assert marshal(Term("a", "bc")) == b"\x0a\x07\x0a\x01a\x12\x02bc"
    assert marshal(Not(Term("", ""))) == b"\x1a\x04\x0a\x02\x0a\x00"
    assert str(unmarshal(marshal(And(Not(A), B)))) == str(And(B, Not(A)))


@pytest.mark.parametrize("data", [b"", b"\x1a\x00", b"\x32\x00", b"\x0a\x05\x0a", b"\x0a\x03\x0a\x01\xff", b"\xff" * 12, b"\x07"])
def test_broken_bytes(data):
    with pytest.raises(ValueError):
        unmarshal(data)


def test_nothing_to_write():
    for f in (marshal, to_json):
        with pytest.raises(ValueError):
            f(None)


texts = st.text(max_size=5)
queries = st.recursive(
    st.builds(Term, texts, texts) | st.builds(Regexp, texts, st.sampled_from(["a.", "^b", ".*"])),
    lambda q: st.builds(Not, q) | st.lists(q, max_size=3).map(lambda x: And(*x)) | st.lists(q, max_size=3).map(lambda x: Or(*x)),
    max_leaves=8,
)


def _negations_last(q):
    if isinstance(q, Not):
        return Not(_negations_last(q.query))
    if isinstance(q, (And, Or)):
        parts = [_negations_last(c) for c in q.queries]
        return type(q)(*(sorted(parts, key=lambda c: isinstance(c, Not)) if isinstance(q, And) else parts))
    return q


@settings(max_examples=200, deadline=None)
@given(queries)
def test_round_trips(q):
    assert str(unmarshal(marshal(q))) == str(_negations_last(q))
    assert from_json(to_json(q)) == q and str(from_json(to_json(q))) == str(q)


@pytest.mark.parametrize("text", ["[]", "{}", '{"x": 1}', '{"term": {"field": "a", "value": "b"}, "negation": {}}'])
def test_broken_json(text):
    with pytest.raises(ValueError):
        from_json(text)
