"""Queries as bytes (the public proto3 wire format) and as JSON.

Messages and field numbers::

    Term {bytes field = 1; bytes term = 2}     Regexp {bytes field = 1; bytes regexp = 2}
    Negation {Query query = 1}                 Conjunction, Disjunction {repeated Query queries = 1}
    Query {oneof: term = 1, regexp = 2, negation = 3, conjunction = 4, disjunction = 5}

Within a conjunction, negations are written after the other operands.  Whether a regular expression must cover the
value is a property of the reader of these bytes and is not written; JSON keeps it.
"""

from __future__ import annotations

import json

from lexigrove.query import And, Not, Or, Query, Regexp, Term

_NUMBER = {Term: 1, Regexp: 2, Not: 3, And: 4, Or: 5}
_LENGTH_DELIMITED = 2


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _chunk(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | _LENGTH_DELIMITED) + _varint(len(body)) + body


def _strings(*values: str) -> bytes:
    return b"".join(_chunk(k, v.encode()) for k, v in enumerate(values, 1) if v)


def marshal(query: Query) -> bytes:
    """The bytes of a query; anything else raises ValueError."""
    if isinstance(query, Term):
        body = _strings(query.field, query.value)
    elif isinstance(query, Regexp):
        body = _strings(query.field, query.pattern)
    elif isinstance(query, Not):
        body = _chunk(1, marshal(query.query))
    elif isinstance(query, And):
        body = b"".join(_chunk(1, marshal(q)) for q in sorted(query.queries, key=lambda q: isinstance(q, Not)))
    elif isinstance(query, Or):
        body = b"".join(_chunk(1, marshal(q)) for q in query.queries)
    else:
        raise ValueError("no query to write")
    return _chunk(_NUMBER[type(query)], body)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("truncated or oversized number")
        value |= (data[at] & 0x7F) << shift
        shift += 7
        at += 1
        if not data[at - 1] & 0x80:
            return value, at


def _chunks(data: bytes) -> list[tuple[int, bytes]]:
    """The length-delimited fields of a message; fields of other kinds are passed over."""
    found, at = [], 0
    while at < len(data):
        tag, at = _read_varint(data, at)
        number, kind = tag >> 3, tag & 7
        if kind == _LENGTH_DELIMITED:
            size, at = _read_varint(data, at)
            if at + size > len(data):
                raise ValueError("truncated message")
            found.append((number, data[at : at + size]))
            at += size
        elif kind == 0:
            _, at = _read_varint(data, at)
        elif kind in (1, 5):
            at += 8 if kind == 1 else 4
        else:
            raise ValueError(f"unknown wire type {kind}")
    return found


def unmarshal(data: bytes) -> Query:
    """The query that ``data`` holds; ValueError where there is none or a part is missing."""
    known = [(n, body) for n, body in _chunks(data) if n in _NUMBER.values()]
    if not known:
        raise ValueError("no known kind of query")
    number, body = known[-1]  # of a oneof the last one counts
    if number in (1, 2):
        parts = dict(_chunks(body))
        try:
            field, value = (parts.get(k, b"").decode() for k in (1, 2))
        except UnicodeDecodeError as e:
            raise ValueError("fields, terms and expressions must be valid UTF-8") from e
        return Term(field, value) if number == 1 else Regexp(field, value)
    children = [unmarshal(child) for n, child in _chunks(body) if n == 1]
    if number == 3:
        if len(children) != 1:
            raise ValueError("a negation needs one query")
        return Not(children[0])
    return And(*children) if number == 4 else Or(*children)


def to_json(query: Query) -> str:
    def plain(q: Query) -> dict:
        if isinstance(q, Term):
            return {"term": {"field": q.field, "value": q.value}}
        if isinstance(q, Regexp):
            return {"regexp": {"field": q.field, "pattern": q.pattern, "anchored": q.anchored}}
        if isinstance(q, Not):
            return {"negation": plain(q.query)}
        if isinstance(q, (And, Or)):
            return {q.kind: [plain(c) for c in q.queries]}
        raise ValueError("no query to write")

    return json.dumps(plain(query), ensure_ascii=False)


def from_json(text: str) -> Query:
    def build(x: object) -> Query:
        if not isinstance(x, dict) or len(x) != 1:
            raise ValueError("a query is an object with one member")
        ((kind, body),) = x.items()
        if kind == "term":
            return Term(body["field"], body["value"])
        if kind == "regexp":
            return Regexp(body["field"], body["pattern"], body.get("anchored", False))
        if kind == "negation":
            return Not(build(body))
        if kind in ("conjunction", "disjunction"):
            return (And if kind == "conjunction" else Or)(*map(build, body))
        raise ValueError(f"unknown kind of query: {kind}")

    return build(json.loads(text))
