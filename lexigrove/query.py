"""The query language: exact terms, regular expressions, and their boolean combinations.

Queries are immutable values.  Building one validates it; equality compares normal forms (nested operators of the same
kind flattened, single operands unwrapped) and is sensitive to the order of operands.  An And or an Or without operands
matches nothing, wherever it stands.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import ClassVar

from lexigrove.regex import Pattern, translate


class Query:
    """Base of all queries."""

    def normal(self) -> Query:
        """The normal form, by which queries are compared."""
        return self

    def leaves(self) -> list[Query]:
        """The distinct terms and regular expressions, in order of appearance."""
        return [self]

    def _key(self) -> tuple:
        raise NotImplementedError

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Query) and self.normal()._key() == other.normal()._key()

    def __hash__(self) -> int:
        return hash(self.normal()._key())

    def __and__(self, other: Query) -> And:
        return And(self, other)

    def __or__(self, other: Query) -> Or:
        return Or(self, other)

    def __invert__(self) -> Not:
        return Not(self)


@dataclass(frozen=True, eq=False)
class Term(Query):
    """Documents with ``value`` among the values of ``field``, byte for byte."""

    field: str
    value: str

    def _key(self) -> tuple:
        return ("term", self.field, self.value)

    def __str__(self) -> str:
        return f"term({self.field}, {self.value})"


@dataclass(frozen=True, eq=False)
class Regexp(Query):
    """Documents with a value of ``field`` that matches ``pattern``, an expression in RE2 syntax.

    The match may lie anywhere in the value, unless ``anchored``, when it must cover the value.  A pattern that RE2 would
    refuse raises ValueError here, not when the query runs.
    """

    field: str
    pattern: str
    anchored: bool = False

    def __post_init__(self) -> None:
        translate(self.pattern)

    @property
    def compiled(self) -> Pattern:
        return translate(self.pattern, self.anchored)

    def _key(self) -> tuple:
        return ("regexp", self.field, self.pattern, self.anchored)

    def __str__(self) -> str:
        return f"regexp({self.field}, {self.pattern})"


@dataclass(frozen=True, eq=False)
class Not(Query):
    """Documents that ``query`` does not match, those without the field included."""

    query: Query

    def __post_init__(self) -> None:
        if not isinstance(self.query, Query):
            raise TypeError("a negation needs a query")

    def normal(self) -> Query:
        return Not(self.query.normal())

    def leaves(self) -> list[Query]:
        return self.query.leaves()

    def _key(self) -> tuple:
        return ("negation", self.query._key())

    def __str__(self) -> str:
        return f"negation({self.query})"


class _Many(Query):
    kind: ClassVar[str]

    def __init__(self, *queries: Query):
        if not all(isinstance(q, Query) for q in queries):
            raise TypeError(f"a {self.kind} needs queries")
        self.queries = tuple(queries)

    def normal(self) -> Query:
        flat: list[Query] = []
        for q in (q.normal() for q in self.queries):
            flat.extend(q.queries if type(q) is type(self) and q.queries else (q,))
        return flat[0] if len(flat) == 1 else type(self)(*flat)

    def leaves(self) -> list[Query]:
        return list(dict.fromkeys(leaf for q in self.queries for leaf in q.leaves()))

    def _key(self) -> tuple:
        return (self.kind, *(q._key() for q in self.queries))

    def __str__(self) -> str:
        return f"{self.kind}({', '.join(map(str, self.queries))})"

    def __repr__(self) -> str:
        return f"{type(self).__name__}{self.queries!r}"


class And(_Many):
    """Documents that all of ``queries`` match."""

    kind = "conjunction"


class Or(_Many):
    """Documents that any of ``queries`` matches."""

    kind = "disjunction"
