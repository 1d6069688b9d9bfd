"""From queries to DataFrame plans.

Four strategies give the same result:

``scan``
    One pass over the documents; the query becomes one boolean expression over their entries.
``flags``
    One pass over the postings that any leaf of the query can use, then one aggregation by document in which every leaf
    sets a flag (combined in the map tasks), then the query as an expression over the flags.  A query that documents
    without any of its terms satisfy (a negation) removes the others from all documents by one anti join.  Any depth and
    number of operands takes a single exchange.
``joins``
    Set algebra: semi joins for conjunctions, anti joins for negations, unions for disjunctions.

``lookup``
    For queries that few documents match: the keys are found as by ``flags``, at once, and written.  Where there are no
    more than ``LOOKUP_KEYS``, they are broadcast, and their bounds reach the scan of the documents, which are not moved.

Term look-ups are equality predicates on (field, term), by which the postings are sorted, and reach the Parquet scan, as
does the literal prefix of an anchored regular expression.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.durable import durable
from lexigrove.functions.matching import any_matches, by_automaton, matches
from lexigrove.model import ID_FIELD, KEY
from lexigrove.query import And, Not, Or, Query, Regexp, Term

STRATEGIES = ("auto", "scan", "flags", "joins", "lookup")
#: Keys of 16 bytes up to which a look-up broadcasts, and segments up to which it names them.
LOOKUP_KEYS, _LOOKUP_SEGMENTS = 1_000_000, 1_000


def leaf_predicate(leaf: Query, field: Column, term: Column) -> Column:
    """Whether a (field, term) satisfies a leaf; usable as a pushed filter."""
    if isinstance(leaf, Term):
        return (field == leaf.field) & (term == leaf.value)
    pattern = leaf.compiled
    found = (field == leaf.field) & matches(term, pattern)
    return found & term.startswith(pattern.prefix) if pattern.prefix else found


def _expression(query: Query, leaf: dict[Query, Column]) -> Column:
    if isinstance(query, Not):
        return ~_expression(query.query, leaf)
    if isinstance(query, (And, Or)):
        parts = [_expression(q, leaf) for q in query.queries]
        return reduce(lambda a, b: a & b if isinstance(query, And) else a | b, parts) if parts else F.lit(False)
    return leaf[query]


def _holds_without_terms(query: Query) -> bool:
    """Whether a document with none of the query's terms satisfies it."""
    if isinstance(query, Not):
        return not _holds_without_terms(query.query)
    if isinstance(query, And):
        return bool(query.queries) and all(map(_holds_without_terms, query.queries))
    return isinstance(query, Or) and any(map(_holds_without_terms, query.queries))


def scan_predicate(query: Query, fields: Column | str = "fields", id: Column | str = "id") -> Column:
    """The query as one expression over a document; true or false, never null."""
    fields, id = (F.col(c) if isinstance(c, str) else c for c in (fields, id))

    def of(leaf: Query) -> Column:
        if leaf.field == ID_FIELD:
            return F.coalesce(leaf_predicate(leaf, F.lit(ID_FIELD), id), F.lit(False))
        if isinstance(leaf, Regexp) and by_automaton(leaf.compiled):
            return any_matches(fields, leaf.field, leaf.compiled)
        found = F.exists(fields, lambda e: F.coalesce(leaf_predicate(leaf, e["name"], e["value"]), F.lit(False)))
        return F.coalesce(found, F.lit(False))

    return _expression(query, {leaf: of(leaf) for leaf in query.leaves()})


def _any(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates)


def _looked_up(leaves: list[Query], postings: DataFrame, docs: DataFrame, ids_posted: bool) -> DataFrame:
    """The postings that any of ``leaves`` can use.  Documents stand for the postings of their ids where those are missing."""
    of_id = [leaf for leaf in leaves if leaf.field == ID_FIELD and not ids_posted]
    others = [leaf for leaf in leaves if leaf.field != ID_FIELD or ids_posted]
    parts = []
    if others:
        # terms of one field become one IN list, which stays short and is pushed down as such
        terms: dict[str, list[str]] = {}
        predicates = []
        for leaf in others:
            if isinstance(leaf, Term):
                terms.setdefault(leaf.field, []).append(leaf.value)
            else:
                predicates.append(leaf_predicate(leaf, F.col("field"), F.col("term")))
        predicates += [(F.col("field") == f) & F.col("term").isin(values) for f, values in terms.items()]
        of_fields = postings.where(F.col("field").isin(sorted({leaf.field for leaf in others})))  # before any automaton
        parts.append(of_fields.where(_any(predicates)).select(*KEY, "field", "term"))
    if of_id:
        found = docs.where(_any([leaf_predicate(leaf, F.lit(ID_FIELD), F.col("id")) for leaf in of_id]))
        parts.append(found.select(*KEY, F.lit(ID_FIELD).alias("field"), F.col("id").alias("term")))
    return reduce(DataFrame.unionByName, parts)


def _flags(query: Query, docs: DataFrame, postings: DataFrame, ids_posted: bool) -> DataFrame:
    leaves = query.leaves()
    if not leaves:
        return docs.select(*KEY).where(_expression(query, {}))
    found = _looked_up(leaves, postings, docs, ids_posted)
    if len(leaves) == 1 and query.normal() == leaves[0]:
        return found.select(*KEY).distinct()
    flags = [F.max(F.coalesce(leaf_predicate(leaf, F.col("field"), F.col("term")), F.lit(False))).alias(f"f{i}") for i, leaf in enumerate(leaves)]
    flagged = found.groupBy(*KEY).agg(*flags)
    holds = _expression(query, {leaf: F.col(f"f{i}") for i, leaf in enumerate(leaves)})
    if not _holds_without_terms(query):
        return flagged.where(holds).select(*KEY)
    return docs.select(*KEY).join(flagged.where(~holds).select(*KEY), list(KEY), "left_anti")


def _joins(query: Query, docs: DataFrame, postings: DataFrame, ids_posted: bool) -> DataFrame:
    keys = list(KEY)
    if isinstance(query, (Term, Regexp)):
        return _looked_up([query], postings, docs, ids_posted).select(*KEY).distinct()
    if isinstance(query, Not):
        return docs.select(*KEY).join(_joins(query.query, docs, postings, ids_posted), keys, "left_anti")
    if not query.queries:
        return docs.select(*KEY).where(F.lit(False))
    if isinstance(query, Or):
        return reduce(DataFrame.union, [_joins(q, docs, postings, ids_posted) for q in query.queries]).distinct()
    positive = [_joins(q, docs, postings, ids_posted) for q in query.queries if not isinstance(q, Not)]
    negative = [_joins(q.query, docs, postings, ids_posted) for q in query.queries if isinstance(q, Not)]
    start = positive[0] if positive else docs.select(*KEY)
    start = reduce(lambda a, b: a.join(b, keys, "left_semi"), positive[1:], start)
    return reduce(lambda a, b: a.join(b, keys, "left_anti"), negative, start)


def _checked(query: Query, strategy: str) -> Query:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    return query.normal()


def matching_keys(query: Query, docs: DataFrame, postings: DataFrame | None, strategy: str = "auto", ids_posted: bool = False) -> DataFrame:
    """(segment_id, doc_ord) of the documents that match.

    Without postings documents are scanned, since postings made on the spot would cost a pass over them, an exchange and
    a join; with postings, ``auto`` is ``flags``.  ``ids_posted``: the postings hold those of the ids.
    """
    query = _checked(query, strategy)
    if postings is None or strategy == "scan":
        return docs.where(scan_predicate(query)).select(*KEY)
    return (_joins if strategy == "joins" else _flags)(query, docs, postings, ids_posted)


def matching_documents(query: Query, docs: DataFrame, postings: DataFrame | None, strategy: str = "auto", ids_posted: bool = False) -> DataFrame:
    """The whole documents that match, each once, with all columns of ``docs``."""
    query = _checked(query, strategy)
    if postings is None or strategy == "scan":
        return docs.where(scan_predicate(query))
    keys = matching_keys(query, docs, postings, strategy, ids_posted)
    return _fetched(docs, keys) if strategy == "lookup" else docs.join(keys, list(KEY), "left_semi")


def _fetched(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents of the keys, whose number is looked at first."""
    keys = durable(keys)
    n, low, high = keys.agg(F.count(F.lit(1)), F.min("doc_ord"), F.max("doc_ord")).first()
    if n > LOOKUP_KEYS:
        return docs.join(keys, list(KEY), "left_semi")
    near = docs.where(F.col("doc_ord").between(low, high) if n else F.lit(False))
    segments = [r[0] for r in keys.select("segment_id").distinct().limit(_LOOKUP_SEGMENTS + 1).collect()]
    if len(segments) <= _LOOKUP_SEGMENTS:
        near = near.where(F.col("segment_id").isin(segments))
    return near.join(F.broadcast(keys), list(KEY), "left_semi")
