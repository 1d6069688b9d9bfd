"""Point-in-time views of a collection."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from lexigrove.functions.document import canonical
from lexigrove.model import ID_FIELD, KEY, ClosedError, DocumentNotFound
from lexigrove.operators.ingest import numbered, to_postings
from lexigrove.plans.compile import matching_documents, matching_keys
from lexigrove.query import Query


class Snapshot:
    """Documents (segment_id, doc_ord, id, fields) and their postings, fixed at the time of opening.

    ``postings`` may be left out; searches then scan the documents.  ``bound`` limits both to ordinals below it, so that
    counts and results agree whatever is appended later.  Results are DataFrames in no order; sort by (segment_id,
    doc_ord) where order matters.  The same id in two segments is two documents.  ``ids_posted``: the postings hold those
    of the ids, so that ids are looked up there and not in the documents.
    """

    def __init__(self, docs: DataFrame, postings: DataFrame | None = None, bound: int | Column | None = None, ids_posted: bool = False):
        if bound is not None:
            docs = docs.where(F.col("doc_ord") < bound)
            postings = None if postings is None else postings.where(F.col("doc_ord") < bound)
        self._docs, self._postings, self._closed = docs, postings, False
        self._ids_posted = ids_posted and postings is not None

    @classmethod
    def of(cls, snapshots: Iterable[Snapshot]) -> Snapshot:
        """Several snapshots as one; results follow one another without removal of repeated ids."""
        snapshots = list(snapshots)
        docs = reduce(DataFrame.unionByName, [s.docs for s in snapshots])
        if all(s._postings is None for s in snapshots):
            return cls(docs)
        ids_posted = all(s._ids_posted or s._postings is None for s in snapshots)
        return cls(docs, reduce(DataFrame.unionByName, [s.postings for s in snapshots]), ids_posted=ids_posted)

    def _open(self) -> None:
        if self._closed:
            raise ClosedError("the snapshot is closed")

    @property
    def docs(self) -> DataFrame:
        self._open()
        return self._docs

    @property
    def postings(self) -> DataFrame:
        self._open()
        return to_postings(self._docs) if self._postings is None else self._postings

    def search(self, query: Query, strategy: str = "auto") -> DataFrame:
        """The whole documents that ``query`` matches."""
        self._open()
        return matching_documents(query, self._docs, self._postings, strategy, self._ids_posted)

    def match(self, query: Query, strategy: str = "auto") -> DataFrame:
        """(segment_id, doc_ord) of the documents that ``query`` matches."""
        self._open()
        return matching_keys(query, self._docs, self._postings, strategy, self._ids_posted)

    def all_docs(self) -> DataFrame:
        return self.docs

    def match_all(self) -> DataFrame:
        return self.docs.select(*KEY)

    def fetch(self, keys: DataFrame) -> DataFrame:
        """The documents of the given (segment_id, doc_ord); keys outside the snapshot have none."""
        return self.docs.join(keys.select(*KEY), list(KEY), "left_semi")

    def doc(self, segment_id: int, doc_ord: int) -> Row:
        found = self.docs.where((F.col("segment_id") == segment_id) & (F.col("doc_ord") == doc_ord)).take(1)
        if not found:
            raise DocumentNotFound(f"segment {segment_id} has no document {doc_ord}")
        return found[0]

    def fields(self) -> DataFrame:
        """(field): the distinct field names, the reserved one of ids included if any document has an id."""
        names = self.postings.select("field").where(F.col("field") != ID_FIELD).distinct()
        ids = self.docs.where("id IS NOT NULL").limit(1).select(F.lit(ID_FIELD).alias("field"))
        return names.unionByName(ids)

    def terms(self, field: str) -> DataFrame:
        """(term): the distinct values of ``field``; none for an unknown field."""
        if field == ID_FIELD and not self._ids_posted:
            return self.docs.where("id IS NOT NULL").select(F.col("id").alias("term")).distinct()
        return self.postings.where(F.col("field") == field).select("term").distinct()

    def contains_id(self, id: str) -> bool:
        if self._ids_posted:
            return self.contains_term(ID_FIELD, id)
        return not self.docs.where(F.col("id") == id).isEmpty()

    def contains_field(self, field: str) -> bool:
        return not self.postings.where(F.col("field") == field).isEmpty()

    def contains_term(self, field: str, term: str) -> bool:
        return not self.postings.where((F.col("field") == field) & (F.col("term") == term)).isEmpty()

    def known_ids(self) -> DataFrame:
        """(id): the ids of the documents, as often as they occur, without their fields."""
        if self._ids_posted:
            return self.postings.where(F.col("field") == ID_FIELD).select(F.col("term").alias("id"))
        return self.docs.where("id IS NOT NULL").select("id")

    def size(self) -> int:
        return 0 if self._closed else self._docs.count()

    def document_frequency(self) -> DataFrame:
        """(field, term, n): in how many documents each term occurs."""
        keyed = self.postings.groupBy("field", "term", *KEY).agg(F.lit(1).alias("one"))
        return keyed.groupBy("field", "term").agg(F.count(F.lit(1)).alias("n"))

    def equal_documents(self) -> DataFrame:
        """(document, n): the distinct documents in canonical form with how often each occurs."""
        return self.docs.groupBy(canonical("id", "fields").alias("document")).agg(F.count(F.lit(1)).alias("n"))

    def close(self) -> None:
        """Closing twice is an error, as is any use afterwards."""
        self._open()
        self._closed = True

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *_: object) -> None:
        if not self._closed:
            self.close()


def merged(sources: list[DataFrame], segment_id: int = 0) -> DataFrame:
    """The documents of ``sources`` in one segment, newly numbered: source by source, each in order.

    Of the documents of one id the first stays; documents without an id all stay.  Ordinals are taken to be unique
    within a source.
    """
    tagged = None
    for k, docs in enumerate(sources):
        part = docs.select(F.lit(k).alias("__src"), F.col("segment_id").cast("long").alias("__seg"), F.col("doc_ord").alias("__ord"), "id", "fields")
        tagged = part if tagged is None else tagged.unionByName(part)
    place = ["__src", "__seg", "__ord"]
    named, nameless = tagged.where(F.length("id") > 0), tagged.where(~F.coalesce(F.length("id") > 0, F.lit(False)))
    # ids and places alone find the first of each id; documents are moved once, to be numbered
    first = named.groupBy("id").agg(F.min(F.struct(*place)).alias("p")).select(*[f"p.{c}" for c in place])
    kept = named.join(first, place, "left_semi").unionByName(nameless)
    ordered = numbered(kept, place)
    return ordered.select(F.lit(segment_id).cast("long").alias("segment_id"), "doc_ord", "id", "fields")
