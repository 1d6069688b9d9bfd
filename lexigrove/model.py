"""The data model: documents, postings, and how a snapshot of a collection is held in two DataFrames."""

from __future__ import annotations

from pyspark.sql import types as T

#: The field under which a document's id is indexed.  Documents must not use it.
ID_FIELD = "_lexigrove_id"

FIELDS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))
DOCS = T.StructType(
    [
        T.StructField("segment_id", T.LongType()),
        T.StructField("doc_ord", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("fields", FIELDS),
    ]
)
POSTINGS = T.StructType(
    [
        T.StructField("segment_id", T.LongType()),
        T.StructField("field", T.StringType()),
        T.StructField("term", T.StringType()),
        T.StructField("doc_ord", T.LongType()),
        T.StructField("id", T.StringType()),
    ]
)
#: What identifies a document: ids may recur in other segments.
KEY = ("segment_id", "doc_ord")


class LexigroveError(Exception):
    """Base of all errors of this library."""


class ClosedError(LexigroveError):
    """An operation on something that was closed."""


class SealedError(LexigroveError):
    """An insert into a sealed segment, or sealing one twice."""


class DocumentNotFound(LexigroveError):
    """No document has the ordinal asked for."""


class EmptyPostings(LexigroveError):
    """The least or greatest ordinal of an empty set."""
