"""Writable segments."""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.durable import durable
from lexigrove.functions.document import validation_error
from lexigrove.model import DOCS, ClosedError, SealedError
from lexigrove.operators.ingest import NO_ID, BatchError, MakeIds, Prepared, numbered, prepare, refuse_if_faulty
from lexigrove.sources.snapshot import Snapshot, merged

_BATCH = "idx BIGINT, id STRING, fields ARRAY<STRUCT<name: STRING, value: STRING>>"
#: Single documents that the driver holds before they are written together.
_HELD = 1000


class Segment:
    """A segment that takes documents until it is sealed.

    The first document of an id stays; there is no update and no delete.  What a batch adds becomes visible at once and
    to later snapshots only.  One writer at a time.  ``make_ids``: whether documents without an id get one, or how, as a
    function from ``idx`` to the id.  Searches scan the documents; segments on disk have postings.
    """

    def __init__(self, spark: SparkSession, segment_id: int = 0, make_ids: MakeIds = True):
        self.spark, self.segment_id, self._make_ids = spark, segment_id, make_ids
        self._written = spark.createDataFrame([], DOCS)
        self._held: list[tuple] = []  # single documents, not written yet
        self._held_ids: set[str] = set()
        self._next = 0
        self._sealed = self._closed = False

    def _writable(self) -> None:
        self._open()
        if self._sealed:
            raise SealedError("the segment is sealed")

    def _open(self) -> None:
        if self._closed:
            raise ClosedError("the segment is closed")

    def insert_batch(self, batch: DataFrame, partial: bool = False) -> Prepared:
        """Add the documents of ``batch`` (idx, id, fields).

        If any document is faulty, BatchError is raised and nothing added; with ``partial``, the faulty ones are left out
        and returned as ``rejects``.
        """
        self._writable()
        prepared = prepare(batch, self._docs, self._make_ids)
        if not partial:
            refuse_if_faulty(prepared)
        fresh = numbered(prepared.accepted, ["idx"], self._next)
        fresh = fresh.select(F.lit(self.segment_id).cast("long").alias("segment_id"), "doc_ord", "id", "fields")
        self._written = self._written.unionByName(fresh)  # of parts that are written already
        self._next += fresh.count()
        return prepared

    def insert(self, fields: Iterable[tuple[str, str]], id: str | None = None) -> str:
        """Add one document and return its id; a document of that id that is already here stays as it is."""
        self._writable()
        text = lambda x: "" if x is None else x
        entries = [(text(name), text(value)) for name, value in fields]
        batch = self.spark.createDataFrame([(self._next, id or None, entries)], _BATCH)
        made = self._make_ids(F.col("idx")) if callable(self._make_ids) else F.lit(base64.b64encode(uuid.uuid4().bytes).decode())
        error, made = batch.select(validation_error("id", "fields"), made).first()
        if error is None and not id and self._make_ids is False:
            error = NO_ID
        if error is not None:
            raise BatchError([{"idx": 0, "id": id, "error": error}])
        if id and (id in self._held_ids or not self._written.where(F.col("id") == id).isEmpty()):
            return id
        self._held.append((self.segment_id, self._next, id or made, entries))
        self._held_ids.add(id or made)
        self._next += 1
        if len(self._held) >= _HELD:
            self._written, self._held, self._held_ids = durable(self._docs), [], set()
        return id or made

    @property
    def _docs(self) -> DataFrame:
        return self._written.unionByName(self.spark.createDataFrame(self._held, DOCS)) if self._held else self._written

    def merge(self, *sources: Segment | Snapshot) -> None:
        """Add all documents of ``sources``, in order; of one id the first stays, those here before all."""
        self._writable()
        snapshots = [s.snapshot() if isinstance(s, Segment) else s for s in sources]
        docs = merged([self._docs, *(s.docs for s in snapshots)], self.segment_id)
        self._written, self._held, self._held_ids = durable(docs), [], set()
        self._next = self._written.count()

    def snapshot(self) -> Snapshot:
        """What the segment holds now; later inserts do not show."""
        self._open()
        return Snapshot(self._docs, bound=self._next)

    def size(self) -> int:
        return 0 if self._closed else self._next

    def contains_id(self, id: str) -> bool:
        return self.snapshot().contains_id(id)

    def fields(self) -> DataFrame:
        return self.snapshot().fields()

    def terms(self, field: str) -> DataFrame:
        return self.snapshot().terms(field)

    @property
    def sealed(self) -> bool:
        return self._sealed

    def seal(self) -> None:
        """No more inserts from now on.  Sealing twice is an error."""
        self._writable()
        self._sealed = True

    def close(self) -> None:
        self._open()
        self._closed = True

    def __enter__(self) -> Segment:
        return self

    def __exit__(self, *_: object) -> None:
        if not self._closed:
            self.close()


__all__ = ["BatchError", "Segment"]
