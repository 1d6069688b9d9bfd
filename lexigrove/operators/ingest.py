"""From a batch of raw documents to validated, de-duplicated, numbered documents and their postings."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.durable import durable
from lexigrove.functions.document import DUPLICATE_ID, validation_error
from lexigrove.model import ID_FIELD, LexigroveError


NO_ID = "document has no id"


class BatchError(LexigroveError):
    """A batch was refused whole.  ``errors``: (idx, id, error) of the faulty documents, 100 at most."""

    def __init__(self, errors: list):
        self.errors = errors
        super().__init__("; ".join(f"document {e['idx']}: {e['error']}" for e in errors))


@dataclass(frozen=True)
class Prepared:
    """``accepted``: (idx, id, fields), ids given; ``rejects``: (idx, id, error)."""

    accepted: DataFrame
    rejects: DataFrame

    def without_duplicate_errors(self) -> DataFrame:
        """The rejects that are more than repeated ids."""
        return self.rejects.where(F.col("error") != DUPLICATE_ID)


def new_id() -> Column:
    """A random id: 128 random bits, 24 characters.  It differs each time it is evaluated; write it before use."""
    return F.base64(F.unhex(F.replace(F.uuid(), F.lit("-"), F.lit(""))))


#: Whether documents without an id get one, or how: a function from ``idx`` to the id.
MakeIds = bool | Callable[[Column], Column]


def ids_of_batch(seed: str | None = None) -> Callable[[Column], Column]:
    """Ids of 128 bits, 24 characters, from ``idx`` and a seed; random for each batch unless a seed is given."""
    seed = uuid.uuid4().hex if seed is None else seed
    return lambda idx: F.base64(F.unhex(F.md5(F.concat(F.lit(f"{seed}:"), idx.cast("string")))))


def prepare(batch: DataFrame, existing_ids: DataFrame | None = None, make_ids: MakeIds = True) -> Prepared:
    """Validate and de-duplicate ``batch`` (idx, id, fields), where ``idx`` numbers the documents.

    Ids, names and values may be BINARY or STRING; a null or empty id is none.  Faulty documents are rejected and do not
    reserve their id.  Documents whose id is in ``existing_ids`` (one column, id) are passed over silently.  Of several
    valid documents of one new id the first is accepted and the others are rejected.  Documents without an id get a
    random one (the same whenever the result is evaluated), the one that ``make_ids`` makes of their ``idx``, or are
    rejected if it is false.

    First occurrences are the least ``idx`` of each id, a hash aggregate of two narrow columns, so that a batch of copies
    of one id is no hot spot and documents are not moved to find it.  Nothing is written.
    """
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    fields = F.transform(F.col("fields"), lambda e: F.struct(text(e["name"]).alias("name"), text(e["value"]).alias("value")))
    error = validation_error("id", "fields")
    checked = batch.select(
        "idx",
        F.when(F.length(F.col("id")) > 0, F.col("id").cast("string")).alias("id"),
        F.coalesce(fields, F.array().cast("array<struct<name:string,value:string>>")).alias("fields"),
        error.alias("error"),
    )
    if make_ids is False:
        checked = checked.withColumn("error", F.coalesce("error", F.when(F.col("id").isNull(), NO_ID)))
    valid = checked.where("error IS NULL").drop("error")
    named, nameless = valid.where("id IS NOT NULL"), valid.where("id IS NULL")
    first = named.groupBy("id").agg(F.min("idx").alias("idx"))
    if existing_ids is not None:
        known = existing_ids.select("id").join(first.select("id"), "id", "left_semi").distinct()  # a few of the existing ones
        first = first.join(known, "id", "left_anti")
        named = named.join(known, "id", "left_anti")
    again = named.select("idx", "id").join(first.select("idx"), "idx", "left_anti")
    given = (ids_of_batch() if make_ids is True or make_ids is False else make_ids)(F.col("idx"))
    accepted = named.join(first.select("idx"), "idx", "left_semi").unionByName(nameless.withColumn("id", given)).select("idx", "id", "fields")
    rejects = checked.where("error IS NOT NULL").select("idx", "id", "error").unionByName(again.withColumn("error", F.lit(DUPLICATE_ID)))
    return Prepared(accepted, rejects)


def refuse_if_faulty(prepared: Prepared) -> None:
    """Raise BatchError if anything was rejected."""
    faulty = prepared.rejects.orderBy("idx").limit(100).collect()
    if faulty:
        raise BatchError([r.asDict() for r in faulty])


def numbered(df: DataFrame, order: list[str], start: int = 0, name: str = "doc_ord") -> DataFrame:
    """``df`` with consecutive numbers from ``start`` in ``order``, which must identify rows.

    Range partitions are sorted and written once; their sizes alone, one number each, come to the driver.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    part, within = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    written = durable(ranged.select("*", part.alias("__part"), within.alias("__within")))
    sizes = dict(written.groupBy("__part").count().collect())
    offsets, at = [], start
    for p in sorted(sizes):
        offsets.append((p, at))
        at += sizes[p]
    table = df.sparkSession.createDataFrame(offsets, "__part INT, __offset BIGINT")
    joined = written.join(F.broadcast(table), "__part")  # one row for each partition
    return joined.select(*[c for c in df.columns if c != name], (F.col("__offset") + F.col("__within")).alias(name))


def to_postings(docs: DataFrame, with_ids: bool = True) -> DataFrame:
    """(segment_id, field, term, doc_ord, id): one row for each distinct (name, value) of a document, and for its id.

    Entries with a null name or value have no posting; empty ones do.
    """
    entries = F.array_distinct(F.filter("fields", lambda e: e["name"].isNotNull() & e["value"].isNotNull()))
    exploded = docs.select("segment_id", "doc_ord", "id", F.explode(entries).alias("e"))
    found = exploded.select("segment_id", F.col("e.name").alias("field"), F.col("e.value").alias("term"), "doc_ord", "id")
    if not with_ids:
        return found
    ids = docs.where("id IS NOT NULL").select("segment_id", F.lit(ID_FIELD).alias("field"), F.col("id").alias("term"), "doc_ord", "id")
    return found.unionByName(ids)
