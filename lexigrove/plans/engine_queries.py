"""Driver queries of the engine's eager and stateful parts: look-ups, codecs, set tests, ids, segments, store, streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.codec import from_json, marshal, to_json, unmarshal
from lexigrove.durable import scratch
from lexigrove.functions import document
from lexigrove.model import ClosedError, EmptyPostings, LexigroveError, SealedError
from lexigrove.operators import postings as sets
from lexigrove.operators.ingest import ids_of_batch, prepare
from lexigrove.plans.queries import _FIRST, _MIXED, _NO_FIELDS, _NO_ID, _W_MIXED, _W_RELAY, _p, _postings_of, _RELAY, corpus
from lexigrove.query import And, Not, Or, Regexp, Term
from lexigrove.sources import store
from lexigrove.sources.loaders import read_json_lines
from lexigrove.sources.segment import Segment
from lexigrove.streaming.ingest import ingest
from lexigrove.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def _refused(error: type[Exception], f: Callable[[], object]) -> bool:
    try:
        f()
    except error:
        return True
    return False


# Look-ups and dictionary


@_query("SELECT seq, id FROM docs WHERE segment_id = 0 AND doc_ord = 3")
def point_lookup(spark: SparkSession, folder: str) -> DataFrame:
    row = corpus(spark, folder).doc(0, 3)
    return spark.createDataFrame([(row["seq"], row["id"])], "seq BIGINT, id STRING")


_HAS = "EXISTS (SELECT 1 FROM postings WHERE {})"


@_query(
    f"""SELECT EXISTS (SELECT 1 FROM docs WHERE id = (SELECT max(id) FROM docs)) AS known_id, false AS unknown_id, {_HAS.format("field = 'tier'")} AS known_field, false AS unknown_field,
    {_HAS.format("field = 'tier' AND term = 'live'")} AS known_term, {_HAS.format("field = 'tier' AND term = 'relay-alpha'")} AS unknown_term"""
)
def contains(spark: SparkSession, folder: str) -> DataFrame:
    s = corpus(spark, folder)
    some = s.docs.agg(F.max("id")).first()[0]
    row = (s.contains_id(some), s.contains_id("no such id"), s.contains_field("tier"), s.contains_field("no such field"), s.contains_term("tier", "live"), s.contains_term("tier", "relay-alpha"))
    return spark.createDataFrame([row], "known_id BOOLEAN, unknown_id BOOLEAN, known_field BOOLEAN, unknown_field BOOLEAN, known_term BOOLEAN, unknown_term BOOLEAN")


# Query values


@_query(f"SELECT seq FROM docs WHERE {_W_MIXED.replace(chr(92) + 'd', '[0-9]')}")
def search_unmarshalled(spark: SparkSession, folder: str) -> DataFrame:
    """A search by a query that went through its binary form."""
    return corpus(spark, folder).search(unmarshal(marshal(_MIXED))).select("seq")


@_query(f"SELECT seq FROM docs WHERE {_W_MIXED.replace(chr(92) + 'd', '[0-9]')}")
def search_from_json(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).search(from_json(to_json(_MIXED))).select("seq")


@_query(
    """SELECT * FROM (VALUES ('single conjunction', true), ('single disjunction', true), ('nested conjunction', true), ('other order', false),
    ('other negation', false), ('empty conjunctions', true), ('empty kinds', false), ('other term', false), ('other expression', false)) AS t(name, same)"""
)
def query_equality(spark: SparkSession, folder: str) -> DataFrame:
    a, b = Term("fruit", "apple"), Term("fruit", "banana")
    rows = [
        ("single conjunction", And(a) == a), ("single disjunction", Or(a) == a), ("nested conjunction", And(And(a, b), a) == And(a, b, a)), ("other order", And(a, b) == And(b, a)),
        ("other negation", Not(a) == Not(b)), ("empty conjunctions", And() == And()), ("empty kinds", And() == Or()), ("other term", a == b), ("other expression", Regexp("f", "a") == Regexp("f", "b")),
    ]
    return spark.createDataFrame(rows, "name STRING, same BOOLEAN")


@_query(
    "SELECT 'conjunction(term(tier, live), negation(disjunction(regexp(owner, ^delta-), term(job, relay-alpha))))' AS shown, "
    "'{id: ' || id || '}' AS id_shown FROM (SELECT min(id) AS id FROM docs WHERE id <> '')"
)
def query_text(spark: SparkSession, folder: str) -> DataFrame:
    shown = str(And(Term("tier", "live"), Not(Or(Regexp("owner", "^delta-"), _RELAY))))
    return table(spark, folder, "docs").where("id <> ''").agg(F.min("id").alias("id")).select(F.lit(shown).alias("shown"), F.concat(F.lit("{id: "), "id", F.lit("}")).alias("id_shown"))


@_query("SELECT seq FROM (SELECT seq, row_number() OVER (ORDER BY coalesce(id, ''), list_sort(list_transform(coalesce(fields, []), lambda e: (e.name, e.value))), seq) AS k FROM docs WHERE len(fields) > 0 AND id > 'm') WHERE k <= 20")
def document_order(spark: SparkSession, folder: str) -> DataFrame:
    """The first twenty of the documents with fields and an id after 'm', in document order (a top-k report)."""
    docs = table(spark, folder, "docs").where("size(fields) > 0 AND id > 'm'")
    return docs.orderBy(document.canonical("id", "fields"), "seq").limit(20).select("seq")


# Sets of ordinals


def _shard(spark: SparkSession, folder: str) -> DataFrame:
    return _postings_of(spark, folder, "shard", "50").select("doc_ord")


@_query(f"SELECT doc_ord FROM ({_p('shard', '50')}) UNION SELECT 1000000007")
def postings_insert(spark: SparkSession, folder: str) -> DataFrame:
    return sets.insert(_shard(spark, folder), 1_000_000_007)


@_query(f"SELECT true AS has_least, false AS has_other, count(*) = 0 AS is_empty, true AS cleared_is_empty, true AS empty_has_no_bounds FROM ({_p('unit', 'seconds')})")
def postings_tests(spark: SparkSession, folder: str) -> DataFrame:
    p = _postings_of(spark, folder, "unit", "seconds").select("doc_ord")
    low, _ = sets.bounds(p)
    none = sets.cleared(p)
    row = (sets.contains(p, low), sets.contains(p, -1), sets.is_empty(p), sets.is_empty(none), _refused(EmptyPostings, lambda: sets.bounds(none)))
    return spark.createDataFrame([row], "has_least BOOLEAN, has_other BOOLEAN, is_empty BOOLEAN, cleared_is_empty BOOLEAN, empty_has_no_bounds BOOLEAN")


@_query(f"SELECT row_number() OVER (ORDER BY doc_ord) - 1 AS place, doc_ord FROM (SELECT DISTINCT doc_ord FROM ({_p('shard', '50')}))")
def postings_ascending(spark: SparkSession, folder: str) -> DataFrame:
    """The members as the iterator gives them."""
    return spark.createDataFrame(list(enumerate(sets.ascending(_shard(spark, folder)))), "place BIGINT, doc_ord BIGINT")


@_query("SELECT true AS same, false AS with_one_more, false AS with_other")
def postings_equal(spark: SparkSession, folder: str) -> DataFrame:
    p, q = _shard(spark, folder), _postings_of(spark, folder, "unit", "seconds").select("doc_ord")
    row = (sets.equal(p, p.unionByName(p)), sets.equal(p, sets.insert(p, 1_000_000_007)), sets.equal(p, q))
    return spark.createDataFrame([row], "same BOOLEAN, with_one_more BOOLEAN, with_other BOOLEAN")


# Ingest


def _batch(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "docs").select(F.col("seq").alias("idx"), "id", "fields")


_ACCEPTED = f"(SELECT seq, id, fields FROM {_FIRST} WHERE seq = first UNION ALL SELECT seq, id, fields FROM docs WHERE {_NO_ID} AND NOT {_NO_FIELDS})"
_NUMBERED = f"SELECT row_number() OVER (ORDER BY seq) - 1 AS doc_ord, coalesce(len(fields), 0) AS n_fields FROM {_ACCEPTED}"


def _n_fields(docs: DataFrame) -> DataFrame:
    return docs.select("doc_ord", F.size(F.coalesce("fields", F.array())).cast("long").alias("n_fields"))


@_query(_NUMBERED)
def ingest_partial(spark: SparkSession, folder: str) -> DataFrame:
    """A batch with faulty documents, of which the others are taken."""
    segment = Segment(spark)
    segment.insert_batch(_batch(spark, folder), partial=True)
    return _n_fields(segment.snapshot().docs)


@_query(f"SELECT seq FROM docs WHERE {_NO_ID} AND {_NO_FIELDS}")
def ingest_errors_but_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return prepare(_batch(spark, folder)).without_duplicate_errors().select(F.col("idx").alias("seq"))


@_query(f"SELECT count(*) AS n, count(*) AS n_distinct, 24 AS n_chars FROM docs WHERE {_NO_ID} AND NOT {_NO_FIELDS}")
def ingest_made_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids that documents without one were given at random."""
    without = table(spark, folder, "docs").where("id IS NULL OR id = ''").select(F.col("seq").alias("idx"))
    made = prepare(_batch(spark, folder)).accepted.join(without, "idx", "left_semi")
    return made.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_distinct"), F.max(F.length("id")).cast("long").alias("n_chars"))


@_query(f"SELECT seq, CASE WHEN {_NO_ID} THEN to_base64(unhex(md5('seed:' || seq))) ELSE id END AS id FROM {_ACCEPTED}")
def ingest_ids_of_a_function(spark: SparkSession, folder: str) -> DataFrame:
    """Ids by a given function, so that they can be made again."""
    return prepare(_batch(spark, folder), make_ids=ids_of_batch("seed")).accepted.select(F.col("idx").alias("seq"), "id")


@_query(f"SELECT seq FROM docs WHERE NOT {_NO_ID} AND id NOT IN (SELECT id FROM docs WHERE segment_id % 2 = 0 AND id IS NOT NULL) AND seq IN (SELECT first FROM (SELECT min(seq) AS first FROM docs WHERE segment_id % 2 = 1 AND id <> '' GROUP BY id)) AND segment_id % 2 = 1")
def ingest_known_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of one half whose ids the other half does not hold, the first of each."""
    docs = table(spark, folder, "docs")
    batch = docs.where("segment_id % 2 = 1 AND id <> ''").select(F.col("seq").alias("idx"), "id", "fields")
    return prepare(batch, docs.where("segment_id % 2 = 0").select("id")).accepted.select(F.col("idx").alias("seq"))


@_query("SELECT 'event_type' AS name, event_type AS value, count(*) AS n FROM events WHERE event_type <> '' GROUP BY event_type")
def json_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Events written as JSON lines and loaded as documents."""
    path = scratch(spark, "lines")
    events = table(spark, folder, "events")
    events.select(F.to_json(F.struct("event_type", F.col("user_id").cast("string").alias("user_id"), "props"))).write.text(path)
    entries = read_json_lines(spark, path).select(F.explode("fields").alias("e")).where("e.name = 'event_type'")
    return entries.groupBy("e.name", "e.value").agg(F.count(F.lit(1)).alias("n"))


# Segments


@_query("SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS doc_ord, r_regionkey::VARCHAR AS id, r_name AS name FROM region")
def insert_one_by_one(spark: SparkSession, folder: str) -> DataFrame:
    """Regions, a fixed table of a few rows, inserted one at a time and once more."""
    with Segment(spark) as segment:
        for row in table(spark, folder, "region").orderBy("r_regionkey").collect() * 2:
            segment.insert([("name", row["r_name"])], id=str(row["r_regionkey"]))
        return segment.snapshot().docs.select("doc_ord", "id", document.first_value("fields", "name").alias("name"))


@_query("SELECT true AS sealed, true AS insert_refused, true AS seal_refused, true AS still_read, true AS use_refused, true AS close_refused, 0 AS size_when_closed")
def sealed_and_closed(spark: SparkSession, folder: str) -> DataFrame:
    segment = Segment(spark)
    segment.insert_batch(table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("idx"), F.col("n_name").alias("id"), F.array().cast("array<struct<name:string,value:string>>").alias("fields")))
    segment.seal()
    row = [segment.sealed, _refused(SealedError, lambda: segment.insert([("a", "b")])), _refused(SealedError, segment.seal), segment.contains_id(table(spark, folder, "nation").first()["n_name"])]
    segment.close()
    row += [_refused(ClosedError, segment.snapshot), _refused(ClosedError, segment.close), segment.size()]
    return spark.createDataFrame([tuple(row)], "sealed BOOLEAN, insert_refused BOOLEAN, seal_refused BOOLEAN, still_read BOOLEAN, use_refused BOOLEAN, close_refused BOOLEAN, size_when_closed BIGINT")


# Store


def _two_segments(spark: SparkSession, folder: str, fmt: str = store.FORMAT) -> str:
    root = scratch(spark, "store")
    docs = table(spark, folder, "docs").select("segment_id", F.col("seq").alias("doc_ord"), "id", "fields")
    for k in (0, 1):
        store.save(docs.where(F.col("segment_id") % 2 == k), root, k, fmt=fmt)
    return root


@_query(
    "SELECT s.id AS segment_id, 1 AS major, 'parquet' AS format, (SELECT count(*) FROM docs WHERE segment_id % 2 = s.id) AS num_docs "
    "FROM (SELECT unnest([0, 1])::BIGINT AS id) s"
)
def store_metadata(spark: SparkSession, folder: str) -> DataFrame:
    root = _two_segments(spark, folder)
    if not _refused(store.StoreError, lambda: store.metadata(spark, root, 2)):
        raise LexigroveError("there is no segment 2")
    return store.all_metadata(spark, root).select("segment_id", "major", "format", "num_docs")


@_query(f"SELECT seq FROM docs WHERE {_W_RELAY}")
def store_other_format(spark: SparkSession, folder: str) -> DataFrame:
    """Segments whose tables are kept in another file format."""
    return store.load(spark, _two_segments(spark, folder, "orc")).search(_RELAY).select(F.col("doc_ord").alias("seq"))


@_query("SELECT EXISTS (SELECT 1 FROM docs WHERE id = (SELECT min(id) FROM docs WHERE id <> '')) AS known, false AS unknown, (SELECT count(DISTINCT id) FROM docs) AS n_ids")
def store_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids looked up in the store's postings."""
    some = table(spark, folder, "docs").where("id <> ''").agg(F.min("id")).first()[0]
    with store.load(spark, _two_segments(spark, folder)) as s:
        return spark.createDataFrame([(s.contains_id(some), s.contains_id("no such id"), s.known_ids().distinct().count())], "known BOOLEAN, unknown BOOLEAN, n_ids BIGINT")


@_query("SELECT seq FROM docs WHERE segment_id % 2 = 1 AND doc_ord >= 100")
def store_overwrite(spark: SparkSession, folder: str) -> DataFrame:
    """A segment written anew; what it superseded is removed."""
    root = scratch(spark, "store")
    docs = table(spark, folder, "docs").where("segment_id % 2 = 1").select("doc_ord", F.col("seq"), "id", "fields")
    store.save(docs.drop("doc_ord").withColumnRenamed("seq", "doc_ord"), root, 1)
    store.save(docs.where("doc_ord >= 100").drop("doc_ord").withColumnRenamed("seq", "doc_ord"), root, 1, overwrite=True)
    store.vacuum(spark, root)
    return store.load(spark, root).all_docs().select(F.col("doc_ord").alias("seq"))


@_query(
    f"""WITH d AS (SELECT (1 - segment_id % 2)::INT AS src, * FROM docs),
    kept AS (SELECT src, seq, id FROM d WHERE {_NO_ID} UNION ALL
             SELECT src, seq, id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src, seq) AS k FROM d WHERE NOT {_NO_ID}) WHERE k = 1)
    SELECT row_number() OVER (ORDER BY src, seq) - 1 AS doc_ord, id FROM kept"""
)
def store_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Two segments of the store merged into a third, the later one first."""
    root = _two_segments(spark, folder)
    store.merge(spark, root, [1, 0], 2)
    store.remove(spark, root, [0, 1])
    return store.load(spark, root).docs.select("doc_ord", "id")


@_query(_NUMBERED)
def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """The records as a stream, ingested by micro-batches; delivered twice, taken once."""
    source, root, checkpoint = (scratch(spark, name) for name in ("arrivals", "store", "stream"))
    batch = _batch(spark, folder)
    batch.coalesce(1).write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema(batch.schema).parquet(source)
        ingest(stream, root, checkpoint).trigger(availableNow=True).start().awaitTermination()
    return _n_fields(store.load(spark, root).docs)
