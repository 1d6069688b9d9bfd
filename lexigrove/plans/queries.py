"""Driver queries of the search engine: query algebra, postings, dictionary, ingest, store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.durable import scratch
from lexigrove.functions import document
from lexigrove.model import ID_FIELD
from lexigrove.operators import postings as sets
from lexigrove.operators.ingest import prepare
from lexigrove.query import And, Not, Or, Query, Regexp, Term
from lexigrove.sources import store
from lexigrove.sources.loaders import rows_as_documents
from lexigrove.sources.snapshot import Snapshot, merged
from lexigrove.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def corpus(spark: SparkSession, folder: str) -> Snapshot:
    """The delivered records with their inverted index."""
    return Snapshot(table(spark, folder, "docs"), table(spark, folder, "postings"))


def event_corpus(spark: SparkSession, folder: str, segments: int = 1) -> Snapshot:
    """Events as documents, dealt into segments by their id."""
    events = table(spark, folder, "events")
    columns = {"event_type": "event_type", "user_id": "user_id", "k": F.get_json_object("props", "$.k")}
    return Snapshot(rows_as_documents(events, "event_id", columns, F.col("event_id") % segments))


def _t(field: str, value: str) -> str:
    return f"coalesce(list_contains(fields, {{'name': '{field}', 'value': '{value}'}}), false)"


def _r(field: str, pattern: str, function: str = "regexp_matches") -> str:
    return f"coalesce(len(list_filter(fields, lambda e: e.name = '{field}' AND e.value <> '' AND {function}(e.value, '{pattern}'))) > 0, false)"


def _search(name: str, query: Query, where: str, strategy: str = "auto") -> None:
    """Register a search over the records that returns their sequence numbers."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return corpus(spark, folder).search(query, strategy).select("seq")

    run.__name__ = name
    _query(f"SELECT seq FROM docs WHERE {where}")(run)


_LIVE, _SECONDS, _HALL, _RELAY = Term("tier", "live"), Term("unit", "seconds"), Term("job", "sweep-hall"), Term("job", "relay-alpha")
_CREW = Regexp("owner", "^(?:delta|cedar)-.*")
_TOTAL = Regexp("__name__", "_total")
_MIXED = Or(And(_LIVE, _TOTAL, Not(_HALL)), And(Not(_LIVE), Or(_SECONDS, _RELAY)), Not(Or(Regexp("build", r"^\d"), Term("zone", "harbor-1"))))
_WORDY = Regexp("owner", "^(?:(?:[a-z]|-)+)*(?:delta|cedar)(?:-|[a-z])*$")
_W_LIVE, _W_SECONDS, _W_HALL, _W_RELAY = (_t(q.field, q.value) for q in (_LIVE, _SECONDS, _HALL, _RELAY))
_W_CREW, _W_TOTAL = _r("owner", "^(?:delta|cedar)-.*"), _r("__name__", "_total")
_W_WORDY = _r("owner", _WORDY.pattern)
_W_MIXED = (
    f"({_W_LIVE} AND {_W_TOTAL} AND NOT {_W_HALL}) OR (NOT {_W_LIVE} AND ({_W_SECONDS} OR {_W_RELAY})) "
    rf"OR NOT ({_r('build', '^[0-9]')} OR {_t('zone', 'harbor-1')})"
)

_search("term", _RELAY, _W_RELAY)
_search("term_hot", _LIVE, _W_LIVE)
_search("term_missing_field", Term("no such field", "x"), "false")
_search("term_missing_term", Term("tier", "no such term"), "false")
_search("regexp_search", _CREW, _W_CREW)
_search("regexp_unanchored", _TOTAL, _W_TOTAL)
_search("regexp_prefix", Regexp("host", "^rk0[0-4]-n000"), _r("host", "^rk0[0-4]-n000"))
_search("regexp_full", Regexp("build", r"\d[.]4[.].", anchored=True), _r("build", "[0-9][.]4[.].", "regexp_full_match"))
_search("regexp_folded", Regexp("zone", "(?i)HARBOR-[[:digit:]]$"), _r("zone", "(?i)HARBOR-[0-9]$"))
_search("regexp_alternation", _WORDY, _W_WORDY)  # repeated groups, matched by an automaton
_search("regexp_alternation_scan", _WORDY, _W_WORDY, "scan")
_search("regexp_nested_loops", And(Regexp("host", "(?:[a-z]+[0-9]*)+-n(?:0|1|2)*$"), Not(_LIVE)), _r("host", "(?:[a-z]+[0-9]*)+-n(?:0|1|2)*$") + f" AND NOT {_W_LIVE}")
_search("search_lookup", And(_RELAY, _CREW), f"{_W_RELAY} AND {_W_CREW}", "lookup")
_search("negation", Not(_LIVE), f"NOT {_W_LIVE}")
_search("negation_absent_field", Not(Term("shard", "50")), f"NOT {_t('shard', '50')}")
_search("conjunction", And(_LIVE, _CREW, Not(_HALL)), f"{_W_LIVE} AND {_W_CREW} AND NOT {_W_HALL}")
_search("conjunction_empty", And(), "false")
_search("conjunction_all_negative", And(Not(_LIVE), Not(_SECONDS)), f"NOT {_W_LIVE} AND NOT {_W_SECONDS}")
_search("conjunction_nested_negation", And(And(_LIVE, Not(_SECONDS)), _CREW), f"{_W_LIVE} AND NOT {_W_SECONDS} AND {_W_CREW}")
_search("conjunction_nested_empty", And(And(), Not(_LIVE)), "false")
_search("disjunction", Or(_RELAY, _TOTAL), f"{_W_RELAY} OR {_W_TOTAL}")
_search("disjunction_same_field", Or(*[Term("zone", z) for z in ("harbor-1", "harbor-2", "ridge-1")]), _r("zone", "^(harbor-1|harbor-2|ridge-1)$"))
_search("disjunction_empty", Or(), "false")
_search("nested_mixed", _MIXED, _W_MIXED)
_search("nested_mixed_scan", _MIXED, _W_MIXED, "scan")
_search("nested_mixed_joins", _MIXED, _W_MIXED, "joins")


def _events(spark: SparkSession, folder: str, query: Query, segments: int = 1) -> DataFrame:
    return event_corpus(spark, folder, segments).search(query).select(F.col("id").cast("long").alias("event_id"))


_K = "json_extract_string(props, '$.k')"


@_query("SELECT event_id FROM events WHERE event_id = 42")
def term_by_id(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder, Term(ID_FIELD, "42"))


@_query(f"SELECT event_id FROM events WHERE event_type = 'click' AND regexp_matches({_K}, '^6') AND NOT user_id = 8")
def event_conjunction(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder, And(Term("event_type", "click"), Regexp("k", "^6"), Not(Term("user_id", "8"))))


@_query(f"SELECT event_id FROM events WHERE event_type = 'click' AND {_K} = '69' AND event_id % 4 >= 0")
def multi_segment_conjunction(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder, And(Term("event_type", "click"), Term("k", "69")), segments=4)


@_query("SELECT seq, copy FROM docs, (SELECT unnest([0, 1])::INT AS copy) WHERE " + _W_RELAY)
def multi_segment_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """The same documents in other segments are other documents."""
    docs, p = table(spark, folder, "docs"), table(spark, folder, "postings")
    copies = [
        Snapshot(docs.select("seq", F.lit(c).alias("copy"), (F.col("segment_id") * 2 + c).alias("segment_id"), "doc_ord", "id", "fields"),
                 p.select((F.col("segment_id") * 2 + c).alias("segment_id"), "field", "term", "doc_ord", "id"))
        for c in (0, 1)
    ]
    return Snapshot.of(copies).search(_RELAY).select("seq", "copy")


_ALL = "(SELECT DISTINCT seq, e.name AS field, e.value AS term FROM (SELECT seq, unnest(fields) AS e FROM docs) WHERE e.name <> '' AND e.value <> '')"


@_query(f"SELECT DISTINCT field FROM {_ALL} UNION SELECT '{ID_FIELD}'")
def fields(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).fields()


@_query(f"SELECT DISTINCT term FROM {_ALL} WHERE field = 'zone'")
def terms(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).terms("zone")


@_query(f"SELECT field, term, count(*) AS n FROM {_ALL} GROUP BY field, term")
def document_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).document_frequency()


@_query("SELECT count(*) AS n FROM docs")
def size(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame([(corpus(spark, folder).size(),)], "n BIGINT")


@_query("SELECT segment_id, doc_ord FROM docs")
def match_all(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).match_all()


@_query("SELECT seq, id, coalesce(len(fields), -1) AS n_fields FROM docs")
def all_docs(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).all_docs().select("seq", "id", F.coalesce(F.size("fields"), F.lit(-1)).cast("long").alias("n_fields"))


@_query("SELECT seq FROM docs WHERE doc_ord >= 100 AND doc_ord < 200")
def range_docs(spark: SparkSession, folder: str) -> DataFrame:
    return sets.bounded(corpus(spark, folder).all_docs(), 100, 200).select("seq")


@_query(f"SELECT seq FROM docs WHERE {_W_RELAY} AND doc_ord < 250")
def snapshot_bound(spark: SparkSession, folder: str) -> DataFrame:
    return Snapshot(table(spark, folder, "docs"), table(spark, folder, "postings"), bound=250).search(_RELAY).select("seq")


@_query("SELECT seq FROM docs SEMI JOIN (SELECT segment_id, doc_ord FROM postings WHERE field = 'shard') USING (segment_id, doc_ord)")
def fetch_docs(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).fetch(table(spark, folder, "postings").where("field = 'shard'")).select("seq")


def _postings_of(spark: SparkSession, folder: str, field: str, term: str) -> DataFrame:
    return table(spark, folder, "postings").where((F.col("field") == field) & (F.col("term") == term)).select("segment_id", "doc_ord")


def _p(field: str, term: str) -> str:
    return f"SELECT segment_id, doc_ord FROM postings WHERE field = '{field}' AND term = '{term}'"


_SETS = (("unit", "seconds"), ("job", "sweep-hall"))


def _set_query(name: str, f: Callable[[DataFrame, DataFrame], DataFrame], sql: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return f(*(_postings_of(spark, folder, *s) for s in _SETS))

    run.__name__ = name
    _query(f"{_p(*_SETS[0])} {sql} {_p(*_SETS[1])}")(run)


_set_query("postings_intersect", sets.intersect, "INTERSECT")
_set_query("postings_union", sets.union, "UNION")
_set_query("postings_difference", sets.difference, "EXCEPT")


@_query(f"SELECT min(doc_ord) AS low, max(doc_ord) AS high, count(DISTINCT doc_ord) AS n FROM ({_p('unit', 'seconds')})")
def postings_bounds(spark: SparkSession, folder: str) -> DataFrame:
    found = _postings_of(spark, folder, "unit", "seconds").select("doc_ord")
    return spark.createDataFrame([(*sets.bounds(found), sets.size(found))], "low BIGINT, high BIGINT, n BIGINT")


@_query(f"SELECT doc_ord FROM ({_p('shard', '50')}) UNION SELECT unnest(range(3, 50)) AS doc_ord")
def postings_add_range(spark: SparkSession, folder: str) -> DataFrame:
    return sets.add_range(_postings_of(spark, folder, "shard", "50").select("doc_ord"), 3, 50)


@_query(f"SELECT DISTINCT doc_ord FROM ({_p('unit', 'seconds')}) WHERE NOT (doc_ord >= 20 AND doc_ord < 480)")
def postings_remove_range(spark: SparkSession, folder: str) -> DataFrame:
    return sets.remove_range(_postings_of(spark, folder, "unit", "seconds").select("doc_ord").distinct(), 20, 480)


@_query("SELECT field, segment_id, count(DISTINCT doc_ord) AS n FROM postings GROUP BY field, segment_id")
def postings_bitmap_counts(spark: SparkSession, folder: str) -> DataFrame:
    return sets.bitmap_counts(table(spark, folder, "postings"), ["field", "segment_id"])


_NO_ID, _NO_FIELDS = "(id IS NULL OR id = '')", "coalesce(len(fields), 0) = 0"
_FIRST = f"(SELECT *, min(seq) OVER (PARTITION BY id) AS first FROM docs WHERE NOT {_NO_ID})"


def _prepared(spark: SparkSession, folder: str):
    return prepare(table(spark, folder, "docs").select(F.col("seq").alias("idx"), "id", "fields"))


@_query(f"SELECT seq FROM {_FIRST} WHERE seq = first UNION ALL SELECT seq FROM docs WHERE {_NO_ID} AND NOT {_NO_FIELDS}")
def ingest_first_wins(spark: SparkSession, folder: str) -> DataFrame:
    return _prepared(spark, folder).accepted.select(F.col("idx").alias("seq"))


@_query(
    f"SELECT seq, '{document.DUPLICATE_ID}' AS error FROM {_FIRST} WHERE seq > first "
    f"UNION ALL SELECT seq, '{document.EMPTY}' FROM docs WHERE {_NO_ID} AND {_NO_FIELDS}"
)
def ingest_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return _prepared(spark, folder).rejects.select(F.col("idx").alias("seq"), "error")


@_query(
    f"""WITH d AS (SELECT (segment_id % 2)::INT AS src, * FROM docs),
    kept AS (SELECT src, segment_id, doc_ord, id FROM d WHERE {_NO_ID} UNION ALL
             SELECT src, segment_id, doc_ord, id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src, segment_id, doc_ord) AS k FROM d WHERE NOT {_NO_ID}) WHERE k = 1)
    SELECT row_number() OVER (ORDER BY src, segment_id, doc_ord) - 1 AS doc_ord, id FROM kept"""
)
def merge_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "docs")
    return merged([docs.where(F.col("segment_id") % 2 == k) for k in (0, 1)]).select("doc_ord", "id")


@_query(f"SELECT seq FROM docs WHERE {_W_MIXED.replace(chr(92) + 'd', '[0-9]')}")
def save_load_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The records written as a segment of Parquet files, read again and searched."""
    root = scratch(spark, "store")
    docs = table(spark, folder, "docs")
    store.save(docs.select(F.col("seq").alias("doc_ord"), "id", F.filter("fields", lambda e: (e["name"] != "") & (e["value"] != "")).alias("fields")), root, 0)
    return store.load(spark, root).search(_MIXED).select(F.col("doc_ord").alias("seq"))


@_query("SELECT n, count(*) AS documents FROM (SELECT count(*) AS n FROM docs GROUP BY coalesce(id, ''), list_sort(coalesce(fields, []))) GROUP BY n")
def equal_documents(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).equal_documents().groupBy("n").agg(F.count(F.lit(1)).alias("documents"))


@_query("SELECT seq, list_filter(fields, lambda e: e.name = 'feature')[1].value AS feature FROM docs")
def first_value(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "docs").select("seq", document.first_value("fields", "feature").alias("feature"))


@_query(
    "SELECT seq, '{id: ' || coalesce(id, '') || ', fields: {' || coalesce(list_reduce(list_transform(fields, lambda e: coalesce(e.name, '') || ': ' || coalesce(e.value, '')), "
    "lambda x, y: x || ', ' || y), '') || '}}' AS shown FROM docs WHERE len(fields) > 0"
)
def display(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "docs").where(F.size("fields") > 0).select("seq", document.display("id", "fields").alias("shown"))


@_query(
    """SELECT s.segment_id, coalesce(max(s.num_docs), -1) AS num_docs, (SELECT count(*) FROM docs d WHERE d.segment_id = s.segment_id) AS n_docs
    FROM segments s GROUP BY s.segment_id"""
)
def segment_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """The recorded and the actual number of documents of each segment (-1: not recorded); repeated records count once."""
    recorded = table(spark, folder, "segments").groupBy("segment_id").agg(F.coalesce(F.max("num_docs"), F.lit(-1)).alias("num_docs"))
    actual = table(spark, folder, "docs").groupBy("segment_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return recorded.join(actual, "segment_id", "left").select("segment_id", "num_docs", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
