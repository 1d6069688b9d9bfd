"""Validation, comparison, ingest, segments, store, loaders and streams."""

import json

import pytest
from pyspark.sql import functions as F

from lexigrove.functions import document
from lexigrove.functions.items import distinct_items, usable_entries
from lexigrove.model import DOCS, ID_FIELD, ClosedError, LexigroveError, SealedError
from lexigrove.operators.ingest import BatchError, numbered, prepare
from lexigrove.query import Regexp, Term
from lexigrove.sources import store
from lexigrove.sources.loaders import read_json_lines, rows_as_documents
from lexigrove.sources.segment import Segment
from lexigrove.streaming.ingest import ingest

BATCH = "idx BIGINT, id STRING, fields ARRAY<STRUCT<name: STRING, value: STRING>>"
BINARY = "idx BIGINT, id BINARY, fields ARRAY<STRUCT<name: BINARY, value: BINARY>>"


def test_validation(spark):
    rows = [
        (0, None, []), (1, b"x", None), (2, None, [(b"a", b"b")]), (3, b"x", [(b"a\xff", b"\xff")]), (4, b"x", [(ID_FIELD.encode(), b"b")]),
        (5, b"x", [(b"ok", b"c\xff"), (b"\xff", b"")]), (6, b"\xff", []), (7, b"", None), (8, b"x", [(None, None)]),
    ]
    found = spark.createDataFrame(rows, BINARY).select("idx", document.validation_error("id", "fields").alias("e")).collect()
    assert {r.idx: r.e for r in found} == {
        0: document.EMPTY, 1: None, 2: None, 3: document.BAD_NAME, 4: document.RESERVED_NAME, 5: document.BAD_VALUE, 6: document.BAD_ID, 7: document.EMPTY, 8: None,
    }


def test_comparison_and_display(spark):
    rows = [(0, "831992", [("apple", "red"), ("banana", "green")]), (1, "831992", [("banana", "green"), ("apple", "red")]), (2, "831992", [("apple", "red")]), (3, "831991", None),
            (4, "831992", [("apple", "red"), ("apple", "red"), ("banana", "green")])]
    df = spark.createDataFrame(rows, BATCH)
    c = {r.idx: r.c for r in df.select("idx", document.canonical("id", "fields").alias("c")).collect()}
    assert c[0] == c[1] != c[4] and c[3] < c[2] < c[0]
    assert [r.idx for r in df.orderBy(document.canonical("id", "fields"), "idx").collect()] == [3, 2, 4, 0, 1]
    shown = {r.idx: r.s for r in df.select("idx", document.display("id", "fields").alias("s")).collect()}
    assert shown[0] == "{id: 831992, fields: {apple: red, banana: green}}" and shown[3] == "{id: 831991, fields: {}}"


def test_values(spark):
    rows = [(0, "a", [("f", "1"), ("f", "2"), ("g", "")]), (1, "b", None), (2, "c", [None, ("f", None), (None, "x"), ("", "y"), ("f", "1"), ("f", "1")])]
    df = spark.createDataFrame(rows, BATCH)
    got = df.select(document.first_value("fields", "f"), document.all_values("fields", "f"), document.has_term("fields", "f", "1"), usable_entries("fields"), distinct_items("fields")).collect()
    assert [r[0] for r in got] == ["1", None, None] and got[0][1] == ["1", "2"] and [r[2] for r in got] == [True, False, True]
    assert [len(r[3]) for r in got] == [2, 0, 2] and [len(r[4]) for r in got] == [2, 0, 1]


def test_prepare(spark):
    rows = [
        (0, "bad", [(ID_FIELD, "x")]), (1, "bad", [("a", "b")]), (2, "old", [("a", "b")]), (3, "old", [("a", "c")]), (4, "new", [("a", "first")]), (5, "new", [("a", "second")]),
        (6, None, [("a", "b")]), (7, "", [("a", "b")]), (8, None, None),
    ]
    p = prepare(spark.createDataFrame(rows, BATCH), spark.createDataFrame([("old",)], "id STRING"))
    got = {r.idx: r for r in p.accepted.collect()}
    assert set(got) == {1, 4, 6, 7} and got[4].fields[0].value == "first" and len(got[6].id) == 24 and got[6].id != got[7].id
    assert sorted((r.idx, r.error) for r in p.rejects.collect()) == [(0, document.RESERVED_NAME), (5, document.DUPLICATE_ID), (8, document.EMPTY)]
    assert {r.idx for r in p.without_duplicate_errors().collect()} == {0, 8}
    strict = prepare(spark.createDataFrame(rows[6:7], BATCH), make_ids=False)
    assert strict.accepted.count() == 0 and strict.rejects.first().error == "document has no id"
    assert prepare(spark.createDataFrame([], BATCH)).accepted.count() == 0


def test_numbered(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k", "'x' AS doc_ord")
    got = numbered(df, ["k"], 5).collect()
    assert {(r.k, r.doc_ord) for r in got} == {(k, k + 5) for k in range(1000)}


def test_segment(spark):
    s = Segment(spark)
    assert s.insert([("fruit", "banana"), ("color", "yellow")]) and s.insert([("fruit", "apple")], id="42") == "42"
    before = s.snapshot()
    assert s.insert([("fruit", "other")], id="42") == "42" and s.size() == 2
    with pytest.raises(BatchError):
        s.insert_batch(spark.createDataFrame([(0, "x", [("a", "b")]), (1, "x", [("a", "b")])], BATCH))
    assert s.size() == 2
    done = s.insert_batch(spark.createDataFrame([(0, "42", []), (1, "x", [("a", "b")]), (2, "x", [])], BATCH), partial=True)
    assert [r.idx for r in done.rejects.collect()] == [2] and s.size() == 3 and before.size() == 2
    assert s.contains_id("x") and {r.field for r in s.fields().collect()} == {"fruit", "color", "a", ID_FIELD} and s.terms("fruit").count() == 2
    assert [r.doc_ord for r in s.snapshot().search(Regexp("fruit", "ple$")).collect()] == [1]
    other = Segment(spark, 1)
    other.insert([("fruit", "pear")], id="x")
    other.insert([("fruit", "plum")], id="y")
    s.merge(other)
    assert s.size() == 4 and [r.fields[0].name for r in s.snapshot().docs.where("id = 'x'").collect()] == ["a"]
    s.seal()
    assert s.sealed
    for f in (s.seal, lambda: s.insert([("a", "b")]), lambda: s.merge(other)):
        with pytest.raises(SealedError):
            f()
    with s:
        pass
    for f in (s.close, s.snapshot):
        with pytest.raises(ClosedError):
            f()
    assert s.size() == 0


def test_store(spark, tmp_path):
    docs = spark.createDataFrame([(0, 0, "a", [("f", "x"), ("g", "y")]), (0, 1, "b", None), (0, 2, "c", [("f", "x")])], DOCS)
    root = str(tmp_path / "store")
    assert store.segments(spark, root) == [] and store.load(spark, root).size() == 0
    store.save(docs, root, 3)
    store.save(docs.where("doc_ord > 0"), root, 4)
    s = store.load(spark, root)
    assert store.metadata(spark, root, 3)["num_docs"] == 3
    assert sorted((r.segment_id, r.doc_ord) for r in s.search(Term("f", "x")).collect()) == [(3, 0), (3, 2), (4, 2)]
    assert store.load(spark, root, [4]).size() == 2
    store.merge(spark, root, [4, 3], 5)
    assert [(r.doc_ord, r.id) for r in store.load(spark, root, [5]).docs.orderBy("doc_ord").collect()] == [(0, "b"), (1, "c"), (2, "a")]
    store.save(docs, root, 6)
    store.remove(spark, root, [6, 7])
    assert store.segments(spark, root) == [3, 4, 5] and not (tmp_path / "store" / "segment=6").exists()
    with pytest.raises(store.StoreError):
        store.merge(spark, root, [3, 4], 3)
    with pytest.raises(store.StoreError):
        store.load(spark, root, [9])
    for column, value in (("major", 2), ("format", "other")):
        meta = {"segment_id": 3, "major": 1, "minor": 0, "format": "parquet", "num_docs": 3, column: value}
        spark.createDataFrame([tuple(meta.values())], store._META).coalesce(1).write.mode("overwrite").parquet(f"{root}/segment=3/meta")
        with pytest.raises(store.StoreError):
            store.load(spark, root)


def test_unfinished_segment_is_not_read(spark, tmp_path):
    docs = spark.createDataFrame([(0, 0, "a", [("f", "x")])], DOCS)
    docs.write.parquet(str(tmp_path / "segment=0" / "docs"))
    assert store.segments(spark, str(tmp_path)) == []


def test_json_lines(spark, tmp_path):
    lines = [{"a": "1", "b": "", "": "x"}, {"c": "é"}, {}]
    path = tmp_path / "d.json"
    path.write_text("".join(json.dumps(x) + "\n" for x in lines) + "\n")
    got = read_json_lines(spark, str(path)).collect()
    assert sorted([tuple(f) for f in r.fields] for r in got) == [[], [("a", "1")], [("c", "é")]] and all(len(r.id) == 24 for r in got)
    assert read_json_lines(spark, str(path), 2).count() == 2
    with pytest.raises(LexigroveError):
        read_json_lines(spark, str(path), 4)


def test_rows_as_documents(spark):
    df = spark.createDataFrame([(5, "x", None), (6, None, 2)], "k INT, a STRING, b INT")
    got = rows_as_documents(df, "k", {"a": "a", "b": "b"}).orderBy("doc_ord").collect()
    assert [[tuple(f) for f in r.fields] for r in got] == [[("a", "x")], [("b", "2")]] and got[0].id == "5"


def test_stream(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "store")
    rows = [(0, "a", [("f", "x")]), (1, "a", [("f", "y")]), (2, None, [("f", "z")])]
    spark.createDataFrame(rows, BATCH).coalesce(1).write.parquet(str(source))
    for _ in range(2):  # a restart repeats nothing
        stream = spark.readStream.schema(BATCH).parquet(str(source))
        query = ingest(stream, root, str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert store.load(spark, root).size() == 2
    spark.createDataFrame([(0, "a", [("f", "again")]), (1, "b", [("f", "new")])], BATCH).coalesce(1).write.mode("append").parquet(str(source))
    ingest(spark.readStream.schema(BATCH).parquet(str(source)), root, str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    s = store.load(spark, root)
    assert store.segments(spark, root) == [0, 1] and s.size() == 3 and {r.term for r in s.terms("f").collect()} == {"x", "z", "new"}


def test_segment_writes_single_documents_together(spark, monkeypatch):
    from lexigrove.sources import segment as module

    monkeypatch.setattr(module, "_HELD", 3)
    s = Segment(spark, make_ids=lambda idx: F.concat(F.lit("made-"), idx))
    made = [s.insert([("k", str(i))]) for i in range(4)]
    assert made == [f"made-{i}" for i in range(4)] and s.insert([], id="made-1") == "made-1" and s.insert([], id="made-3") == "made-3"
    for bad in ([], [(ID_FIELD, "x")]):
        with pytest.raises(BatchError):
            s.insert(bad)
    with pytest.raises(BatchError):
        Segment(spark, make_ids=False).insert([("a", "b")])
    s.insert_batch(spark.createDataFrame([(0, "made-3", [("k", "no")]), (1, "z", [(None, "v")])], BATCH), partial=True)
    assert [(r.doc_ord, r.id) for r in s.snapshot().docs.orderBy("doc_ord").collect()] == [*enumerate(made), (4, "z")]


def test_overwrite_survives_a_crash(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(0, 0, "a", [("f", "x")]), (0, 1, "b", [("f", "x")])], DOCS)
    root = str(tmp_path)
    store.save(docs, root, 0)
    with pytest.raises(store.StoreError):
        store.save(docs, root, 0)

    def crash(*_):
        raise RuntimeError("crash")

    with monkeypatch.context() as m:
        m.setattr(store, "to_postings", crash)  # after the documents, before the commit
        with pytest.raises(RuntimeError):
            store.save(docs.where("doc_ord = 1"), root, 0, overwrite=True)
    before = store.load(spark, root)
    assert before.size() == 2 and before.search(Term("f", "x")).count() == 2 and store.metadata(spark, root, 0)["num_docs"] == 2
    store.save(docs.where("doc_ord = 1"), root, 0, overwrite=True)
    assert before.size() == 2 and store.load(spark, root).size() == 1 == store.metadata(spark, root, 0)["num_docs"]
    assert store.vacuum(spark, root) == 4 and store.load(spark, root).search(Term("f", "x")).count() == 1 and store.vacuum(spark, root) == 0


def test_opening_takes_one_job_for_any_number_of_segments(spark, tmp_path):
    docs = spark.createDataFrame([(0, 0, "a", [("f", "x")])], DOCS)
    sc, jobs = spark.sparkContext, {}
    for n in (2, 5):
        root = str(tmp_path / str(n))
        for k in range(n):
            store.save(docs, root, k)
        sc.setJobGroup(f"open-{n}", "")
        assert len(store.load(spark, root).docs.columns) == 4
        jobs[n] = len(sc.statusTracker().getJobIdsForGroup(f"open-{n}"))
        sc.setJobGroup("", "")
        s = store.load(spark, root)
        assert s.size() == n and s.contains_id("a") and not s.contains_id("b") and s.search(Term(ID_FIELD, "a")).count() == n
    assert jobs[2] == jobs[5] <= 2


def test_other_formats(spark, tmp_path):
    docs = spark.createDataFrame([(0, 0, "a", [("f", "x")])], DOCS)

    class Csv:
        """Tables as rows of JSON text."""

        name = "json-text"

        def write(self, df, path):
            df.write.mode("overwrite").json(path)

        def read(self, spark, schema, paths):
            return spark.read.schema(schema).json(paths)

    store.register_format(Csv())
    for k, fmt in enumerate(("parquet", "orc", "json-text")):
        store.save(docs, str(tmp_path), k, fmt=fmt)
    assert sorted(r.segment_id for r in store.load(spark, str(tmp_path)).search(Term("f", "x")).collect()) == [0, 1, 2]
