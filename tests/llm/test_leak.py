"""Leaked test passages: folding, alignment, removal."""

import numpy as np
import pytest

from lexigrove.llm.leak import ItemIndex, hashed_words, leaks, scrub, scrubbed, word_spans, words

VOCABULARY = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]


def _text(rng, n):
    return [str(w) for w in rng.choice(VOCABULARY, n)]


def test_words():
    assert words("The Kårvik-​Bank’s ｗｅｌｌ 2²") == ["the", "karvik", "bank", "s", "well", "22"]
    assert words("Тһе reɡiѕter Ка̊rvik") == ["the", "register", "karvik"]
    text = "Ａ​ b­c, oﬃce-É́ x²"
    assert [words(text[a:b])[0] for a, b in word_spans(text)] == words(text)


def _fixture():
    rng = np.random.default_rng(3)
    items = {k: _text(rng, 60 + k) for k in range(12)}
    filler = lambda n: _text(rng, n)
    inserted = [x for k, w in enumerate(items[3]) for x in ([w, "applause"] if k % 9 == 4 else [w])]
    changed = ["unfunded" if k % 8 == 5 else w for k, w in enumerate(items[4])]
    docs = {
        1: (filler(50) + items[0] + filler(50), {0}), 2: (filler(20) + items[1][15:50] + filler(10), {1}), 3: (filler(30) + inserted, {3}), 4: (changed + filler(5), {4}),
        5: (filler(40) + items[5][:10] + filler(40), set()), 6: (filler(500), set()), 7: ([w.upper() for w in items[6]], {6}), 8: (items[7] + filler(9) + items[8], {7, 8}),
        9: (items[9][::-1], set()), 10: ([x for w in items[10] for x in [w, *filler(20)]], set()), 11: (filler(30_000) + items[0] + filler(100), {0}),
    }
    return items, docs


SCHEMA = "doc_id BIGINT, text STRING, item_id STRING, coverage INT"


@pytest.mark.parametrize("block_chars", [20_000_000, 2_000])
def test_leaks(spark, block_chars):
    items, docs = _fixture()
    surface = lambda ws: ", ".join(ws).replace("a", "а").replace("word", "wo­rd")
    rows = [(k, " ".join(ws), "x", 1) for k, (ws, _) in docs.items()] + [(100 + k, surface(ws), "x", 1) for k, (ws, _) in docs.items()]
    rows += [(200, None, "x", 1), (201, "", "x", 1), (1, rows[0][1], "x", 1), (None, rows[0][1], "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    its = spark.createDataFrame([(k, " ".join(ws).title()) for k, ws in items.items()] + [(50, None), (51, ""), (52, "too short"), (None, "a b c"), (None, "a b")], "item_id BIGINT, text STRING")
    found = leaks(df, its, block_chars=block_chars)
    got = sorted((r.doc_id, r.item_id) for r in found.where("doc_id IS NOT NULL").collect())
    assert [r.item_id for r in found.where("doc_id IS NULL").collect()] == [0]
    expected = [(k + plus, i) for k, (_, want) in docs.items() for plus in (0, 100) for i in want]
    assert got == sorted([*expected, (1, 0)])
    whole = {(r.doc_id, r.item_id): r for r in found.collect()}[1, 0]
    assert whole.coverage == 1 and (whole.first_word, whole.last_word) == (50, 109)


def test_removal(spark):
    items, docs = _fixture()
    df = spark.createDataFrame([(k, " ".join(ws), "x", 1) for k, (ws, _) in docs.items()] + [(200, None, "x", 1)], SCHEMA)
    df = df.unionByName(spark.createDataFrame([(1, "another text", "x", 1), (None, "no id", "x", 1)], SCHEMA))
    its = spark.createDataFrame([(k, " ".join(ws)) for k, ws in items.items()], "item_id BIGINT, text STRING")
    found = leaks(df, its)
    rest = scrubbed(df, found).collect()
    assert {"another text", "no id"} <= {r.text for r in rest} and len(rest) == len(docs) + 3
    kept = {r.doc_id: r.text for r in rest if r.text not in ("another text", "no id")}
    assert set(kept) == {*docs, 200} and kept[200] is None and kept[6] == " ".join(docs[6][0])
    assert kept[1].split() == docs[1][0][:50] + docs[1][0][110:] and kept[8].split() == docs[8][0][67:76]
    assert leaks(spark.createDataFrame(list(kept.items()), "doc_id BIGINT, text STRING"), its).count() == 0
    by = lambda rows: sorted((r.doc_id or 0, r.text or "") for r in rows)
    assert by(scrub(df, its).collect()) == by(scrub(df, its, block_chars=2_000).collect()) == by(rest)
    assert {r.doc_id for r in scrubbed(df, found, whole=True).collect()} == {5, 6, 9, 10, 200, None}


def test_repeated_items_are_found(spark):
    text = " ".join(_text(np.random.default_rng(1), 60))
    its = spark.createDataFrame([(k, text) for k in range(10)], "item_id BIGINT, text STRING")
    df = spark.createDataFrame([(1, "so " + text)], "doc_id BIGINT, text STRING")
    assert {r.item_id for r in leaks(df, its).collect()} == set(range(10))


def test_every_copy_is_found_and_removed(spark):
    rng = np.random.default_rng(8)
    long, short, fill = _text(rng, 60), _text(rng, 9), [f"other{i}" for i in range(400)]
    texts = {
        1: fill[:30] + long + fill[30:230] + long + fill[230:260], 2: long + long + fill[:5] + long, 3: fill[:7] + short + fill[7:9] + short + short + fill[9:20],
        4: fill[:9] + long + fill[9:40] + long[:40] + fill[40:60] + long[5:55] + fill[60:70], 5: fill[:100] + long[:20] + fill[100:] + long,
    }
    its = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(short))], "item_id BIGINT, text STRING")
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id BIGINT, text STRING")
    found = leaks(df, its)
    spans = sorted((r.doc_id, r.item_id, r.first_word, r.last_word) for r in found.collect())
    assert spans == [
        (1, 1, 30, 89), (1, 1, 290, 349), (2, 1, 0, 59), (2, 1, 60, 119), (2, 1, 125, 184), (3, 2, 7, 15), (3, 2, 18, 26), (3, 2, 27, 35),
        (4, 1, 9, 68), (4, 1, 100, 139), (4, 1, 160, 209), (5, 1, 420, 479),
    ]
    rest = {r.doc_id: r.text.split() for r in scrubbed(df, found).collect()}
    assert rest == {1: fill[:260], 2: fill[:5], 3: fill[:20], 4: fill[:70], 5: fill[:100] + long[:20] + fill[100:]}


def test_documents_without_an_id_are_scrubbed(spark):
    rng = np.random.default_rng(9)
    item, fill = _text(rng, 60), [f"other{i}" for i in range(40)]
    texts = [(None, fill[:20] + item + fill[20:]), (None, fill[:20] + item + fill[20:]), (None, item + fill), (None, fill), (1, fill + item), (1, fill)]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in texts] + [(None, None)], "doc_id BIGINT, text STRING")
    found = leaks(df, spark.createDataFrame([(1, " ".join(item))], "item_id BIGINT, text STRING"))
    rest = [(r.doc_id, r.text) for r in scrubbed(df, found).collect()]
    assert sorted((k or 0, t and len(t.split())) for k, t in rest if t) == [(0, 40)] * 4 + [(1, 40)] * 2 and (None, None) in rest
    assert all(t is None or t.split() == fill for _, t in rest)
    kept = [(r.doc_id, r.text) for r in scrubbed(df, found, whole=True).collect()]
    assert sorted(kept, key=str) == sorted([(None, " ".join(fill)), (None, None)], key=str)


def test_pieces_are_joined_over_long_insertions(spark):
    rng = np.random.default_rng(10)
    item, other, fill = _text(rng, 60), _text(rng, 40), [f"other{i}" for i in range(400)]
    lone = [f"changed{k}" if k % 8 in (5, 7) else w for k, w in enumerate(other[:28])]
    texts = {
        1: (fill[:9] + item[5:25] + fill[:40] + item[25:45] + fill[:9], [(9, 88)]), 2: (item[:14] + fill[:20] + item[16:30] + fill[:90] + item[40:50], [(0, 147)]),
        3: (fill[:5] + lone + fill[:5], [(5, 32)]), 4: (item[:14] + fill[:300] + item[14:30], []), 5: (item[40:] + fill[:9] + item[:20], []), 6: (item[:10] + fill[:20] + item[20:30], []),
    }
    its = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other))], "item_id BIGINT, text STRING")
    found = leaks(spark.createDataFrame([(k, " ".join(t)) for k, (t, _) in texts.items()], "doc_id BIGINT, text STRING"), its).collect()
    assert {k: [(r.first_word, r.last_word) for r in found if r.doc_id == k] for k in texts} == {k: spans for k, (_, spans) in texts.items()}


def test_blocks_are_bounded_whatever_the_ids(spark, monkeypatch):
    rng = np.random.default_rng(11)
    texts = [" ".join(_text(rng, 60)) for _ in range(40)]
    listed = [(None, t) for t in texts[:20]] + [(7, t) for t in texts[20:]] + [(8, texts[0])] * 60
    sizes = []

    built = ItemIndex.__init__

    def init(self, items, *more):
        sizes.append(sum(len(t) for _, t in items))
        built(self, items, *more)

    monkeypatch.setattr(ItemIndex, "__init__", init)
    df = spark.createDataFrame([(1, "so " + texts[0]), (2, texts[30])], "doc_id BIGINT, text STRING")
    found = leaks(df, spark.createDataFrame(listed, "item_id BIGINT, text STRING"), block_chars=5_000)
    assert sorted((r.doc_id, r.item_id or 0) for r in found.collect()) == [(1, 0)] + [(1, 8)] * 60 + [(2, 7)]
    assert len(sizes) == 4 and max(sizes) < 8_000


@pytest.mark.parametrize("block_chars", [20_000_000, 1_000])
def test_shared_halves_start_candidates(spark, block_chars):
    rng = np.random.default_rng(12)
    shared = _text(rng, 24)
    items = {k: shared + _text(rng, 36) for k in range(6)}
    leaked = [w if k != 26 else "changed" for k, w in enumerate(items[1][:31])]
    texts = {1: ["so", *leaked], 2: ["so", *shared], 3: items[2], 4: shared + ["and"] + shared, 5: ["so", *leaked]}
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id BIGINT, text STRING")
    its = spark.createDataFrame([(k, " ".join(ws)) for k, ws in items.items()], "item_id BIGINT, text STRING")
    assert sorted((r.doc_id, r.item_id, r.n_matched) for r in leaks(df, its, block_chars=block_chars).collect()) == [(1, 1, 30), (3, 2, 60), (5, 1, 30)]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id BIGINT, text STRING, item_id BIGINT")
    full = spark.createDataFrame([(1, "a b c d e f", 1)], "doc_id BIGINT, text STRING, item_id BIGINT")
    assert leaks(df, full).count() == leaks(full, df).count() == 0
    assert list(ItemIndex([]).candidates(*hashed_words(["a b c d e"]))) == []
    assert scrub(df, full).count() == 0 and scrub(full, df).collect() == [(1, "a b c d e f")]


def _edited(rng, item, rate, long):
    """``item`` with a part of its words changed, left out or followed by others, and up to two longer insertions."""
    out, kept = [], 0
    for w in item:
        kind = rng.random() < rate and rng.integers(3)
        out += ["changed"] if kind == 0 and kind is not False else [] if kind == 1 else [w, "inserted"] if kind == 2 else [w]
        kept += kind not in (0, 1) or kind is False
    for at in sorted(rng.integers(0, len(out), 2 if long else 0).tolist(), reverse=True):
        out[at:at] = [f"other{k}" for k in range(long)]
    return out, kept / len(item)


def test_recall_over_edits_and_insertions(spark):
    """All rates of edits and lengths of insertions: leaks of half an item or more are found, nothing else is."""
    rng = np.random.default_rng(21)
    vocabulary, share = np.array(VOCABULARY), 1 / np.arange(1, len(VOCABULARY) + 1)
    text = lambda n: [str(w) for w in rng.choice(vocabulary, n, p=share / share.sum())]
    items = {k: text(int(rng.integers(50, 121))) for k in range(40)}
    docs, wanted = {}, {}
    for rate in (0, 0.1, 0.2, 0.3, 0.4):
        for long in (0, 17, 40, 60):
            for k, item in items.items():
                leaked, kept = _edited(rng, item, rate, long)
                docs[len(docs)] = text(int(rng.integers(0, 300))) + leaked + text(int(rng.integers(0, 300)))
                wanted[len(docs) - 1] = (k, kept, rate)
    for _ in range(300):
        docs[len(docs)] = text(500)
    its = spark.createDataFrame([(k, " ".join(t)) for k, t in items.items()], "item_id BIGINT, text STRING")
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in docs.items()], "doc_id BIGINT, text STRING").repartition(8)
    found = {(r.doc_id, r.item_id) for r in leaks(df, its).collect()}
    cases = [(d, k, rate) for d, (k, kept, rate) in wanted.items() if kept >= 0.5]
    for rate in (0, 0.1, 0.2, 0.3, 0.4):
        of_rate = [(d, k) for d, k, r in cases if r == rate]
        assert len(of_rate) > 100 and sum(c in found for c in of_rate) >= 0.95 * len(of_rate), rate
    assert {(d, k) for d, k in found if wanted.get(d, (None,))[0] != k} == set()
    assert found == {(r.doc_id, r.item_id) for r in leaks(df, its, block_chars=4_000).collect()}


def test_regular_changes_short_items_and_long_texts(spark):
    rng = np.random.default_rng(22)
    item, fill = _text(rng, 80), [f"other{i}" for i in range(90)]
    short = {4: _text(rng, 4), 5: _text(rng, 6), 6: _text(rng, 7)}
    every = lambda k: ["changed" if i % k == k - 1 else w for i, w in enumerate(item)]
    texts = {
        1: item, 2: item[:30] + fill[:17] + item[30:50] + fill[:17] + item[50:], 3: every(4), 4: every(3), 5: every(2), 6: fill + short[5] + fill, 7: fill + short[4] + fill,
        8: fill + short[4][:3] + fill, 9: short[5][:5], 10: short[6][:3], 11: item[:40] + fill[:15] + item[70:], 12: ["word"] * 50_000 + item + _text(rng, 100) * 500,
    }
    its = spark.createDataFrame([(1, " ".join(item))] + [(k, " ".join(t)) for k, t in short.items()] + [(9, "word " * 60)], "item_id BIGINT, text STRING")
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id BIGINT, text STRING")
    found = {(r.doc_id, r.item_id) for r in leaks(df, its).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 5), (7, 4), (9, 5), (11, 1), (12, 1), (12, 9)}


def test_equal_documents_give_equal_rows(spark):
    rng = np.random.default_rng(23)
    item, fill = _text(rng, 60), [f"other{i}" for i in range(60)]
    text = " ".join(item[:20] + fill[:50] + item[20:40] + fill + item[:18] + fill[:40] + item[18:50])
    its = spark.createDataFrame([(1, " ".join(item))], "item_id BIGINT, text STRING")
    one = sorted(tuple(r)[2:] for r in leaks(spark.createDataFrame([(1, text)], "doc_id BIGINT, text STRING"), its).collect())
    many = sorted(tuple(r)[2:] for r in leaks(spark.createDataFrame([(1, text)] * 5 + [(None, text)] * 3, "doc_id BIGINT, text STRING").coalesce(1), its).collect())
    assert len(one) == 2 and many == sorted(one * 8)
