"""Look-alike text: what must become equal, what must stay apart."""

import unicodedata
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrove.llm import glyphs
from lexigrove.llm.glyphs import consistent, lookalike_classes, lookalike_links, lookalike_pairs, with_consistent_text

SAME = [
    ("well-run", "ｗｅｌｌ－ｒｕｎ"), ("Kårvik", "Kårvik"), ("Kårvik", "Kа̊rvik"), ("office", "oﬃce"), ("abcd", "a​b­c⁠d﻿"), ("a b", "a b"), ("a b", "a b"),
    ("the register", "tһe reɡiѕter"), ("THE BANK", "TΗΕ BАNK"), ("се качва", "ce кaчвa"), ("ο δρόμος", "o δρόμoς"), ("Thúy", "Thúy"), ("q̣̇", "q̣̇"),
    ("µg", "μg"), ("paypal", "рауρаl"), ("topic", "τορіс".replace("τ", "t")), ("alpha", "αlphα"), ("LISTEN", "ꓡꓲꓢꓔꓰꓠ"), ("HELP", "ᎻᎬᏞᏢ"), ("soon", "sօօո"), ("Ǽ", "Ӕ́"),
    ("см. ace жук", "cм. асе жук"), ("", "​"), ("ёж", "ёж"), ("ёж", "ëж"), ("peace", "реасе"),
]
APART = ["km2", "km²", "Km2", "cafe", "café", "a-b", "a–b", "rn", "m", "0", "O", "1", "l", "I", "жук", "ab", "a b", "a\nb", "a  b", "½", "ａ1x", "ж", "x", "ﬃx", "Ꙁ", "ε", "e"]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look_same_form(a, b):
    assert consistent(a) == consistent(b)


def test_different_look_different_form():
    for a, b in combinations(APART, 2):
        assert consistent(a) != consistent(b), (a, b)


def test_scripts_are_spelled_consistently():
    assert consistent("pеасе treaty") == "peace treaty"  # mixed token
    assert consistent("Наша cocа ждёт") == "Наша соса ждёт"  # whole-script confusable in a Cyrillic text
    assert consistent("Наш Vezière ждёт") == "Наш Vezière ждёт"  # a foreign word stays
    assert unicodedata.is_normalized("NFC", consistent("Наша cocа ü"))
    assert consistent("נכון می‌شود क्‍ष 👩‍👧") == "נכון می‌شود क्‍ष 👩‍👧"
    assert consistent(None) is None


def test_table():
    for shape in glyphs._SHAPES.values():
        for script, c in shape.items():
            assert unicodedata.name(c).startswith(script) and unicodedata.normalize("NFC", c) == c


letters = st.text(st.sampled_from([*glyphs._SHAPES, *"dfkжиλψ -.2²é́​ ﬁＡ"]), max_size=20)


@settings(max_examples=300, deadline=None)
@given(letters, st.data())
def test_swaps_never_matter(text, data):
    def swapped(c):
        return data.draw(st.sampled_from(sorted({x for x, s in glyphs._SHAPES.items() if s is glyphs._SHAPES[c]}))) if c in glyphs._SHAPES else c

    other = "".join(swapped(c) + data.draw(st.sampled_from(["", "", "​"])) for c in text)
    assert consistent(other) == consistent(text) == consistent(consistent(text))


def test_pairs_against_brute_force(spark):
    texts = [t for p in SAME for t in p] + APART + [None, None, "The end.", "The end.", "The end.", "The end.", "Тhe end.", "x" * 200_000, "x" * 199_999 + "х"]
    df = spark.createDataFrame([(i * 3, t, "c", "i") for i, t in enumerate(texts)], "doc_id BIGINT, text STRING, class_id STRING, text_id STRING")
    none = spark.createDataFrame([(None, "Тhe end.", "c", "i"), (0, "ｗell-run", "c", "i")], df.schema)
    df = df.unionByName(none)
    got = sorted(tuple(r) for r in lookalike_pairs(lookalike_classes(df, "doc_id", "text")).collect())
    known = [(i * 3, t) for i, t in enumerate(texts) if t is not None]
    known.append((0, "ｗell-run"))  # another text of document 0: in pairs with others, never with document 0 itself
    assert got == sorted({(min(a, b), max(a, b)) for (a, x), (b, y) in combinations(known, 2) if a != b and x != y and consistent(x) == consistent(y)})
    class_of = lambda t: [k for k, x in known_rows if consistent(x) == consistent(t)]
    known_rows = [*known, (None, "Тhe end.")]
    links = sorted(lookalike_links(lookalike_classes(df, "doc_id", "text")).collect(), key=str)
    expected = [(k, min(x for x in class_of(t) if x is not None), sum(consistent(x) == consistent(t) and x != t for _, x in known_rows)) for k, t in known_rows]
    assert sorted(map(tuple, links), key=str) == sorted(expected, key=str)
    forms = {(r.doc_id, r.text, r.consistent_text) for r in with_consistent_text(df, "doc_id", "text").collect()}
    assert forms >= {(i * 3, t, consistent(t)) for i, t in enumerate(texts)}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id BIGINT, text STRING")
    assert lookalike_pairs(lookalike_classes(df, "doc_id", "text")).count() == lookalike_links(lookalike_classes(df, "doc_id", "text")).count() == 0
