"""Visually identical text with different characters: one consistent form for whole texts.

Two texts get the same form if, and only if, they differ in nothing but character width, the make-up of accents,
invisible characters, kinds of space, joined letter forms, or letters that look alike across Latin, Cyrillic, Greek,
Armenian, Cherokee and Lisu.
Case, digits, punctuation, superscripts and the presence of accents are kept.

Look-alikes are resolved by token, a run of letters.  Every letter belongs to a set of scripts: those in which its shape
has a letter.  The sets of a token's letters are intersected:

* one script is left: the token, however mixed its characters, is spelled in that script;
* several are left (a whole-script confusable): it is spelled in the script that prevails in the text;
* none is left (truly mixed): each ambiguous letter is spelled in the text's script, the others stay.

The prevailing script is counted over letters of one script only, so that swapping look-alikes cannot change a decision.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.durable import durable

SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "LISU")

# Letters of the same shape in Latin, Cyrillic and Greek (- where a script has none), without accents.
_SAME_SHAPE = """
A А Α
B В Β
C С Ϲ
E Е Ε
G Ԍ -
H Н Η
I І Ι
J Ј Ϳ
K К Κ
M М Μ
N - Ν
O О Ο
P Р Ρ
Q Ԛ -
S Ѕ -
T Т Τ
V Ѵ -
W Ԝ -
X Х Χ
Y У Υ
Z - Ζ
Æ Ӕ -
Ə Ә -
Ɵ Ө -
a а α
c с ϲ
d ԁ -
e е -
h һ -
i і ι
j ј ϳ
l ӏ -
o о ο
p р ρ
q ԛ -
s ѕ -
v ѵ ν
w ԝ -
x х -
y у -
æ ӕ -
ə ә -
ɵ ө -
- Г Γ
- П Π
- Ф Φ
"""
# Letters of further scripts that have the shape of a Latin one.
_TWINS = {
    "ARMENIAN": "gց hհ jյ nո oօ qզ uս LԼ OՕ SՏ UՍ",
    "CHEROKEE": "AᎪ BᏴ CᏟ DᎠ EᎬ GᏀ HᎻ JᎫ KᏦ LᏞ MᎷ PᏢ RᏒ SᏚ TᎢ VᏙ WᎳ YᎩ ZᏃ",
    "LISU": "Aꓮ Bꓐ Cꓚ Dꓓ Eꓰ Fꓝ Gꓖ Hꓧ Iꓲ Jꓙ Kꓗ Lꓡ Mꓟ Nꓠ Oꓳ Pꓑ Rꓣ Sꓢ Tꓔ Uꓴ Vꓦ Wꓪ Xꓫ Yꓬ Zꓜ",
}
# Other characters that are printed like a letter of the table.
_ALSO = {"ɡ": "g", "ɑ": "a", "Ү": "Y", "Ӏ": "I"}

_SHAPES: dict[str, dict[str, str]] = {}
for _line in _SAME_SHAPE.split("\n"):
    _spelled = {s: c for s, c in zip(SCRIPTS, _line.split()) if c != "-"}
    for _c in _spelled.values():
        _SHAPES[_c] = _spelled
for _name, _listed in _TWINS.items():
    for _latin, _c in _listed.split():
        _spelled = _SHAPES.setdefault(_latin, {"LATIN": _latin})
        _spelled[_name] = _c
        _SHAPES[_c] = _spelled
for _c, _like in _ALSO.items():
    _SHAPES[_c] = _SHAPES.get(_like, {"LATIN": _like})

# Code points that print nothing (default-ignorable ones).
_INVISIBLE = re.compile(
    "[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b\u200e\u200f\u202a-\u202e\u2060-\u206f"
    "\u3164\ufe00-\ufe0f\ufeff\uffa0\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff]"
    # joiners shape letters in Arabic and Indic scripts and join pictographs; elsewhere they print nothing
    "|(?<![\u0600-\u109f\u2600-\u27bf\U0001f000-\U0001faff\ufe0f])[\u200c\u200d]"
)
# Spaces other than U+0020.
_SPACES = re.compile("[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]")
_NOT_PLAIN = re.compile("[^\x00-\x7f]")
_OTHER_SCRIPT = re.compile("[\u0370-\u058f\u13a0-\u13ff\u1f00-\u1fff\ua4d0-\ua4ff]")
_IS = {s: regex.compile(rf"\p{{Script={s}}}") for s in SCRIPTS}
_TOKEN = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*")


def _fold_kind(c: str) -> bool:
    """Whether a character is another width or a joined form of what it decomposes to."""
    if c == "\u00b5":  # the micro sign is a mu
        return True
    tag = unicodedata.decomposition(c).partition(" ")[0]
    if tag in ("<wide>", "<narrow>", "<isolated>", "<initial>", "<medial>", "<final>"):
        return True
    return tag == "<compat>" and ("\ufb00" <= c <= "\ufb4f" or 0x132 <= ord(c) <= 0x133 or 0x1C4 <= ord(c) <= 0x1CC or 0x1F1 <= ord(c) <= 0x1F3)


@lru_cache(maxsize=1 << 16)
def _unfolded(c: str) -> str:
    return unicodedata.normalize("NFKC", c) if _fold_kind(c) else c


@lru_cache(maxsize=1 << 16)
def _script(c: str) -> str:
    return next((s for s, is_of in _IS.items() if is_of.match(c)), "OTHER")


@lru_cache(maxsize=1 << 16)
def _scripts(c: str) -> frozenset[str]:
    """The scripts in which the letter's shape is a letter."""
    shape = _SHAPES.get(c)
    return frozenset(shape) if shape else frozenset([_script(c)])


def _prevailing(text: str) -> str:
    """The script of most letters that belong to one script only; the first of SCRIPTS on a tie or without any."""
    counts: Counter[str] = Counter()
    for c, n in Counter(text).items():
        if c.isalpha() and len(own := _scripts(c)) == 1:
            counts[next(iter(own))] += n
    return max(SCRIPTS, key=lambda s: counts[s])


def _spell(token: str, prevailing: str) -> str:
    possible = None
    for c in token:
        if not "\u0300" <= c <= "\u036f":
            possible = _scripts(c) if possible is None else possible & _scripts(c)
    order = (prevailing, *SCRIPTS)
    if possible:
        script = next((s for s in order if s in possible), None)
        return token if script is None else "".join(_SHAPES[c].get(script, c) if c in _SHAPES else c for c in token)
    return "".join(next(_SHAPES[c][s] for s in order if s in _SHAPES[c]) if c in _SHAPES else c for c in token)


def consistent(text: str | None) -> str | None:
    """The consistent form of a whole text; null stays null, plain ASCII stays as it is."""
    if text is None or text.isascii():
        return text
    text = _SPACES.sub(" ", _INVISIBLE.sub("", text))
    text = _NOT_PLAIN.sub(lambda m: _unfolded(m[0]), text)
    if _OTHER_SCRIPT.search(text):
        text = unicodedata.normalize("NFD", text)
        prevailing = _prevailing(text)
        text = _TOKEN.sub(lambda m: _spell(m[0], prevailing), text)
    elif not text.isascii():
        for c, like in _ALSO.items():
            text = text.replace(c, like)
    return unicodedata.normalize("NFC", text)


def with_consistent_text(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text, consistent_text) for every row, whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [consistent(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forms, pa.string())], names=["doc_id", "text", "consistent_text"])

    narrow = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id BIGINT, text STRING, consistent_text STRING")


def lookalike_classes(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, class_id, text_id): documents of one class look the same, those of one text_id are equal.

    Both ids are 128-bit digests, of the consistent form and of the text; texts themselves are not shuffled.  Null texts
    belong to no class and are left out; empty texts look like texts of invisible characters only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda t: hashlib.blake2b(t.encode(), digest_size=16).digest()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            raw = [digest(t) for t in texts]
            forms = [consistent(t) for t in texts]
            classes = [r if f == t else digest(f) for r, f, t in zip(raw, forms, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(classes, pa.binary()), pa.array(raw, pa.binary())], names=["doc_id", "class_id", "text_id"])

    narrow = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    return narrow.mapInArrow(run, "doc_id BIGINT, class_id BINARY, text_id BINARY")


#: Rows up to which a table of class and text ids is broadcast (some 100 bytes each).
_SENT = 200_000


def _sent(df: DataFrame, n_rows: int) -> DataFrame:
    return F.broadcast(df) if n_rows <= _SENT else df


def lookalike_pairs(classes: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b): pairs of documents of one class whose texts are not equal, the smaller id first.

    Documents without an id are in no pair, nor are two of one id.  Classes are narrowed to those of several texts by
    their least and greatest text; the texts of those are paired, then replaced by their documents, so that copies of
    one text never meet each other.  The narrowed classes and the pairs of texts are counted, and broadcast only up to
    200,000 rows.
    """
    classes = durable(classes)  # three narrow columns; whole texts are read and folded once
    mixed = classes.groupBy("class_id").agg(F.min("text_id").alias("low"), F.max("text_id").alias("high")).where("low < high").select("class_id")
    mixed = durable(mixed)
    members = durable(classes.join(_sent(mixed, mixed.count()), "class_id", "left_semi"))
    texts = durable(members.select("class_id", "text_id").distinct())
    per_class = texts.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    n_texts, n_pairs = per_class.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.expr("n * (n - 1) DIV 2")), F.lit(0))).first()
    other = _sent(texts.withColumnRenamed("text_id", "other"), n_texts)
    pairs = texts.join(other, "class_id").where("text_id < other").select("class_id", F.col("text_id").alias("text_x"), F.col("other").alias("text_y"))
    x = members.select("class_id", F.col("text_id").alias("text_x"), F.col("doc_id").alias("doc_x"))
    y = members.select("class_id", F.col("text_id").alias("text_y"), F.col("doc_id").alias("doc_y"))
    joined = x.join(_sent(pairs, n_pairs), ["class_id", "text_x"]).join(y, ["class_id", "text_y"]).where("doc_x <> doc_y")
    return joined.select(F.least("doc_x", "doc_y").alias("doc_id_a"), F.greatest("doc_x", "doc_y").alias("doc_id_b")).distinct()


def lookalike_links(classes: DataFrame) -> DataFrame:
    """(doc_id, class_doc, n_links): for every document the least document of its class and its look-alikes' number.

    One row per document of ``classes``, null and repeated ids included.  A link leads to a row of another text of the
    class; equal texts are no links.  What grows with a class is two aggregates, so a class may hold any part of all rows.
    """
    classes = durable(classes)
    per_text = classes.groupBy("class_id", "text_id").agg(F.count(F.lit(1)).alias("n_text"), F.min("doc_id").alias("least"))
    per_class = per_text.groupBy("class_id").agg(F.sum("n_text").alias("n_class"), F.min("least").alias("class_doc"))
    figures = per_text.join(per_class, "class_id").select("class_id", "text_id", "class_doc", (F.col("n_class") - F.col("n_text")).alias("n_links"))
    return classes.join(figures, ["class_id", "text_id"]).select("doc_id", "class_doc", "n_links")
