"""Evaluation passages in training text: broadcast n-grams of the test items, window scan, verification, removal.

1. *Fold.*  Items and training texts are folded, whole, to words: width, accents, case, invisible and look-alike
   characters fall away.  Words are hashed from the bytes of a whole batch at a time.
2. *Look up.*  The n-grams of an item are its pairs of words that stand one or two places apart, so that a word put in,
   left out or changed breaks few of them.  Of each item the rarer ``_SEEDS`` of its n-grams, by the number of items that
   hold them, go to every task as a sorted array of hashes.  Windows of a text, of twice an item's words or more and
   overlapping by half, that hold ``_SHARED`` of an item's n-grams in the item's order are candidates.  (Half of an item,
   word for word, always does: it has 0.49 of the n-grams, of which 0.3 at most are none of the rarer ones.)
3. *Verify.*  Candidates are aligned with their items word by word (local alignment with affine gaps, many candidates at
   a time).  The best stretch counts as a leak if it has the wanted words of the item in order.  What is left of the text
   on both sides is looked through again, so that every copy is listed.
4. *Remove* the spans, in the same scan, or the documents.

How rare an n-gram is, is counted over all items, so results do not depend on the blocks in which items are sent.  A
block is bounded: ``block_chars`` characters of items, hence half as many words at most, take 53 bytes a word and 16 MB
(230 MB by default, about 90 MB for ordinary words), which is checked.  Beyond one block, each has its own scan.
Equal items are sent once and the others dealt by their ids and texts, so that null and repeated ids fill no block.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.glyphs import _ALSO, _INVISIBLE, _SHAPES

#: Items of fewer words have no leaks.
LEAST_ITEM = 4
_WORD = re.compile(r"[^\W_]+")
_NOT_ASCII = re.compile("[^\x00-\x7f]+")
#: The part of an item's n-grams that is looked up, and the part of all of them that a candidate holds.
_SEEDS, _SHARED = 0.7, 0.15
#: Scores in parts of a word: a word in common, a changed word, opening a gap, each word of a gap in the text and in the item.
_MATCH, _CHANGED, _OPEN, _TEXT_GAP, _ITEM_GAP = 32, 16, 32, 3, 4
#: Words of the least piece that is joined to others, and words of a hole in the text for each word of the pieces around it.
_PIECE, _HOLE = 8, 4
#: The least score of a stretch for each word wanted.  Where every other word of an item is changed, it is half a word.
_DENSE = 0.4
#: Rarity is counted in this many buckets of n-gram hashes.
_BUCKETS = 20
_CHUNK = 1 << 20
_CELLS = 1 << 15

_P = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_PAIR = np.uint64(0xFF51AFD7ED558CCD)


class _Fold(dict):
    """Code point -> what is left of it when only words matter; filled as characters come up."""

    def __missing__(self, code: int) -> str:
        out = []
        for c in unicodedata.normalize("NFKD", chr(code)):
            if _INVISIBLE.fullmatch(c) or unicodedata.combining(c):
                continue
            c = _SHAPES[c].get("LATIN", c) if c in _SHAPES else _ALSO.get(c, c)
            out.append(c.casefold() if c.isalnum() else " ")
        self[code] = "".join(out)
        return self[code]


_FOLD = _Fold()


def _folded(text: str) -> str:
    """``text`` with its characters beyond ASCII folded; those of no word are spaces."""
    return text if text.isascii() else _NOT_ASCII.sub(lambda m: m[0].translate(_FOLD), text)


def words(text: str) -> list[str]:
    """The folded words of a whole text."""
    return _WORD.findall(_folded(text).casefold())


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where each word of ``words(text)`` lies in the text itself."""
    folded, at = [], []
    for i, c in enumerate(text):
        piece = c.casefold() if c.isascii() else _FOLD[ord(c)]
        folded.append(piece)
        at.extend([i] * len(piece))
    return [(at[m.start()], at[m.end() - 1] + 1) for m in _WORD.finditer("".join(folded))]


# Byte -> lower-case byte of a word, 0 between words; beyond ASCII, folded texts hold letters and digits only.
_BYTES = np.array([b if b > 0x7F else ord(chr(b).lower()) if chr(b).isalnum() else 0 for b in range(256)], np.uint8)


class _Powers:
    """Powers of an odd number modulo 2**64 and their inverses, as many as were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, p, np.uint64)]) for p in (_P, pow(_P, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, start): the 64-bit hashes of the words of all texts; text t has hashes[start[t]:start[t + 1]].

    A word's hash is a polynomial of its bytes, taken from running sums over the bytes of all texts.
    """
    pieces = [_folded(t).encode("utf-8", "replace") for t in texts]
    raw = _BYTES[np.frombuffer(b" ".join([*pieces, b""]), np.uint8)]
    edges = np.flatnonzero(np.diff(raw != 0, prepend=False))
    first, last = edges[::2], edges[1::2]
    up, down = _POWERS.get(max(_CHUNK, len(raw)))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(raw * up[: len(raw)], out=sums[1:])
    h = (sums[last] - sums[first]) * down[first]
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h ^= h >> np.uint64(29)
    return h, np.searchsorted(first, np.r_[0, np.cumsum([len(p) + 1 for p in pieces])])


def _pairs(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of words ``h`` of texts ``doc``, and the place of their first words."""
    out = []
    for apart in (1, 2):
        at = np.flatnonzero(doc[apart:] == doc[:-apart])
        out.append((h[at] * _PAIR + h[at + apart], at))
    return np.concatenate([g for g, _ in out]), np.concatenate([at for _, at in out])


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - _BUCKETS)).astype(np.int64)


def _held(grams: np.ndarray) -> np.ndarray:
    """By bucket, how many of the n-grams fall into it."""
    return np.bincount(_bucket(grams), minlength=1 << _BUCKETS)


def _distinct_grams(h: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams, owner, n_places, places): the distinct n-grams of each item of ``LEAST_ITEM`` words or more, with all their places."""
    n_words = np.diff(start)
    owner = np.repeat(np.arange(len(n_words)), n_words)
    grams, at = _pairs(h, owner)
    owner, place = owner[at], at - start[owner[at]]
    order = np.lexsort((place, grams, owner))
    order = order[n_words[owner[order]] >= LEAST_ITEM]
    grams, owner, place = grams[order], owner[order], place[order]
    entry = _starts(owner, grams)
    return grams[entry[:-1]], owner[entry[:-1]], np.diff(entry), place


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination begins in sorted columns, and the end."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.r_[np.flatnonzero(new), n]


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from first[k] on, size[k] of them, for every k."""
    return np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())


class ItemIndex:
    """The seeds and words of a block of test items, in arrays.  ``holders``: by bucket, how many items hold its n-grams."""

    def __init__(self, items: list[tuple[int, str]], times: list[int] | None = None, part: float = 0.5, least_words: int = 5, holders: np.ndarray | None = None):
        self.item_ids = [i for i, _ in items]
        self.times = times or [1] * len(items)  # how often each is listed
        self.words, self.start = hashed_words([t for _, t in items])
        self.n_words = np.diff(self.start)
        self.wanted = np.maximum(self.n_words * part, np.minimum(self.n_words, least_words))
        self.shift = np.ceil(np.log2(np.maximum(self.n_words, 1) * 2)).astype(np.int64)
        grams, owner, n_places, place = _distinct_grams(self.words, self.start)
        entry = np.cumsum(n_places) - n_places
        n_grams = np.bincount(owner, minlength=len(items))
        self.need = np.maximum(1, np.ceil(n_grams * _SHARED)).astype(np.int64)
        holders = _held(grams) if holders is None else holders
        order = np.lexsort((grams, holders[_bucket(grams)], owner))  # the rarest of each item first
        rank = np.arange(len(order)) - (np.cumsum(n_grams) - n_grams)[owner]
        order = order[rank < np.ceil(n_grams * _SEEDS)[owner]]
        order = order[np.argsort(grams[order], kind="stable")]
        self.owner = owner[order].astype(np.int32)
        self.place = place[_spread(entry[order], n_places[order])].astype(np.int32)
        self.places = np.r_[0, np.cumsum(n_places[order])]
        self.first = _starts(grams[order])
        self.seeds = grams[order][self.first[:-1]]
        self.bits = min(24, max(12, int(np.ceil(np.log2(16 * len(self.seeds) + 1)))))
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[self.seeds >> np.uint64(64 - self.bits)] = True

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))

    def item_words(self, item: int) -> np.ndarray:
        return self.words[self.start[item] : self.start[item + 1]]

    def candidates(self, h: np.ndarray, start: np.ndarray) -> Iterator[_Candidate]:
        """Stretches of texts that hold enough n-grams of an item in its order."""
        n_items, n_docs = len(self.item_ids), len(start) - 1
        doc = np.repeat(np.arange(n_docs), np.diff(start))
        grams, at = _pairs(h, doc)
        some = np.flatnonzero(self.maybe[grams >> np.uint64(64 - self.bits)])
        if not len(some) or not len(self.seeds):
            return
        grams, at = grams[some], at[some]
        found = np.minimum(np.searchsorted(self.seeds, grams), len(self.seeds) - 1)
        hit = self.seeds[found] == grams
        found, at = found[hit], at[hit]
        size = self.first[found + 1] - self.first[found]
        entry = _spread(self.first[found], size)
        pair = np.repeat(doc[at] * n_items, size) + self.owner[entry]
        if n_docs * n_items <= 1 << 23:
            enough = np.bincount(pair, minlength=n_docs * n_items) >= np.tile(self.need, n_docs)
            kept = np.flatnonzero(enough[pair])
        else:
            _, inverse, counts = np.unique(pair, return_inverse=True, return_counts=True)
            kept = np.flatnonzero(counts[inverse] >= self.need[pair % n_items])
        pair, entry, at = pair[kept], entry[kept], np.repeat(at, size)[kept]
        order = np.lexsort((at, pair))
        pair, entry, at = pair[order], entry[order], at[order]
        # a window's width away from a hit there must be as many others as a candidate needs
        ahead = np.arange(len(pair)) + self.need[pair % n_items] - 1
        near = ahead < len(pair)
        ahead[~near] = 0
        near &= (pair[ahead] == pair) & (at[ahead] - at < 1 << self.shift[pair % n_items])
        group = _starts(pair)
        dense = np.logical_or.reduceat(near, group[:-1]) if len(pair) else near
        for a, b in zip(group[:-1][dense].tolist(), group[1:][dense].tolist()):
            d, item = divmod(int(pair[a]), n_items)
            hits = _Hits((at[a:b] - start[d]).tolist(), entry[a:b])
            for low, high in self._windows(hits, item, int(start[d + 1] - start[d])):
                for first, end in _cut(low, high, 1 << int(self.shift[item]), hits.place):
                    yield _Candidate(d, item, first, h[start[d] + first : start[d] + end])

    def _windows(self, hits: _Hits, item: int, n_text: int) -> list[tuple[int, int]]:
        width = 1 << int(self.shift[item])
        out: list[tuple[int, int]] = []
        if n_text <= width:
            return [(0, n_text)] if self.enough(hits, item, 0, n_text) else []
        for low in range(hits.place[0] // width * width - width // 2, hits.place[-1] + 1, width // 2):
            if self.enough(hits, item, low, low + width):
                a, b = max(0, low - width // 2), min(n_text, low + width + width // 2)
                if out and a <= out[-1][1]:
                    out[-1] = (out[-1][0], b)
                else:
                    out.append((a, b))
        return out

    def enough(self, hits: _Hits, item: int, low: int, high: int) -> bool:
        """Whether a stretch of a text holds enough different n-grams of an item, in order of the text and of the item."""
        need = int(self.need[item])
        a, b = bisect_left(hits.place, low), bisect_left(hits.place, high)
        if b - a < need:
            return False
        entries = hits.entry[a:b]
        if len(set(entries.tolist())) < need:
            return False
        size = self.places[entries + 1] - self.places[entries]
        if size.sum() > 4 * len(entries) + 1000:
            return True  # an item that repeats itself; left to the alignment
        ends: list[int] = []  # the least place at which a row of each length can end
        for i in self.place[_spread(self.places[entries], size)].tolist():
            at = bisect_right(ends, i)
            if at == len(ends):
                ends.append(i)
                if len(ends) >= need:
                    return True
            else:
                ends[at] = i
        return False


class _Hits(NamedTuple):
    """Where in a text n-grams of an item were found, in order, and which."""

    place: list[int]
    entry: np.ndarray


class _Candidate(NamedTuple):
    """A stretch of text that an item may have leaked into: its words from place ``low`` on."""

    text: object
    item: int
    low: int
    words: np.ndarray


def _cut(low: int, high: int, width: int, hits: list[int]) -> Iterator[tuple[int, int]]:
    """A long stretch of text in parts of 3 to 4 widths, cut where there are fewest n-grams of the item around.

    A text full of copies then takes a few rounds of alignment, not one for each copy.
    """
    while high - low > 4 * width:
        a, b = bisect_left(hits, low + 3 * width), bisect_left(hits, low + 4 * width)
        places = np.array([low + 3 * width, *hits[a:b], low + 4 * width])
        widest = int(np.argmax(np.diff(places)))
        cut = int(places[widest] + places[widest + 1]) // 2
        yield low, cut
        low = cut
    yield low, high


def _best(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(score, words, last, item_last) of the best local alignment of each text with its item, and where its last word is.

    Scores and numbers of words share an integer, so that of equal scores the one with more words counts.  Words are
    compared by 32 bits of their hashes; candidates agree by 64 bits already.
    """
    n, length, lanes = max(map(len, items)), max(map(len, texts)), len(items)
    kind, shift = (np.int32, 16) if n * _MATCH < 1 << 14 else (np.int64, 32)
    unit = 1 << shift
    item, text = np.zeros((n, lanes), np.uint32), np.ones((length, lanes), np.uint32)
    for j, (i, t) in enumerate(zip(items, texts)):
        item[: len(i), j], text[: len(t), j] = i.astype(np.uint32), t.astype(np.uint32)
    gain, changed, opened = kind((_MATCH + _CHANGED) * unit + 1), kind(_CHANGED * unit), kind(_OPEN * unit)
    slope = (np.arange(n) * _ITEM_GAP * unit).astype(kind)[:, None]
    steps = [1 << p for p in range((n - 1).bit_length())]
    held, gap = np.zeros((n + 1, lanes), kind), np.full((n, lanes), -opened, kind)
    now, more, other, same = *(np.empty((n, lanes), kind) for _ in range(3)), np.empty((n, lanes), bool)
    best, last, item_last = np.zeros(lanes, kind), np.full(lanes, -1), np.full(lanes, -1)
    for k in range(length):
        np.equal(item, text[k], out=same)
        np.multiply(same, gain, out=now)
        now += held[:-1]
        now -= changed
        np.subtract(held[1:], opened, out=more)
        np.maximum(gap, more, out=gap)
        gap -= kind(_TEXT_GAP * unit)
        np.maximum(now, gap, out=now)
        np.maximum(now, kind(0), out=now)
        np.add(now, slope, out=more)
        for step in steps:  # running maximum
            np.maximum(more[step:], more[:-step], out=other[step:])
            other[:step] = more[:step]
            more, other = other, more
        more -= slope
        more -= opened + kind(_ITEM_GAP * unit)
        np.maximum(now[1:], more[:-1], out=held[2:])
        held[1] = now[0]
        top = held.max(axis=0)
        better = np.flatnonzero(top > best)
        if len(better):
            best[better], last[better] = top[better], k
            item_last[better] = held[:, better].argmax(axis=0) - 1
    return best >> shift, best & (unit - 1), last, item_last


def _lanes(jobs: list[_Candidate], n_words: np.ndarray) -> Iterator[list[_Candidate]]:
    """Candidates of about the same length together, in bounded matrices."""
    jobs = sorted(jobs, key=lambda j: len(j.words), reverse=True)
    while jobs:
        take = max(1, min(_CELLS // max(1, *(int(n_words[j.item]) for j in jobs)), _CHUNK // len(jobs[0].words))) if len(jobs) > 1 else 1
        yield jobs[:take]
        jobs = jobs[take:]


class _Piece(NamedTuple):
    """Where a piece of an item begins and ends in the text, its words, where it begins and ends in the item, its score."""

    first: int
    last: int
    words: int
    i_first: int
    i_last: int
    score: float  # in words, less what was changed and passed over


def stretches(index: ItemIndex, jobs: list[_Candidate]) -> list[tuple[object, int, int, int, int]]:
    """(text, item, words, first, last) of all stretches of the candidates that reproduce the wanted words of an item.

    Pieces are taken off the candidates, the best first, until none of ``_PIECE`` words is left; then they are joined.
    """
    pieces: dict[tuple[object, int], list[_Piece]] = {}
    least = np.minimum(_PIECE, index.wanted)
    while jobs:
        rest: list[_Candidate] = []
        for some in _lanes(jobs, index.n_words):
            score, n, last, i_last = _best([index.item_words(j.item) for j in some], [j.words for j in some])
            found = np.flatnonzero(2 * score >= _MATCH * least[[j.item for j in some]])
            if not len(found):
                continue
            some = [some[k] for k in found.tolist()]
            score, n, last, i_last = (x[found] for x in (score, n, last, i_last))
            _, _, back, i_back = _best([index.item_words(j.item)[::-1] for j in some], [j.words[: k + 1][::-1] for j, k in zip(some, last.tolist())])
            for j, s, n_found, k, i, r, ir in zip(some, *(x.tolist() for x in (score, n, last, i_last, back, i_back))):
                if n_found >= least[j.item]:
                    piece = _Piece(j.low + k - r, j.low + k, n_found, int(index.n_words[j.item]) - 1 - ir, i, s / _MATCH)
                    pieces.setdefault((j.text, j.item), []).append(piece)
                for a, b in ((0, k - r), (k + 1, len(j.words))):
                    if b - a >= least[j.item]:
                        rest.append(j._replace(low=j.low + a, words=j.words[a:b]))
        jobs = rest
    out = []
    for (text, item), found in pieces.items():
        while chains := _joined(sorted(found), float(index.wanted[item]), int(index.n_words[item])):
            dense = _DENSE * float(index.wanted[item])
            out += [(text, item, n, chain[0].first, chain[-1].last) for chain, n in chains if sum(p.score for p in chain) >= dense]
            used = {p for chain, _ in chains for p in chain}
            found = [p for p in found if p not in used]
    return out


def _joined(pieces: list[_Piece], wanted: float, n_item: int) -> list[tuple[list[_Piece], int]]:
    """Rows of pieces in the item's order that have the wanted words, the longest first, with their numbers of words.

    A hole in the text may have ``_HOLE`` times the words of the pieces so far and the next one, a hole in the item once
    as many.  Pieces may share a few words of the item, which count once.
    """
    best: list[tuple[int, int]] = []  # words and the piece before
    for q, (first, _, n, i_first, i_last, _) in enumerate(pieces):
        top = (n, -1)
        for p in range(q - 1, -1, -1):
            before = pieces[p]
            hole, i_hole = first - before.last - 1, i_first - before.i_last - 1
            if hole > _HOLE * n_item:
                break
            enough = best[p][0] + n
            if i_last > before.i_last and -_PIECE < i_hole <= enough and hole <= _HOLE * enough:
                top = max(top, (enough + min(0, i_hole), p))
        best.append(top)
    out, used = [], set()
    for q in sorted(range(len(best)), key=lambda q: -best[q][0]):
        if best[q][0] < wanted:
            break
        chain, at = [], q
        while at >= 0 and at not in used:
            chain.append(at)
            at = best[at][1]
        if at < 0:  # others are joined anew, without the pieces that are used
            used.update(chain)
            out.append(([pieces[k] for k in reversed(chain)], best[q][0]))
    return out


_SCHEMA = "doc_id BIGINT, text_hash BIGINT, item_id BIGINT, n_matched INT, n_words INT, coverage DOUBLE, first_word INT, last_word INT"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32())
_NAMES = tuple(c.split()[0] for c in _SCHEMA.split(", "))


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Whole texts in groups of a bounded number of characters, with the place of the first."""
    at = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > _CHUNK:
            yield at, texts[at:k]
            at, size = k, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, texts[at:]


def _candidates(index: ItemIndex, texts: list[str]) -> Iterator[_Candidate]:
    """The candidates of all texts; ``text`` is a text's place in the list."""
    for at, some in _chunks(texts):
        for c in index.candidates(*hashed_words(some)):
            yield c._replace(text=at + c.text, words=c.words.copy())


def _scan(index: ItemIndex, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: list[_Candidate] = []

    def flush() -> Iterator[pa.RecordBatch]:
        rows = []
        for (_, doc_id, text_hash), item, n, first, last in stretches(index, waiting):
            n_item = int(index.n_words[item])
            rows += [(doc_id, text_hash, index.item_ids[item], n, n_item, n / n_item, first, last)] * index.times[item]
        waiting.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=_NAMES)

    size = 0
    for k, batch in enumerate(batches):
        doc_ids, texts, text_hashes = (c.to_pylist() for c in batch.columns)
        for c in _candidates(index, texts):
            waiting.append(c._replace(text=((k, c.text), doc_ids[c.text], text_hashes[c.text])))  # equal rows are told apart
            size += len(c.words)
            if len(waiting) >= 256 or size >= _CHUNK:
                yield from flush()
                size = 0
    yield from flush()


def _listed(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(item_id, text, times): the items that have a text, equal ones once."""
    listed = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where(F.length("text") > 0)
    return listed.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("times"))


def _holders(listed: DataFrame) -> np.ndarray:
    """By bucket, how many items hold its n-grams: 2**20 numbers, whatever the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << _BUCKETS, np.int64)
        for batch in batches:
            for _, some in _chunks(batch.column(0).to_pylist()):
                counts += _held(_distinct_grams(*hashed_words(some))[0])
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["bucket", "n"])

    table = listed.select("text").mapInArrow(run, "bucket BIGINT, n BIGINT").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << _BUCKETS, np.int64)
    out[table["bucket"].to_numpy(np.int64)] = table["n"].to_numpy(np.int64)
    return out


def _indexes(items: DataFrame, item_id: str, item_text: str, part: float, least_words: int, block_chars: int) -> Iterator[ItemIndex]:
    """The items in blocks of about ``block_chars`` characters."""
    listed = _listed(items, item_id, item_text)
    n_chars = listed.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    blocks = math.ceil(n_chars / block_chars)
    holders = _holders(listed) if blocks > 1 else None
    for block in range(blocks):
        chosen = listed if blocks == 1 else listed.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = sorted(chosen.collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))  # one block
        index = ItemIndex([(r[0], r[1]) for r in rows], [r[2] for r in rows], part, least_words, holders)
        if index.nbytes > 53 * len(index.words) + 60 * len(rows) + (20 << 20):
            raise MemoryError(f"a block of items takes {index.nbytes} bytes")
        yield index


def _texts(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def leaks(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    *,
    part: float = 0.5,
    least_words: int = 5,
    block_chars: int = 8_000_000,
) -> DataFrame:
    """(doc_id, text_hash, item_id, n_matched, n_words, coverage, first_word, last_word): the leaked items of every document.

    A leak is one stretch that reproduces at least ``part`` of the item's words, in order and but for their surface
    unchanged, and at least ``least_words`` of them (all of an item that has fewer).  It is made of pieces.  Within a
    piece, a changed word costs half a word, a gap one word, 3/32 for each word put in and 1/8 for each left out, and the
    piece goes on as long as what follows outweighs that.  Pieces of 8 words or more, in the item's order, are joined over
    holes of up to 4 times their words.  What is left of a leak's words after these costs is 0.4 of the wanted words at
    least, so that stock phrases strung out over a long text are none; every other word of an item still is one.
    ``first_word`` and ``last_word`` count the folded words of the document; ``text_hash`` tells texts of one id apart.
    Null and empty texts and items have no leaks, nor have items of fewer than 4 words.  Equal documents or items give a
    row each, null ids included; an item that a document holds several times has a row for each stretch.
    """
    spark = documents.sparkSession
    narrow = _texts(documents, doc_id, text).where(F.length("text") > 0).withColumn("text_hash", F.xxhash64("text"))
    result = None
    for index in _indexes(items, item_id, item_text, part, least_words, block_chars):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            yield from _scan(sent.value, batches)

        found = narrow.mapInArrow(run, _SCHEMA)
        result = found if result is None else result.unionByName(found)
    return spark.createDataFrame([], _SCHEMA) if result is None else result


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    places = word_spans(text)
    kept, at = [], 0
    for first, last in sorted(spans):
        a, b = places[first][0], places[last][1]
        if b > at:
            kept.append(text[at : max(a, at)])
            at = b
    return "".join([*kept, text[at:]])


def scrub(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    *,
    part: float = 0.5,
    least_words: int = 5,
    block_chars: int = 8_000_000,
) -> DataFrame:
    """(doc_id, text): ``documents`` without their leaks, found as by ``leaks`` and removed in the same scan.

    Nothing is shuffled while the items fit into one block; beyond it, ``leaks`` and ``scrubbed`` are combined.
    """
    indexes = list(_indexes(items, item_id, item_text, part, least_words, block_chars)) if _blocks(items, item_text, block_chars) <= 1 else None
    narrow = _texts(documents, doc_id, text)
    if indexes is None:
        found = leaks(documents, items, doc_id, text, item_id, item_text, part=part, least_words=least_words, block_chars=block_chars)
        return scrubbed(documents, found, doc_id, text)
    if not indexes:
        return narrow
    sent = documents.sparkSession.sparkContext.broadcast(indexes[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            texts = batch["text"].to_pylist()
            spans: dict[int, list[tuple[int, int]]] = {}
            for k, _, _, first, last in stretches(index, list(_candidates(index, [t or "" for t in texts]))):
                spans.setdefault(k, []).append((first, last))
            for k, found in spans.items():
                texts[k] = _without(texts[k], found)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return narrow.mapInArrow(run, "doc_id BIGINT, text STRING")


def _blocks(items: DataFrame, item_text: str, block_chars: int) -> int:
    return math.ceil((items.agg(F.sum(F.length(F.col(item_text).cast("string")).cast("long"))).first()[0] or 0) / block_chars)


def scrubbed(documents: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text", *, whole: bool = False) -> DataFrame:
    """(doc_id, text): ``documents`` without the leaked spans, or without the documents that have any (``whole``).

    ``found`` is the result of ``leaks`` on the same documents.  Documents without leaks, null texts among them, stay as
    they are.  With ``whole``, all documents of an id that has leaks go; of those without an id, the ones whose text has.
    """
    narrow = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    if whole:
        by_text = F.when(F.col("doc_id").isNull(), F.col("text_hash")).alias("by_text")
        gone = found.select(F.col("doc_id").alias("gone_id"), by_text.alias("gone_text")).distinct()
        hashed = narrow.withColumn("text_hash", F.xxhash64("text")).select("*", by_text)
        same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & F.col("by_text").eqNullSafe(F.col("gone_text"))
        return hashed.join(gone, same, "left_anti").select("doc_id", "text")
    spans = found.groupBy(F.col("doc_id").alias("span_id"), F.col("text_hash").alias("span_text")).agg(F.collect_set(F.struct("first_word", "last_word")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                t if s is None or t is None else _without(t, [(x["first_word"], x["last_word"]) for x in s])
                for t, s in zip(batch["text"].to_pylist(), batch["spans"].to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    same = F.col("doc_id").eqNullSafe(F.col("span_id")) & (F.col("text_hash") == F.col("span_text"))
    known = narrow.withColumn("text_hash", F.xxhash64("text")).join(spans, same, "left")
    return known.select("doc_id", "text", "spans").mapInArrow(run, "doc_id BIGINT, text STRING")
