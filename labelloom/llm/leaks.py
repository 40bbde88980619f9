"""Evaluation passages leaking into a corpus (problem 9).

Pigeonhole edit matching. A leak is a stretch of at least half of an item's letters that stands in a document with at
most one letter in twenty different. Each item is cut into blocks so short that any such stretch, whatever its length,
holds at least one whole block more than it may have errors, so that a block stands in the document exactly. One
automaton over the halves of the blocks of all items finds these hits in a pass over the document's letters; each hit
that has as many other halves near its diagonal as every leak must have is extended to both sides by Myers'
bit-parallel edit distance, with bit vectors as long as the item.

The items are a held-out set that does not grow; their size is checked before they are sent to the executors. The
corpus is read once and not shuffled before the last distinct.

Defined results: spacing, line breaks, punctuation, case and width do not count; null, empty and letterless texts and
items give no row; an item of fewer than ``MIN_LETTERS`` letters must stand exactly; repeated rows count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.session import spread

#: Items beyond this many letters in all are not sent to the executors.
MAX_LETTERS = 20_000_000
#: Letters per error; half of an item must stand in one piece.
PER_ERROR = 20
#: Shorter items must stand whole and exactly.
MIN_LETTERS = 8
#: Blocks of so many letters are looked for in halves.
HALVED = 8

_NO_LETTER = re.compile(r"[\W_]+")


def letters(text: str) -> str:
    """The letters and digits of ``text`` in one width and case."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _NO_LETTER.sub("", text.casefold())


def block_length(n: int) -> tuple[int, int]:
    """(least stretch, block length) of an item of ``n`` letters.

    A stretch of L letters may have L // PER_ERROR errors, so it must hold one whole block more than that wherever it
    starts. The longest block that gives every stretch from the least one to the whole item its blocks is taken.
    """
    if n < MIN_LETTERS:
        return n, n
    least = -(-n // 2)
    return least, min((length + 1) // (length // PER_ERROR + 2) for length in range(least, min(n, least + PER_ERROR) + 1))


def exact_parts(n: int, part: int) -> int:
    """The least number of parts of ``part`` letters that stand exactly in a leaked stretch of an item of ``n`` letters.

    (L + 1) // part - 1 whole parts stand in a stretch of L letters at worst, and each error spoils one of them at most.
    """
    if n < MIN_LETTERS:
        return 1
    return max(1, min((length + 1) // part - 1 - length // PER_ERROR for length in range(-(-n // 2), n + 1)))


class LeakFinder:
    """The automaton over the blocks of all items, long ones in halves.

    A hit is a block whose halves stand side by side. Before it is extended, the halves on nearly its diagonal are
    counted: in a leaked stretch stand at least ``exact_parts`` of them.
    """

    def __init__(self, items: list[tuple[int, str]]):
        self.items: dict[int, tuple[str, int, int, int]] = {}  # letters, least stretch, length of a part, parts a block
        self.needed: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        for item, text in items:
            t = letters(text or "")
            if not t:
                continue
            least, b = block_length(len(t))
            halves = 2 if b >= HALVED else 1
            part = b // halves
            self.items[item] = (t, least, part, halves)
            self.needed[item] = exact_parts(len(t), part)
            for at in range(0, len(t) - part + 1, part):
                word = t[at : at + part]
                if word in self.automaton:
                    self.automaton.get(word).append((item, at, part))
                else:
                    self.automaton.add_word(word, [(item, at, part)])
        self.any = len(self.automaton) > 0
        if self.any:
            self.automaton.make_automaton()

    def leaked(self, text: str | None) -> list[int]:
        """The items that ``text`` leaks."""
        if not text or not self.any:
            return []
        doc = letters(text)
        hits: dict[int, list[tuple[int, int]]] = {}
        for end, found in self.automaton.iter(doc):
            for item, at, part in found:
                hits.setdefault(item, []).append((end - part + 1, at))
        return [item for item, h in hits.items() if len(h) >= self.needed[item] and self._verified(doc, item, h)]

    def _verified(self, doc: str, item: int, hits: list[tuple[int, int]]) -> bool:
        t, least, part, halves = self.items[item]
        b = part * halves
        covered: dict[int, int] = {}  # diagonal -> document place up to which its stretch was tried
        near = self._in_line(hits, self.needed[item], len(t) // PER_ERROR)
        there = set(near)
        for d, at in near:
            if at % b or halves == 2 and (d + part, at + part) not in there:
                continue
            if covered.get(d - at, -1) >= d:
                continue
            leaks, right = self._extended(doc, t, d, at, b, least)
            if leaks:
                return True
            covered[d - at] = d + right
        return False

    @staticmethod
    def _in_line(hits: list[tuple[int, int]], needed: int, spread: int) -> list[tuple[int, int]]:
        """The hits that share a band of diagonals, as wide as insertions and deletions can make it, with enough others."""
        hits = sorted(hits, key=lambda h: h[0] - h[1])
        keep = [False] * len(hits)
        kept = 0  # hits before this one are marked as far as they ever will be
        seen: dict[int, int] = {}  # item place -> its hits in the present band
        low = 0
        for high, (d, at) in enumerate(hits):
            seen[at] = seen.get(at, 0) + 1
            while d - at - (hits[low][0] - hits[low][1]) > spread:
                k = hits[low][1]
                seen[k] -= 1
                if not seen[k]:
                    del seen[k]
                low += 1
            if len(seen) >= needed:
                for k in range(max(low, kept), high + 1):
                    keep[k] = True
                kept = high + 1
        return sorted(h for h, k in zip(hits, keep) if k)

    def _extended(self, doc: str, t: str, d: int, at: int, b: int, least: int) -> tuple[bool, int]:
        """Whether the block at ``at``, found at ``d``, lies in a leaked stretch; exact letters to its right."""
        most = len(t) // PER_ERROR
        right = myers_reach(t[at + b :], doc[d + b : d + b + len(t) - at - b + most], most)
        left = myers_reach(t[:at][::-1], doc[max(0, d - at - most) : d][::-1], most)
        # value of a side: errors minus the errors its letters allow; best of all reaches at least r
        gain = [e - r / PER_ERROR for r, e in enumerate(right)]
        best = gain[:]
        for r in range(len(best) - 2, -1, -1):
            best[r] = min(best[r], best[r + 1])
        for n, e in enumerate(left):
            need = max(0, least - b - n)
            if need < len(best) and e - n / PER_ERROR + best[need] <= b / PER_ERROR + 1e-9:
                return True, 0
        exact = 0
        while exact + 1 < len(right) and right[exact + 1] == 0:
            exact += 1
        return False, exact


def myers_reach(pattern: str, text: str, most: int) -> list[int]:
    """For each n the least edits between the first n letters of ``pattern`` and some beginning of ``text``.

    Bit-parallel columns over ``text`` (both ends anchored at the start); stops once every value exceeds ``most``, so
    the list covers the letters that can be reached.
    """
    m = len(pattern)
    out = [0]
    if not m:
        return out
    peq: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        peq[ch] = peq.get(ch, 0) | (1 << i)
    full = (1 << m) - 1
    vp, vn = full, 0
    least = list(range(1, m + 1))  # column 0: n deletions
    for j, ch in enumerate(text, 1):
        eq = peq.get(ch, 0)
        x = eq | vn
        d0 = ((((eq & vp) + vp) ^ vp) | x) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = vp & d0
        hp = ((hp << 1) | 1) & full  # row 0 grows with every letter of the text
        hn = (hn << 1) & full
        vp = (hn | ~(d0 | hp)) & full
        vn = hp & d0
        # a value of at most `most` lies within `most` rows of the diagonal: D[i] = j + vertical differences above
        low = max(0, j - 1 - most)
        if low >= m:
            break
        mask = (1 << low) - 1
        value = j + (vp & mask).bit_count() - (vn & mask).bit_count()
        plus, minus, top = vp >> low, vn >> low, most + 1
        for i in range(low, min(m, j + most)):
            value += (plus & 1) - (minus & 1)
            plus >>= 1
            minus >>= 1
            if value < least[i]:
                least[i] = value
            if value < top:
                top = value
        if top > most:
            break
    for v in least:
        if v > most:
            break
        out.append(v)
    return out


_FINDERS: dict[tuple, LeakFinder] = {}


def _finder(items: tuple) -> LeakFinder:
    if items not in _FINDERS:
        _FINDERS.clear()
        _FINDERS[items] = LeakFinder(list(items))
    return _FINDERS[items]


def leaking_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): each document with each evaluation item that it leaks."""
    known = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    size = known.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > MAX_LETTERS:
        raise ValueError(f"the evaluation items hold {size} letters; {MAX_LETTERS} can be sent to the executors")
    frozen = tuple(sorted((r[0], r[1]) for r in known.toLocalIterator()))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(frozen)
        for b in batches:
            ids, found = [], []
            for k, text in zip(b.column(0).to_pylist(), b.column(1)):
                for item in finder.leaked(text.as_py()):
                    ids.append(k)
                    found.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], names=["doc_id", "item_id"])

    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    return spread(texts).mapInArrow(find, "doc_id long, item_id long").distinct()
