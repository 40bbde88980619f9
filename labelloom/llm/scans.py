"""Noise in text from scanned pages (problem 5).

Misread words: a vocabulary with counts of words and of neighbouring symbols is gathered over the whole corpus and stays
distributed. A suspicious token is run through a Levenshtein automaton over edits between characters of like shape,
intersected with the trie of the vocabulary, which retrieves every candidate; candidates are ranked by their counts and
by how well they fit between their neighbours, and a token counts as misread if a candidate is so much better supported
than the token itself. Page furniture is found by repetition over the pages of a job; then furniture is removed from
pages and blocks, broken words are joined and lines reflowed to paragraphs that run over the pages of a job.

Two tiers keep retrieval complete at any size. Words and neighbours with a share of at least ``LEAST_SHARE`` of all
symbols, at most 1 / ``LEAST_SHARE`` of them, are broadcast; with the knowledge that any other count is below that share
they decide most tokens for certain. Every token that they cannot decide is joined with the whole counts: words with
equal ``word_key`` are all that shape edits can reach, so the vocabulary is cut by this key and the trie of each part is
walked where the token meets it. Lines are never grouped by job, only edge lines (first and last two of a page) are
counted and one short row for each part of a page put in order.

Defined results: null and blank texts carry no noise; a page alone repeats nothing; lines without a job, page or line
number have no furniture; repeated rows of an id count once; texts of any length are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.operators.skew import salted_join
from labelloom.session import checkpointed

#: Words and neighbours of a smaller share are not broadcast, but joined where they are needed.
LEAST_SHARE = 5e-6
#: What occurs once may be the misreading itself and supports nothing.
LEAST_COUNT = 2
#: A correction must fit so many times better than what was read.
TIMES = 6
#: Lines of a page that are joined at once; parts of a page are joined like pages.
PART_LINES = 5_000
#: Share of a job's pages, and number of them, that repeat a running header.
HEADER_SHARE, HEADER_PAGES = 0.6, 2
#: Shape edits that candidates may have. Other edits make no character like another in shape, so they are none.
MOST_SHAPE = 4

#: What is read for what, by shape ("what stands there" > "what is read").
LATIN_SHAPES = (
    "e>c i>1 o>0 t>f l>1 1>l g>9 2>Z s>5 d>cl h>li m>rn b>6 8>B 5>S w>vv 0>O 1>I l>I I>l i>l 0>o O>0 S>5 B>8 Z>2 q>9 "
    "rn>m cl>d li>h vv>w 6>b 9>g d>c1 h>1i h>l1 u>ii n>ri 4>A 7>T g>q 3>8"
).split()
CJK_SHAPES = (
    "条杀 克兄 版扳 标栎 品晶 日曰 装裴 产严 重童 白自 味昧 料科 签鉴 油汕 粉纷 存荐 含舍 糖搪 质貭 配酏 酸酞 干千 期斯 乳孔 钠纳 净诤 盐监 "
    "已己 末未 土士 人入 大太 天夭 木本 目日 田由 王玉 午牛 力刀 水氷 口囗 贝见 问间 侯候 拔拨 折拆 晴睛 清请 情请 治冶 鸟乌 圆园 "
    "酱浆 菜莱 蓝篮 蜜密 盒盆 袋装 免兔 冷泠 茶荼 豆豈 麦麥 辣辢 桃挑 橙澄 桔枯 柠拧 检捡 验骏 编偏 码玛 号另 址扯 电甩 话活 网冈 "
    "营宫 养羊 表裹 能熊 量童 蛋疍 肪肋 物扨 限很 限恨 保堡 质盾 贮贬 藏葳 储诸 温湿 食良 用甩 方万 法祛 开升 即郎 可司 加如 热執"
).split()

_SYMBOLS = re.compile(
    r"[一-鿿㐀-䶿]|(?<![A-Za-z0-9])(?=[lIOZSB]*+\d)[\dlIOZSB]++(?=(?:dpi|kg|mg|g|ml|cm|mm|kJ|pt|px)(?![A-Za-z0-9]))|[A-Za-zÀ-ÖØ-öø-ɏ0-9]+|\S"
)
_DIGITS = re.compile(r"\d+")
_HYPHEN = re.compile(r"(?<![A-Za-zÀ-ÖØ-öø-ɏ0-9])([A-Za-zÀ-ÖØ-öø-ɏ0-9]+)[-‐‑]\s*$")
_COMPOUND = re.compile(r"(?<![A-Za-zÀ-ÖØ-öø-ɏ])([A-Za-zÀ-ÖØ-öø-ɏ]+)-([A-Za-zÀ-ÖØ-öø-ɏ]+)")
_EDGE = "\n"


class _Remembered(dict):
    """What a function gives, kept for up to ``most`` arguments."""

    def __init__(self, function, most=500_000):
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.function(key)
        return value


def _symbol(s: str) -> str:
    if s.isdigit():
        return "#"
    if len(s) == 1:
        return s
    if s.isalpha() or _wordlike(s) and not all(c in "lIOZSB" or c.isdigit() for c in s):
        return s.lower()
    return _DIGITS.sub("#", s)


def symbols(line: str) -> list[str]:
    """The symbols of a line: ideographs, words in lower case, '#' for a number, marks."""
    return [_SYMBOL_OF[s] for s in _SYMBOLS.findall(line)]


def _wordlike(s: str) -> bool:
    """Mixed tokens with more letters than digits are words with a misread letter, the others codes."""
    return sum(c.isalpha() for c in s) >= 2 and sum(c.isdigit() for c in s) * 2 <= len(s)


_SYMBOL_OF = _Remembered(_symbol)


class _Unsure(str):
    """The answer where the broadcast part of the counts does not decide."""


UNSURE = _Unsure("?")


def _by_shape() -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """What is read -> what may stand there, for Latin and for ideographs."""
    latin: dict[str, list[str]] = {}
    cjk: dict[str, list[str]] = {}
    for pair in LATIN_SHAPES:
        there, read = pair.split(">")
        latin.setdefault(read, []).append(there)
    for there, read in CJK_SHAPES:
        cjk.setdefault(read, []).append(there)
    return latin, cjk


SHAPES, CJK = _by_shape()
LONGEST = max(map(len, SHAPES))

#: Letters of words written so that both sides of every shape edit between small letters and digits come out equal.
_WORD_KEY = str.maketrans(dict(zip("ei1lotgqbs", "c1110f9965")) | {"d": "c1", "h": "11", "m": "rr1", "n": "r1", "w": "vv", "u": "11"})


def word_key(word: str) -> str:
    """Equal for words that shape edits can turn into one another."""
    return word.translate(_WORD_KEY)


def _latin(s: str) -> bool:
    return len(s) > 1 and s.isalpha() and s[0] < "一"


def make_trie(words) -> dict:
    trie: dict = {}
    for w in words:
        node = trie
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = w
    return trie


def shape_candidates(token: str, trie: dict) -> list[str]:
    """Every word of ``trie`` that shape edits turn into ``token``: automaton states walked over the trie.

    A state is (position in the token, edits, letter that must follow); all states of a trie node move together.
    """
    out = []
    stack = [(trie, frozenset({(0, 0, "")}))]
    while stack:
        node, states = stack.pop()
        if "" in node and node[""] != token and any(i == len(token) and not due for i, _, due in states):
            out.append(node[""])
        for ch, child in node.items():
            if not ch:
                continue
            moved = set()
            for i, n, due in states:
                if due:  # the second of two letters that are read as one
                    if due == ch:
                        moved.add((i + 1, n, ""))
                    continue
                if token[i : i + 1] == ch:
                    moved.add((i + 1, n, ""))
                if n < MOST_SHAPE and i < len(token):
                    for size in range(1, LONGEST + 1):
                        for there in SHAPES.get(token[i : i + size], ()) if i + size <= len(token) else ():
                            if there == ch:
                                moved.add((i + size, n + 1, ""))
                            elif size == 1 and there[0] == ch:
                                moved.add((i, n + 1, there[1]))
            if moved:
                stack.append((child, frozenset(moved)))
    return out


class Vocabulary:
    """Counts of words and neighbours, and the trie of the words.

    Counts that are not held are below ``floors`` (of words, of neighbours); with floors of 0 all counts are held.
    """

    def __init__(self, words: dict[str, int], neighbours: dict[str, int], floors: tuple[float, float] = (0, 0)):
        self.words, self.neighbours, self.floors = words, neighbours, floors
        self.trie = make_trie(w for w in words if _latin(w))
        self.candidates = lru_cache(100_000)(lambda token: shape_candidates(token, self.trie))
        self.most = max((n for w, n in words.items() if len(w) > 1 and w.isalpha()), default=floors[0])
        self.doubtful = _Remembered(self._doubtful)
        self.corrected = _Remembered(lambda x: self.correction(*x))
        self.doubts = _Remembered(self._doubts, 50_000)

    def _word(self, w: str) -> tuple[float, float]:
        """(least, most) that the count of a word can be."""
        n = self.words.get(w)
        return (0, self.floors[0]) if n is None else (n, n)

    def _beside(self, x: str, y: str) -> tuple[float, float]:
        n = self.neighbours.get(x + "\t" + y)
        return (0, self.floors[1]) if n is None else (n, n)

    def fit(self, before: str, s: str, after: str) -> tuple[float, float]:
        """How often ``s`` stands beside its neighbours."""
        a, b = self._beside(before, s), self._beside(s, after)
        return a[0] + b[0], a[1] + b[1]

    def _fit_any(self, before: str, s: str, after: str) -> tuple[float, float]:
        """The best fit of ``s`` where its neighbours may be misread too."""
        left = [self._beside(x, s) for x in (before, *CJK.get(before, ()))]
        right = [self._beside(s, x) for x in (after, *CJK.get(after, ()))]
        return tuple(max(x[k] for x in left) + max(x[k] for x in right) for k in (0, 1))

    def correction(self, before: str, s: str, after: str) -> str | None:
        """What stands where ``s`` was read, if ``s`` is misread; UNSURE if the counts held do not decide it."""
        if "一" <= s <= "鿿":
            options = CJK.get(s)
            if not options:
                return None
            least, most = self.fit(before, s, after)
            fits = {c: self._fit_any(before, c, after) for c in options}
            if max(x[1] for x in fits.values()) <= TIMES * least:
                return None
            best = max(options, key=lambda c: fits[c][0])
            return best if fits[best][0] > TIMES * most and all(fits[c][1] <= fits[best][0] for c in options if c != best) else UNSURE
        if s == "#" or not (s[0].isalnum() or s[0] == "#" and len(s) > 1):
            return None
        if len(s) <= 2 and s.isalpha() and _EDGE in (before, after):  # a piece of a word cut at the line's end
            return None
        if (number := _as_number(s)) is not None:
            if len(s) == 1 and (_latin(before) or _latin(after)):  # a piece of a name
                return None
            numbers, codes = self._word("#"), self._word(s)
            # no code has these letters before a digit, unless the corpus shows many
            if _LETTER_FIRST.search(s):
                if numbers[0] > CODE_SHARE * codes[1]:
                    return number
                if numbers[1] > CODE_SHARE * codes[0]:
                    return UNSURE
            tests = [
                (self._beside(before, "#"), self._beside(before, s)),
                (self._beside("#", after), self._beside(s, after)),
            ]
            least, most = self.fit(before, s, after)
            best = self.fit(before, "#", after)
            if any(a[1] < b[0] for a, b in tests) or best[1] <= TIMES * least:
                return None
            return number if all(a[0] >= b[1] for a, b in tests) and best[0] > TIMES * most else UNSURE
        if len(s) < 2:
            return None
        # a candidate that is not held is rarer than any word that is, so it corrects none of them
        most = self._word(s)[1]
        found = [w for w in self.candidates(s) if self.words[w] > TIMES * most]
        if found:
            return max(found, key=lambda w: (self.fit(before, w, after)[0], self.words[w], w))
        return None if s in self.words or not self.floors[0] else UNSURE

    def _doubtful(self, s: str) -> bool:
        """Whether a symbol can be misread at all."""
        if len(s) == 1:
            return s in CJK or s in "lIOZSB"
        return not (s.isalpha() and self.words.get(s, 0) * TIMES >= self.most)  # no word is frequent enough to correct it

    def misread(self, line: str, unsure: set | None = None) -> bool:
        """Whether a line holds a misread character for certain; contexts that are not decided go to ``unsure``."""
        out = symbols(line)
        doubtful = self.doubtful
        for k, s in enumerate(out):
            if doubtful[s]:
                c = self.corrected[x := (out[k - 1] if k else _EDGE, s, out[k + 1] if k + 1 < len(out) else _EDGE)]
                if c is UNSURE:
                    if unsure is not None:
                        unsure.add(context(*x))
                elif c is not None:
                    return True
        return False

    def _doubts(self, line: str) -> list[tuple[int, tuple[str, str, str], str]]:
        """(place, context, correction or UNSURE) of the symbols of a line that may be misread."""
        out = symbols(line)
        around = enumerate(zip([_EDGE, *out], out, [*out[1:], _EDGE]))
        return [(k, x, c) for k, x in around if self.doubtful[x[1]] and (c := self.corrected[x]) is not None]

    def open_questions(self, line: str) -> set[Question]:
        """The questions about a line's symbols that the counts held do not answer."""
        return {context(*x) for _, x, c in self.doubts[line] if c is UNSURE}

    def repaired(self, line: str, known: dict[tuple, str | None] | None = None) -> str:
        """``line`` with misread characters replaced; spacing and case of the rest stay. ``known`` decides what is unsure."""
        changed = {k: (known or {}).get(context(*x)) if c is UNSURE else c for k, x, c in self.doubts[line]}
        if not changed:
            return line
        out, at = [], 0
        for k, m in enumerate(_SYMBOLS.finditer(line)):
            if (c := changed.get(k)) is None:
                continue
            out.append(line[at : m.start()])
            if c == "#number":
                out.append(_number_of(m[0]))
            else:
                out.append(c.capitalize() if m[0][:1].isupper() and c.isalpha() else c)
            at = m.end()
        return "".join(out) + line[at:]


# -- what the broadcast counts leave open

#: A question is (what, x, y, z): ('m', before, symbol, after) asks for a correction, ('b', stem, following word, '')
#: whether a word is broken off.
Question = tuple[str, str, str, str]


def context(before: str, s: str, after: str) -> Question:
    """The question about a symbol. Words are asked for by themselves: their neighbours do not decide."""
    return ("m", "", s, "") if _latin(s) or not ("一" <= s <= "鿿" or _as_number(s)) else ("m", before, s, after)


def broken_end(line: str, following: str | None) -> Question | None:
    """The question whether the last word of ``line`` is broken off; None if it ends in no hyphen or no word follows."""
    m = _HYPHEN.search(line)
    if not m or len(m[1]) < 2:
        return None
    word = re.match(r"\s*([A-Za-zÀ-ÖØ-öø-ɏ0-9]+)", following or "")
    if not word and following and following.strip():
        return None  # what follows is no word
    return ("b", m[1], word[1] if word else "", "")


def needed_counts(q: Question) -> list[tuple[str, str]]:
    """(kind, key) of the counts that answer a question; kinds as in ``_count``."""
    what, x, y, z = q
    if what == "b":
        stem, both = shape_key(x), shape_key(x + y)
        return [("F", stem), ("E", stem), *([("J", both), ("H", both)] if y else [])]
    if "一" <= y <= "鿿":
        left, right = (x, *CJK.get(x, ())), (z, *CJK.get(z, ()))
        pairs = {(x, y), (y, z)} | {(a, c) for c in CJK.get(y, ()) for a in left} | {(c, b) for c in CJK.get(y, ()) for b in right}
        return [("n", "\t".join(p)) for p in pairs]
    if _as_number(y):
        return [("w", "#"), ("w", y), *(("n", "\t".join(p)) for p in {(x, "#"), ("#", z), (x, y), (y, z)})]
    return [("w", y), ("K", word_key(y))]


def answered(q: Question, counts: list[tuple[str, str, str, int]]) -> str | None:
    """The answer to a question from all its (kind, key, word, n): a correction or '-' for a broken word, None for neither."""
    what, x, y, z = q
    if what == "b":
        n = {kind: c for kind, _, _, c in counts}
        compound, joined = n.get("H", 0), n.get("J", 0)
        if compound > joined:
            return None
        if joined:
            return "-"
        # a hyphen of its own stands within lines more often than at their ends
        return "-" if any(c.isalpha() for c in x) and n.get("F", 0) <= n.get("E", 0) else None
    words = {w or k: n for kind, k, w, n in counts if kind in "wK"}
    return Vocabulary(words, {k: n for kind, k, _, n in counts if kind == "n"}).correction(x, y, z)


#: A code such as S# is accepted if more than one in so many numbers has its shape.
CODE_SHARE = 8
_LETTER_FIRST = re.compile(r"[lIOZSB].*[#\d]")


_NUMBER_LETTERS = str.maketrans("lIOoZSBg", "11002589")


def _as_number(s: str) -> str | None:
    """'#number' if ``s`` becomes a number once letters shaped like digits are read as digits."""
    if all(c in "#lIOZSB" or c.isdigit() for c in s) and ("#" in s or len(s) <= 2 or any(c.isdigit() for c in s)):
        return "#number"
    return None


def _number_of(s: str) -> str:
    return s.translate(_NUMBER_LETTERS)


#: Characters of like shape made one; letters that look like two are written as two first.
_AS_PAIRS = str.maketrans({"d": "cl", "h": "li", "m": "rn", "w": "vv"})
_CAPITALS = str.maketrans("lIOZSB", "110258")
_SHAPE_CLASS = str.maketrans("ecilotgqsb", "cc110f9956")


def _shape_table() -> dict[int, str]:
    """What each character becomes; a sign misread for another becomes that one, however long the chain."""
    table = {chr(c): chr(c) for c in range(33, 127)}
    table = {ch: ch.translate(_AS_PAIRS).translate(_CAPITALS).lower().translate(_SHAPE_CLASS) for ch in table}
    for there, read in CJK_SHAPES:
        table[read] = table.get(there, there)
    return {ord(k): v for k, v in table.items()}


_SHAPES = _shape_table()


def shape_key(text: str) -> str:
    """A text with characters of like shape made equal, for comparing lines that may be misread."""
    return "".join(unicodedata.normalize("NFKC", text).split()).translate(_SHAPES).lower()


#: A running header is a title; it does not end like a sentence.
SENTENCE_ENDS = ".。,，;；!?！？、"
_N = r"[0-9lIOoZSB]{1,5}"
_PAGE_ALONE = re.compile(
    rf"^\s*(?:[·•∙\-—–\[(（【~]+\s*({_N})\s*[·•∙\-—–\])）】~]+|页码\s*[:：]?\s*({_N})|第\s*({_N})\s*页(?:\s*[/,，]?\s*共\s*{_N}\s*页)?|[PpＰ](?:age|g)?\s*[.．:]?\s*({_N})(?:\s*(?:of|/|cf|0f)\s*{_N})?|[PＰ]a[g9][ec]\s*({_N})\s*[o0]?[ft]?\s*{_N}|({_N})\s*/\s*{_N}|({_N}))\s*$"
)
_PAGE_TAIL = re.compile(rf"(?:\s[-—–·|]\s*({_N})|\s[PpＰ]\.?\s?({_N})|\s*第\s*({_N})\s*页|\s页码[:：]\s*({_N}))\s*$")
_PAGE_HEAD = re.compile(rf"^\s*(?:({_N})\s*[-—–·|]\s+|[PpＰ]\.?\s?({_N})\s+|第\s*({_N})\s*页\s*|页码[:：]\s*({_N})\s+)")


def _group(m: re.Match) -> int:
    return int(next(g for g in m.groups() if g).translate(_NUMBER_LETTERS))


def page_number_alone(line: str) -> int | None:
    """The number of a line that holds a page number and nothing else."""
    m = _PAGE_ALONE.match(" ".join(line.split()))
    return _group(m) if m and any(c.isdigit() or c in "lI" for c in line) else None


def split_header(line: str) -> tuple[str, int | None]:
    """(the line without a page number at an end, that number)."""
    line = " ".join(line.split())
    for p in (_PAGE_TAIL, _PAGE_HEAD):
        if (m := p.search(line)) is not None and (m.start() > 0 or m.end() < len(line)):
            rest = (line[: m.start()] + " " + line[m.end() :]).strip()
            if len(rest) >= 4:
                return rest, _group(m)
    return line.strip(), None


# -- the corpus


_COUNTS = "kind string, k string, word string, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, k, word, n) of a batch: 'w' words, 'n' neighbours, 'K' words by their ``word_key``; by ``shape_key`` 'J' words,
    'H' hyphenated words without the hyphen, 'F' their first parts, 'E' what stands before a hyphen at a line's end."""
    for b in batches:
        words: Counter = Counter()
        pairs: Counter = Counter()
        other: Counter = Counter()
        for text in b.column(0).to_pylist():
            for line in text.split("\n"):
                s = symbols(line)
                if not s:
                    continue
                words.update(s)
                pairs.update(zip([_EDGE, *s], [*s, _EDGE]))
                if "-" in line or "‐" in line or "‑" in line:
                    for x, y in _COMPOUND.findall(line):
                        other["H", shape_key(x + y), ""] += 1
                        other["F", shape_key(x), ""] += 1
                    if (m := _HYPHEN.search(line)) is not None:
                        other["E", shape_key(m[1]), ""] += 1
        for w, n in words.items():
            if _latin(w):
                other["K", word_key(w), w] += n
            if len(w) > 3:
                other["J", shape_key(w), ""] += n
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(["w"] * len(words) + ["n"] * len(pairs) + [k[0] for k in other], pa.string()),
                pa.array([*words, *map("\t".join, pairs), *(k[1] for k in other)], pa.string()),
                pa.array([""] * (len(words) + len(pairs)) + [k[2] for k in other], pa.string()),
                pa.array([*words.values(), *pairs.values(), *other.values()], pa.int64()),
            ],
            names=["kind", "k", "word", "n"],
        )


def corpus_counts(texts: DataFrame) -> DataFrame:
    """(kind, k, word, n) over all texts (one string column), written once."""
    return checkpointed(
        texts.mapInArrow(_count, _COUNTS)
        .groupBy("kind", "k", "word")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= LEAST_COUNT)
    )


def frequent_part(counts: DataFrame) -> tuple[dict[str, int], dict[str, int], tuple[float, float]]:
    """(words, neighbours, floors): those whose share of all symbols is large enough, at most 1 / LEAST_SHARE of each."""
    two = counts.where(F.col("kind").isin("w", "n"))
    whole = {r.kind: r.whole for r in two.groupBy("kind").agg(F.sum("n").alias("whole")).collect()}  # two rows
    floors = tuple(max(LEAST_COUNT, LEAST_SHARE * whole.get(kind, 0)) for kind in "wn")
    out: dict[str, dict[str, int]] = {"w": {}, "n": {}}
    least = F.when(F.col("kind") == "w", F.lit(floors[0])).otherwise(F.lit(floors[1]))
    for r in two.where(F.col("n") >= least).select("kind", "k", "n").toLocalIterator():
        out[r.kind][r.k] = r.n
    return out["w"], out["n"], floors


_QUESTION = ["what", "x", "y", "z"]


def answers(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """(what, x, y, z, answer) of the distinct questions in ``asked`` that have one, by the whole counts."""

    def need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            many = [needed_counts(q) for q in zip(*(c.to_pylist() for c in b.columns))]
            at = pa.array([i for i, m in enumerate(many) for _ in m], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(c.take(at) for c in b.columns), pa.array([k for m in many for k, _ in m], pa.string()), pa.array([k for m in many for _, k in m], pa.string())],
                names=[*_QUESTION, "kind", "k"],
            )

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [
                answered(q, [(r["kind"], r["k"], r["word"], r["n"]) for r in held])
                for *q, held in zip(*(c.to_pylist() for c in b.columns))
            ]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(found, pa.string())], names=[*_QUESTION, "answer"])

    text = ", ".join(f"{c} string" for c in _QUESTION)
    wanted = asked.select(*_QUESTION).distinct().mapInArrow(need, f"{text}, kind string, k string")
    held = wanted.join(counts.hint("merge"), ["kind", "k"], "left").groupBy(*_QUESTION).agg(
        # few: the counts that one question needs
        F.collect_list(F.when(F.col("n").isNotNull(), F.struct("kind", "k", "word", "n"))).alias("held")
    )
    return held.mapInArrow(decide, f"{text}, answer string").where(F.col("answer").isNotNull())


# -- page furniture


def edge_lines(lines: DataFrame, hot_rows: int = 50_000) -> DataFrame:
    """``lines`` (id, job_id, page, line_no, text) with ``edge``: 'top' or 'foot' for the first and last two of a page."""
    pages = lines.groupBy("job_id", "page").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"))
    joined = salted_join(lines, pages, ["job_id", "page"], F.col("id"), "left", hot_rows)
    return joined.withColumn(
        "edge",
        F.when(F.col("line_no") <= F.col("first") + 1, "top").when(F.col("line_no") >= F.col("last") - 1, "foot"),
    ).select("id", "job_id", "page", "line_no", "text", "edge")


_KEYED = "id string, job_id string, page int, line_no int, text string, edge string, key string, page_number int, alone boolean"


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The comparable form of each edge line and the page number that it holds."""
    for b in batches:
        keys, numbers, alone = [], [], []
        for text, edge in zip(b.column(4).to_pylist(), b.column(5).to_pylist()):
            key = number = None
            by_itself = False
            if edge and text and text.strip():
                number = page_number_alone(text)
                by_itself = number is not None
                if not by_itself and text.rstrip()[-1] not in SENTENCE_ENDS:
                    rest, number = split_header(text)
                    key = shape_key(rest)
            keys.append(key if key and len(key) >= 4 else None)
            numbers.append(number)
            alone.append(by_itself)
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(keys, pa.string()), pa.array(numbers, pa.int32()), pa.array(alone, pa.bool_())],
            names=[*b.schema.names, "key", "page_number", "alone"],
        )


def running_headers(keyed: DataFrame) -> DataFrame:
    """(job_id, key): comparable forms of the lines that a job's pages repeat at the top or foot."""
    on_pages = keyed.where(F.col("key").isNotNull()).select("job_id", "edge", "key", "page").distinct()
    repeated = (
        on_pages.groupBy("job_id", "edge", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HEADER_PAGES)
    )
    pages = keyed.select("job_id", "page").distinct().groupBy("job_id").agg(F.count(F.lit(1)).alias("pages"))
    return (
        repeated.join(pages, "job_id")
        .where(F.col("n") >= F.col("pages") * F.lit(HEADER_SHARE))
        .select("job_id", "key")
        .distinct()
    )


def noisy_records(alignments: DataFrame, candidates: DataFrame) -> DataFrame:
    """(rec_id, noise_kind): each record with each kind of noise in its text."""
    lines = alignments.where(F.col("alignment_id").isNotNull() & F.col("ocr_text").isNotNull()).select(
        F.col("alignment_id").alias("id"), "job_id", "page", "line_no", F.col("ocr_text").alias("text")
    )
    blocks = candidates.where(F.col("candidate_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("candidate_id").alias("id"), "job_id", "text"
    )
    counts = corpus_counts(
        alignments.where(F.col("pdf_text").isNotNull()).select(F.col("pdf_text").alias("text")).unionAll(blocks.select("text"))
    )
    vocabulary = alignments.sparkSession.sparkContext.broadcast(frequent_part(counts))

    placed = lines.where(F.col("job_id").isNotNull() & F.col("page").isNotNull() & F.col("line_no").isNotNull())
    # both are small and read several times below, so they are written once
    keyed = checkpointed(edge_lines(placed).where(F.col("edge").isNotNull()).mapInArrow(_keyed, _KEYED))
    headers = checkpointed(running_headers(keyed))
    headed = keyed.where(F.col("key").isNotNull()).join(headers, ["job_id", "key"])
    found = [
        headed.select("id", F.lit("running_header").alias("noise_kind")),
        headed.where(F.col("page_number") == F.col("page")).select("id", F.lit("page_number").alias("noise_kind")),
        keyed.where(F.col("alone") & (F.col("page_number") == F.col("page"))).select("id", F.lit("page_number").alias("noise_kind")),
        furniture_of_blocks(blocks, headers, placed).select("id", "noise_kind"),
        _noise_of_words(lines, placed, blocks, vocabulary, counts),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out.select(F.col("id").alias("rec_id"), "noise_kind").distinct()


def furniture_of_blocks(blocks: DataFrame, headers: DataFrame, placed: DataFrame) -> DataFrame:
    """(id, at, noise_kind): furniture in the first and last two lines of blocks of several lines, by the headers and pages
    of their job; ``at`` is the line's place in the block from 0."""
    pages = placed.groupBy("job_id").agg(F.max("page").alias("pages"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, jobs, places, keys, numbers, alone = [], [], [], [], [], []
            for i, j, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                lines = [(k, x) for k, x in enumerate(text.split("\n")) if x.strip()]
                if len(lines) < 2 or j is None:
                    continue
                for at, line in dict.fromkeys([*lines[:2], *lines[-2:]]):
                    n = page_number_alone(line)
                    single = n is not None
                    key = None
                    if not single and line.rstrip()[-1] not in SENTENCE_ENDS:
                        rest, n = split_header(line)
                        key = shape_key(rest)
                    ids.append(i)
                    jobs.append(j)
                    places.append(at)
                    keys.append(key)
                    numbers.append(n)
                    alone.append(single)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(jobs, pa.string()), pa.array(places, pa.int32()), pa.array(keys, pa.string()), pa.array(numbers, pa.int32()), pa.array(alone, pa.bool_())],
                names=["id", "job_id", "at", "key", "page_number", "alone"],
            )

    # a few short rows a block, read three times below
    edges = checkpointed(
        blocks.select("id", "job_id", "text").mapInArrow(emit, "id string, job_id string, at int, key string, page_number int, alone boolean")
        .where(F.col("alone") | F.col("key").isNotNull())
    )
    headed = edges.where(F.col("key").isNotNull()).join(headers, ["job_id", "key"])
    numbered = salted_join(edges.where("alone"), pages, ["job_id"], F.col("id"), "inner")
    return (
        headed.select("id", "at", F.lit("running_header").alias("noise_kind"))
        .unionAll(headed.where(F.col("page_number").isNotNull()).select("id", "at", F.lit("page_number").alias("noise_kind")))
        .unionAll(
            numbered.where(F.col("page_number").between(F.lit(1), F.col("pages"))).select("id", "at", F.lit("page_number").alias("noise_kind"))
        )
    )


_VOCABULARIES: dict[int, Vocabulary] = {}


def _loaded(broadcast) -> Vocabulary:
    """One trie per worker and vocabulary."""
    key = id(broadcast.value)  # a worker reads a broadcast once
    if key not in _VOCABULARIES:
        _VOCABULARIES.clear()
        _VOCABULARIES[key] = Vocabulary(*broadcast.value)
    return _VOCABULARIES[key]


def _noise_of_words(lines: DataFrame, placed: DataFrame, blocks: DataFrame, vocabulary, counts: DataFrame) -> DataFrame:
    """Misread characters and broken words of lines and blocks."""
    # only the few lines that end with a hyphen need the line that follows
    open_ended = placed.where(F.col("text").rlike("[-‐‑]\\s*$"))
    nexts = placed.select("job_id", "page", (F.col("line_no") - 1).alias("line_no"), F.col("text").alias("following"))
    followed = (
        open_ended.join(nexts, ["job_id", "page", "line_no"], "left")
        .groupBy("id", "text")
        .agg(F.max("following").alias("following"))
        .select("id", "text", "following", F.lit("b").alias("what"))
    )
    plain = lines.select("id", "text", F.lit(None).cast("string").alias("following"), F.lit("m").alias("what"))
    both = blocks.select("id", "text", F.lit(None).cast("string").alias("following"), F.lit("mb").alias("what"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _loaded(vocabulary)
        for b in batches:
            ids, kinds, asked = [], [], []
            for i, text, following, what in zip(*(b.column(k).to_pylist() for k in range(4))):
                parts = text.split("\n")
                open_questions: set = set()
                if "m" in what:
                    if any(v.misread(x, open_questions) for x in parts):
                        ids.append(i)
                        kinds.append("misread")
                        asked.append(_DECIDED)
                        open_questions.clear()
                if "b" in what:
                    open_questions |= {q for x, y in zip(parts, [*parts[1:], following]) if (q := broken_end(x, y)) is not None}
                for q in open_questions:
                    ids.append(i)
                    kinds.append("misread" if q[0] == "m" else "hyphen_break")
                    asked.append(q)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(kinds, pa.string()), *(pa.array([q[k] for q in asked], pa.string()) for k in range(4))],
                names=["id", "noise_kind", *_QUESTION],
            )

    # read three times below, small beside the texts
    scanned = checkpointed(
        plain.unionAll(both).unionAll(followed).mapInArrow(find, "id string, noise_kind string, " + ", ".join(f"{c} string" for c in _QUESTION))
    )
    asked = scanned.where(F.col("what").isNotNull())
    answer = answers(asked, counts).select(*_QUESTION)
    return (
        scanned.where(F.col("what").isNull()).select("id", "noise_kind")
        .unionAll(salted_join(asked, answer, _QUESTION, F.col("id"), "left_semi").select("id", "noise_kind"))
    )


_DECIDED = (None, None, None, None)


# -- repair


def reflowed(v: Vocabulary, lines: list[str], known: dict[Question, str | None], longest: int, after: str | None = None, within: bool = False) -> list[tuple[str, str]]:
    """Lines joined to paragraphs, each with what its end is the end of: words whole again, a blank only between Latin words.

    A 'paragraph' ends with a line that ends a sentence and is shorter than the longest one of its page by a fifth at
    least; at the end of a page one of both is enough, since a title or value stands there as well. The last one ends with
    the 'lines', or it runs on in ``after``, the line that follows (of the same page if ``within``), from the end of a
    'line' or a piece of a 'word'.
    """
    out, text, ends = [], "", "lines"
    for k, line in enumerate(lines):
        following = lines[k + 1] if k + 1 < len(lines) else after
        fixed = v.repaired(line, known).strip()
        if known.get(broken_end(line, following) or ()) is not None:
            text += _HYPHEN.sub(lambda m: m[1], fixed)
            ends = "word"
            continue
        text += fixed
        sentence, short = fixed[-1:] in (*PARAGRAPH_ENDS,), len(line.strip()) < 0.8 * longest
        if fixed:
            ends = "line" if within or not (sentence or short) else "lines"
        if sentence and short:
            ends = "lines"
            out.append((text, "paragraph"))
            text = ""
        elif fixed and fixed[-1] < LATIN_END and not fixed.endswith("-") and following and following.strip()[:1] < LATIN_END:
            text += " "
    out = [(p, e) for t, e in [*out, (text, ends)] if (p := re.sub(r"\s+", " ", t).strip())]
    return out[:-1] + [(p, e if e != "paragraph" else "lines") for p, e in out[-1:]]


#: Marks that may end a paragraph.
PARAGRAPH_ENDS = "。.!?！？"
#: Below are the scripts that write a blank between words.
LATIN_END = "⺀"


def _text_parts(alignments: DataFrame, candidates: DataFrame) -> DataFrame:
    """(source, rec_id, page, part, lines, longest, after): lines in their order without furniture, that of blocks included;
    the length of the longest line of the page, and the line that follows on the same page.

    A page is 'page' by its job, a candidate 'block' by its id, a line without job, page or number 'line' by its id. Of
    an id delivered twice the smallest (job, page, number, text) is taken, of a candidate the smallest text and its job. A
    page of more than PART_LINES lines comes in parts.
    """
    one = (
        alignments.where(F.col("alignment_id").isNotNull() & F.col("ocr_text").isNotNull())
        .groupBy(F.col("alignment_id").alias("id"))
        .agg(F.min(F.struct(F.col("job_id"), F.col("page"), F.col("line_no"), F.col("ocr_text").alias("text"))).alias("r"))
        .select("id", "r.*")
    )
    has_place = F.col("job_id").isNotNull() & F.col("page").isNotNull() & F.col("line_no").isNotNull()
    placed = one.where(has_place)
    keyed = checkpointed(edge_lines(placed).mapInArrow(_keyed, _KEYED))
    headers = checkpointed(running_headers(keyed.where(F.col("edge").isNotNull())))
    shown = keyed.where(F.col("key").isNull()).unionAll(
        salted_join(keyed.where(F.col("key").isNotNull()), headers, ["job_id", "key"], F.col("id"), "left_anti").select(*keyed.columns)
    )
    on_page = Window.partitionBy("rec_id", "page")  # of a page's parts, not of its lines
    longest = F.array_max(F.transform("lines", F.length))
    pages = (
        shown.where(~(F.col("alone") & (F.col("page_number") == F.col("page"))))
        .withColumn("part", F.floor(F.col("line_no") / F.lit(PART_LINES)).cast("int"))
        .groupBy(F.col("job_id").alias("rec_id"), "page", "part")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "id", "text"))), lambda x: x["text"]).alias("lines"))
        .select(
            F.lit("page").alias("source"), "rec_id", "page", "part", "lines",
            F.max(longest).over(on_page).alias("longest"), F.lead(F.element_at("lines", 1)).over(on_page.orderBy("part")).alias("after"),
        )
    )
    none = F.lit(None).cast("string")
    loose = one.where(~has_place).select(F.lit("line"), "id", F.lit(None).cast("int"), F.lit(0), F.array("text"), F.length("text"), none)
    blocks = (
        candidates.where(F.col("candidate_id").isNotNull() & F.col("text").isNotNull())
        .groupBy(F.col("candidate_id").alias("id"))
        .agg(F.min(F.struct("text", F.col("job_id").isNull(), "job_id")).alias("r"))
        .select("id", "r.text", "r.job_id")
    )
    furniture = furniture_of_blocks(blocks, headers, keyed).groupBy("id").agg(F.collect_set("at").alias("without"))  # four at most
    freed = blocks.join(furniture, "id", "left").select(
        F.lit("block"), "id", F.lit(None).cast("int"), F.lit(0),
        F.filter(F.split("text", "\n"), lambda x, k: ~F.coalesce(F.array_contains("without", k), F.lit(False))).alias("lines"),
    )
    return pages.unionAll(loose).unionAll(freed.select("*", longest, none))


def paragraphs(alignments: DataFrame, candidates: DataFrame) -> DataFrame:
    """(source, rec_id, page, part, par_no, text, ends): every page, block and loose line repaired and reflowed.

    What a part of a page has of each paragraph is one row; ``ends`` as in ``reflowed``. Parts without an open question
    are reflowed where they are read, only the others meet the answers.
    """
    counts = corpus_counts(
        alignments.where(F.col("pdf_text").isNotNull()).select(F.col("pdf_text").alias("text"))
        .unionAll(candidates.where(F.col("text").isNotNull()).select("text"))
    )
    vocabulary = alignments.sparkSession.sparkContext.broadcast(frequent_part(counts))
    at, pieces = ["source", "rec_id", "page", "part"], ["par_no", "text", "ends"]
    columns = "source string, rec_id string, page int, part int, par_no int, text string, ends string"
    question = ", ".join(f"{c}: string" for c in _QUESTION)

    def cut(b: pa.RecordBatch, made: list[list[tuple[str, str]]]) -> list[pa.Array]:
        rows = pa.array([n for n, m in enumerate(made) for _ in m], pa.int64())
        return [
            *(b.column(k).take(rows) for k in range(4)),
            pa.array([k for m in made for k in range(1, len(m) + 1)], pa.int32()),
            *(pa.array([x[k] for m in made for x in m], pa.string()) for k in range(2)),
        ]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _loaded(vocabulary)
        for b in batches:
            made, asked, kept = [], [], []
            for lines, longest, after in zip(*(b.column(k).to_pylist() for k in range(4, 7))):
                own = {q for x, y in zip(lines, [*lines[1:], after]) if (q := broken_end(x, y)) is not None}
                for x in lines:
                    own |= v.open_questions(x)
                made.append([("", "")] if own else reflowed(v, lines, {}, longest or 0, after, after is not None))
                kept += [(lines, longest, after)] if own else [(None, None, None)] * len(made[-1])
                asked += [[dict(zip(_QUESTION, q)) for q in own]] if own else [None] * len(made[-1])
            yield pa.RecordBatch.from_arrays(
                [
                    *cut(b, made),
                    *(pa.array([x[k] for x in kept], t) for k, t in enumerate((pa.list_(pa.string()), pa.int32(), pa.string()))),
                    pa.array(asked, pa.list_(pa.struct([(c, pa.string()) for c in _QUESTION]))),
                ],
                names=[*at, *pieces, "lines", "longest", "after", "asked"],
            )

    looked = checkpointed(
        _text_parts(alignments, candidates).mapInArrow(look, f"{columns}, lines array<string>, longest int, after string, asked array<struct<{question}>>")
    )
    parts = looked.where(F.col("asked").isNotNull()).select(*at, "lines", "longest", "after", "asked")
    whole = looked.where(F.col("asked").isNull())

    # what follows a page that ends with a hyphen: few of them, and one word of each part
    in_job = Window.partitionBy("rec_id").orderBy("page", "part")
    of_pages = F.col("source") == "page"
    begins = lambda x: F.regexp_extract(x, "(?U)^\\s*([A-Za-zÀ-ÖØ-öø-ɏ0-9]+|\\S)", 1).alias("begins")
    ended = F.when(F.col("after").isNull() & F.element_at("lines", -1).rlike("(?U)[-‐‑]\\s*$"), F.element_at("lines", -1)).alias("last")
    beside = checkpointed(
        parts.where(of_pages).select("rec_id", "page", "part", begins(F.element_at("lines", 1)), ended)
        .unionAll(whole.where(of_pages & (F.col("par_no") == 1)).select("rec_id", "page", "part", begins("text"), F.lit(None)))
        .withColumn("next", F.lead("begins").over(in_job))
        .where(F.col("last").isNotNull())
        .select(F.lit("page").alias("source"), "rec_id", "page", "part", "last", "next")
    )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(n, q) for n, x in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist())) if (q := broken_end(*x)) is not None]
            rows = pa.array([n for n, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k).take(rows) for k in range(4)), *(pa.array([q[k] for _, q in found], pa.string()) for k in range(4))],
                names=[*at, *_QUESTION],
            )

    asked = parts.select(*at, F.explode("asked").alias("q")).select(*at, "q.*").unionAll(
        beside.mapInArrow(ask, "source string, rec_id string, page int, part int, " + question.replace(":", ""))
    )
    known = (
        salted_join(asked, answers(asked, counts), _QUESTION, F.xxhash64("rec_id", "page"), "inner")
        .select(*at, F.struct(*_QUESTION, "answer").alias("known"), F.lit(None).cast("string").alias("next"))
        .unionAll(beside.select(*at, F.lit(None), "next"))
        .withColumn("page", F.coalesce("page", F.lit(-1)))
        .groupBy(*at)
        .agg(F.collect_list("known").alias("known"), F.max("next").alias("next"))  # no more answers than the part has symbols
    )
    joined = parts.withColumn("key", F.coalesce("page", F.lit(-1))).join(
        known.withColumnRenamed("page", "key"), ["source", "rec_id", "key", "part"], "left"
    ).select(*at, "lines", "longest", "after", "next", "known")

    def flow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _loaded(vocabulary)
        for b in batches:
            made = []
            for lines, longest, after, following, found in zip(*(b.column(k).to_pylist() for k in range(4, 9))):
                answer = {tuple(r[c] for c in _QUESTION): r["answer"] for r in found or ()}
                made.append(reflowed(v, lines, answer, longest or 0, following if after is None else after, after is not None))
            yield pa.RecordBatch.from_arrays(cut(b, made), names=[*at, *pieces])

    return whole.select(*at, *pieces).unionAll(checkpointed(joined.mapInArrow(flow, columns)))


def whole_paragraphs(alignments: DataFrame, candidates: DataFrame) -> DataFrame:
    """(source, rec_id, page, part, par_no, text): the paragraphs whole, over all pages and parts of a job that they run
    on, each where it begins. A block or loose line runs on nowhere."""
    pieces = paragraphs(alignments, candidates)
    of_page = F.col("source") == "page"
    # one short row a part: how many pieces it has and whether the last one runs on, as no other can
    in_job = Window.partitionBy("rec_id").orderBy("page", "part")
    heads = (
        pieces.where(of_page & (F.col("ends") != "paragraph"))
        .select("rec_id", "page", "part", F.col("par_no").alias("n"), (F.col("ends") != "lines").alias("runs_on"))
        .withColumn("continued", F.coalesce(F.lag("runs_on").over(in_job), F.lit(False)))
        .withColumn("begun", F.when(~F.col("continued") | (F.col("n") > 1), F.struct("page", "part", F.col("n").alias("par_no"))))
        .withColumn("head", F.last("begun", ignorenulls=True).over(in_job.rowsBetween(Window.unboundedPreceding, -1)))
        .where("continued")
        .select("rec_id", "page", "part", F.lit(1).alias("par_no"), "head")
    )
    alone = ~of_page | (F.col("par_no") > 1) & F.col("ends").isin("paragraph", "lines")
    linked = pieces.where(~alone).join(heads, ["rec_id", "page", "part", "par_no"], "left")
    whole = linked.groupBy("rec_id", F.coalesce("head", F.struct("page", "part", "par_no")).alias("head")).agg(
        F.array_sort(F.collect_list(F.struct("page", "part", "par_no", "text", "ends"))).alias("run")  # one paragraph
    )

    def with_gap(x, k):
        before = F.get("run", k - 1)
        latin = (F.right(before["text"], F.lit(1)) < LATIN_END) & ~before["text"].endswith("-") & (F.left(x["text"], F.lit(1)) < LATIN_END)
        return F.concat(F.when((before["ends"] != "word") & latin, " ").otherwise(""), x["text"])

    columns = ["source", "rec_id", "page", "part", "par_no", "text"]
    return pieces.where(alone).select(*columns).unionAll(
        whole.select(F.lit("page"), "rec_id", "head.*", F.array_join(F.transform("run", with_gap), ""))
    )
