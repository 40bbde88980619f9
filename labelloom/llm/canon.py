"""Free-entered values mapped to a canonical list (problem 4).

A multi-pattern automaton over all names and aliases of the list finds embedded mentions; the longest non-overlapping
ones win. A value that mentions nothing goes to similarity of token sets: the same words in another order mean the
entry, and all entries that share enough characters and pairs (their token sets) to lie within the edit budget are
compared by edit distance (with transpositions). The list is a reference list that does not grow; its size is checked
before it is sent to the executors. No value is shuffled: each distinct one is resolved once per Python worker.

Defined results: null and blank values and values that are exactly a display name give no row; a value that means no
entry, or that is equally close to two entries, gives 0; a value naming several entries takes the one with most
letters, then the first; an empty list maps everything to 0; repeated rows of an id count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A reference list larger than this is not sent to the executors.
MAX_ENTRIES = 100_000
#: Mentions that cover this share of a value's letters decide it; where no entry is similar, this share is enough.
MENTION_SHARE, LEAST_MENTION_SHARE = 0.75, 0.5
#: Distinct values that a worker remembers.
REMEMBERED = 200_000
#: Tokens (letters and pairs of neighbours) that one edit takes from a value at most: three pairs where two letters are
#: exchanged, two pairs and a letter where one is replaced or left out.
LOST = 3

#: Traditional characters and the simplified ones of the same word, in pairs.
TRADITIONAL = (
    "產产 類类 號号 條条 碼码 標标 準准 貯贮 儲储 傳传 語语 宣宣 營营 養养 質质 級级 許许 證证 編编 轉转 識识 輻辐 適适 "
    "羣群 進进 稱称 廠厂 網网 郵郵 郵邮 電电 話话 熱热 線线 瀝沥 乾干 幹干 淨净 簽签 籤签 業业 託托 過过 訊讯 製制 調调 賣卖 "
    "點点 執执 別别 圖图 劑剂 鹽盐 糖糖 醬酱 麵面 麥麦 雞鸡 雙双 實实 對对 東东 來来 長长 門门 開开 間间 時时 書书 "
    "專专 單单 價价 貨货 購购 車车 發发 會会 員员 設设 計计 錄录 紙纸 張张 壓压 應应 當当 個个 萬万 與与 為为 責责 "
    "務务 內内 無无 風风 飲饮 餅饼 蔔卜 葉叶 貳贰 關关 陽阳 陸陆 區区 縣县 鄉乡 鎮镇 樓楼 棟栋 幢幢 塊块 衛卫 檢检 "
    "測测 數数 據据 帶带 攜携 塗涂 燈灯 選选 填填 註注 簡简 優优 壞坏 勞劳 導导 蘋苹 蘭兰 籃篮 氣气 濃浓 縮缩 蘇苏"
)
_SIMPLE = {ord(a): b for a, b in (p for p in TRADITIONAL.split() if p[0] != p[1])}
_NUMBERING = re.compile(r"^\s*(?:[(\[【]?\s*\d{1,3}\s*(?:[.、)\]】)]|\s)\s*)+")
_REMARK = re.compile(r"[(\[【]\s*(?:必填|选填|内部|可选|required|optional|internal)\s*[)\]】]")
_NO_LETTER = re.compile(r"[\W_]+")
_WORDS = re.compile(r"[^\W_]+")


def letters(text: str) -> str:
    """The letters that are compared: one width, lower case, simplified, without numbering, remarks and punctuation."""
    t = " ".join(unicodedata.normalize("NFKC", text).casefold().translate(_SIMPLE).split())
    return _NO_LETTER.sub("", _REMARK.sub("", _NUMBERING.sub("", t)))


def tokens(text: str) -> tuple[str, ...]:
    """The set of words of a text, in one form and order."""
    t = _REMARK.sub(" ", _NUMBERING.sub("", unicodedata.normalize("NFKC", text).casefold().translate(_SIMPLE)))
    return tuple(sorted(set(_WORDS.findall(t))))


def edit_distance(a: str, b: str, most: int) -> int:
    """Edits (a transposition is one) from ``a`` to ``b``; ``most`` + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            now[j] = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                now[j] = min(now[j], before[j - 2] + 1)
        if min(now) > most and (i == 1 or min(row) > most):
            return most + 1
        before, row = row, now
    return min(row[-1], most + 1)


def _pairs(t: str) -> Counter:
    padded = f"^{t}$"
    return Counter(padded[i : i + 2] for i in range(len(padded) - 1)) + Counter(t)


class Canon:
    """The automaton and the token sets of one reference list: (id, names)."""

    def __init__(self, entries: list[tuple[int, list[str]]]):
        self.names: dict[str, int] = {}
        for entry, names in sorted(entries):
            for n in names:
                if n and (k := letters(n)):
                    self.names.setdefault(k, entry)
        self.by_tokens: dict[tuple[str, ...], set[int]] = {}
        for entry, names in entries:
            for n in names:
                if n and len(t := tokens(n)) > 1:
                    self.by_tokens.setdefault(t, set()).add(entry)
        self.automaton = ahocorasick.Automaton()
        for k, entry in self.names.items():
            self.automaton.add_word(k, (len(k), entry))
        if self.names:
            self.automaton.make_automaton()
        self.sets = {k: _pairs(k) for k in self.names}
        self.of_length: dict[int, list[str]] = {}
        for k in self.names:
            self.of_length.setdefault(len(k), []).append(k)
        self.having: dict[str, list[str]] = {}
        for k, s in self.sets.items():
            for p in s:
                self.having.setdefault(p, []).append(k)
        self.resolve = lru_cache(REMEMBERED)(self._resolve)

    def _resolve(self, value: str) -> int:
        t = letters(value)
        if not t or not self.names:
            return 0
        if t in self.names:
            return self.names[t]
        return self._mentioned(t, MENTION_SHARE) or self._same_tokens(value) or self._nearest(t) or self._mentioned(t, LEAST_MENTION_SHARE)

    def _same_tokens(self, value: str) -> int:
        """The one entry with a name of the same two or more words in another order."""
        found = self.by_tokens.get(tokens(value), ())
        return next(iter(found)) if len(found) == 1 else 0

    def _mentioned(self, t: str, share: float) -> int:
        """The entry whose mentions cover most letters, if all mentions cover ``share`` of the value."""
        found = sorted(((n, end - n + 1, e) for end, (n, e) in self.automaton.iter(t)), key=lambda x: (-x[0], x[1]))
        used = [False] * len(t)
        cover: Counter = Counter()
        for n, start, e in found:
            if not any(used[start : start + n]):
                used[start : start + n] = [True] * n
                cover[e] += n
        if not cover or sum(used) < share * len(t):
            return 0
        return max(cover, key=lambda e: cover[e])

    def _nearest(self, t: str) -> int:
        """The one entry closest within the edit budget; every name that can lie in it is compared."""
        most = max(1, len(t) // 10)
        if len(t) < 2:
            return 0
        own, common = _pairs(t), Counter()
        for p in own:
            for k in self.having.get(p, ()):
                common[k] += min(own[p], self.sets[k][p])
        # an edit touches at most LOST tokens, so a name within the budget has all others in common
        if (shared := own.total() - LOST * most) > 0:
            near = [k for k, c in common.items() if c >= shared and abs(len(k) - len(t)) <= most]
        else:
            near = [k for n in range(len(t) - most, len(t) + most + 1) for k in self.of_length.get(n, ())]
        best: dict[int, int] = {}
        for k in near:
            if (d := edit_distance(t, k, most)) <= most and len(k) > 2 * d:
                best[self.names[k]] = min(d, best.get(self.names[k], most))
        if not best:
            return 0
        least = min(best.values())
        closest = [e for e, d in best.items() if d == least]
        return closest[0] if len(closest) == 1 else 0


def catalog_entries(catalog: DataFrame) -> list[tuple[int, list[str]]]:
    """The reference list on the driver, after a check of its size."""
    rows = catalog.where(F.col("catalog_id").isNotNull()).select("catalog_id", "display_name", "name_en", "aliases").take(MAX_ENTRIES + 1)
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"the reference list has more than {MAX_ENTRIES} entries")
    return [(r[0], [x for x in [r[1], r[2], *(r[3] or [])] if x]) for r in rows]


_CANONS: dict[tuple, Canon] = {}


def _canon(entries: tuple) -> Canon:
    """One automaton per worker and list."""
    if entries not in _CANONS:
        _CANONS.clear()
        _CANONS[entries] = Canon([(e, list(n)) for e, n in entries])
    return _CANONS[entries]


def map_to_catalog(values: DataFrame, key: str, value: str, catalog: DataFrame) -> DataFrame:
    """(rec_id, value, catalog_id): the entry that each value means, 0 for none."""
    listed = catalog_entries(catalog)
    frozen = tuple((e, tuple(n)) for e, n in listed)
    shown = catalog.where(F.col("catalog_id").isNotNull() & F.col("display_name").isNotNull()).select(F.col("display_name").alias("value")).distinct()
    todo = values.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(
        F.col(key).alias("rec_id"), F.col(value).alias("value")
    )
    todo = todo.join(F.broadcast(shown), "value", "left_anti").select("rec_id", "value")  # no larger than MAX_ENTRIES

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = _canon(frozen)
        for b in batches:
            text = b.column(1).to_pylist()
            ids = [canon.resolve(t) if t.strip("​﻿ \t\r\n　\xa0") and t.strip() else None for t in text]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.int32())], names=["rec_id", "value", "catalog_id"])

    return todo.mapInArrow(resolve, "rec_id string, value string, catalog_id int").where(F.col("catalog_id").isNotNull())
