"""Several values packed in one field, split into one value per row (problem 6).

The delimiter is inferred: every candidate that occurs outside brackets, quotation marks and numbers is scored on how
consistently it cuts the records of a source (the number of records it cuts, and the spread of its cuts over all of
them) and on how regular the type of its pieces is; candidates below the thresholds do not separate. A mark inside
values falls on few records, one at a time; a mark that separates cuts many records or comes in lists. A source of
fewer than ``ENOUGH`` records says too little of that and takes the consistency of all sources together. The scores
are sums over (source, candidate), combined map-side, so a source holding a third of all rows is one row per map task.
Each record is then scanned once and exploded.

A few candidates (line feed, tab, bar, bullet, full-width marks) never occur inside a value; they separate wherever
they occur outside brackets. The others (comma, slash, hyphen, middle dot, blank) are ambiguous and need the score.

Defined results: null, empty and blank fields give no row, nor do entries saying that nothing applies or is still
open; brackets or quotation marks that never close do not protect what follows them; empty values take no position;
repeated rows of an id count once; a null id gives no row; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.session import checkpointed

#: Marks that separate wherever they stand free.
SURE = "，、；;|｜•\n\r\t／"
#: Marks that separate where the records of the source agree on it.
DOUBTFUL = ",/-·+"
#: Entries that say that nothing applies or is still open, in lower case.
NOT_STATED = frozenset(
    "无 不适用 待确认 待定 待填 待补充 未提供 暂无 见包装 详见包装 空 na n/a none nil tbd tbc pending unknown - -- — / ／ not applicable".split(" ")
) | {"not applicable", "to be confirmed", "to be determined"}
#: Headings in front of a list.
HEADINGS = ("配料表", "配料", "原料", "原辅料", "成分", "ingredients", "ingredient list", "ingredient")

_OPEN = {"（": "）", "(": "）", "【": "】", "[": "】", "［": "】", "{": "}", "｛": "}", "《": "》", "〔": "〕", "「": "」", "『": "』", "“": "”"}
_CLOSE = {"）": "）", ")": "）", "】": "】", "]": "】", "］": "】", "}": "}", "｝": "}", "》": "》", "〕": "〕", "」": "」", "』": "』", "”": "”"}
_HEAD = re.compile(
    r"^\s*(?:[【\[（(]\s*(?:%(h)s)\s*[】\]）)]\s*[:：]?|(?:%(h)s)\s*[:：])" % {"h": "|".join(sorted(HEADINGS, key=len, reverse=True))},
    re.IGNORECASE,
)
_UNIT = re.compile(r"(?:mg|g|kg|µg|μg|ug|ml|l|kj|kcal|iu)/(?:mg|g|kg|ml|l|100g|100ml|份)", re.IGNORECASE)
_SPECIAL = re.compile("[%s]" % re.escape("".join(_OPEN) + "".join(_CLOSE) + '"' + SURE + DOUBTFUL))


def free_marks(text: str) -> list[tuple[int, str]]:
    """(position, mark) of every candidate delimiter outside brackets, quotation marks, numbers and units."""
    out: list[tuple[int, str]] = []
    stack: list[str] = []  # what closes each open bracket, with where it began and what was found since
    began: list[int] = []
    i, n = 0, len(text)
    piece = 0  # where the present piece starts: only there a straight quotation mark opens
    closers: dict[str, int] | None = None
    while (m := _SPECIAL.search(text, i)) is not None:
        i = m.start()
        ch = text[i]
        if ch == '"':
            if text[piece:i].strip() == "" or stack:
                j = _quoted_end(text, i)
                if j:
                    i = j
                    continue
            i += 1
            continue
        if ch in _OPEN:
            want = _OPEN[ch]
            if closers is None:
                closers = {c: max(text.rfind(k) for k, v in _CLOSE.items() if v == c) for c in set(_CLOSE.values())}
            if closers[want] > i:  # one that never closes protects nothing
                stack.append(want)
                began.append(len(out))
            i += 1
            continue
        if ch in _CLOSE:
            c = _CLOSE[ch]
            if c in stack:
                while stack.pop() != c:
                    began.pop()
                del out[began.pop() :]
            i += 1
            continue
        if ch == "," and 0 < i < n - 1 and text[i - 1].isdigit() and text[i + 1].isdigit():
            i += 1
            continue
        if ch in "/／" and (u := _UNIT.match(text, max(0, _word_start(text, i)))) and u.start() < i < u.end():
            i += 1
            continue
        out.append((i, ch))
        i += 1
        if not stack and (ch in SURE or ch in DOUBTFUL):
            piece = i
    return out


def _quoted_end(text: str, i: int) -> int:
    """The position after the quotation that opens at ``i``; 0 if it does not close. A doubled mark is one mark."""
    j = i + 1
    while (j := text.find('"', j)) >= 0:
        if text[j + 1 : j + 2] == '"':
            j += 2
            continue
        return j + 1
    return 0


def _word_start(text: str, i: int) -> int:
    while i > 0 and text[i - 1].isascii() and (text[i - 1].isalpha() or text[i - 1] == "µ"):
        i -= 1
    return i


def body(text: str | None) -> str:
    """The list itself: without a heading in front; '' if the field states nothing."""
    if text is None:
        return ""
    t = text.strip()
    t = t[m.end() :].strip() if (m := _HEAD.match(t)) else t
    return "" if t.rstrip("。.").strip().lower() in NOT_STATED else t


def clean(piece: str, last: bool = False) -> str:
    """A value without white space around, the list's full stop and outer quotation marks."""
    p = piece.strip()
    if last:
        p = re.sub(r"[。.]+$", "", p).strip()
    if len(p) > 1 and p[0] == '"' and p[-1] == '"' and _quoted_end(p, 0) == len(p):
        p = p[1:-1].replace('""', '"').strip()
    elif len(p) > 1 and p[0] + p[-1] in ("“”", "「」", "『』", "‘’") and p.find(p[-1]) == len(p) - 1:
        p = p[1:-1].strip()
    return p


def split_values(text: str | None, doubtful: str) -> list[str]:
    """The values in ``text`` in order, where the marks of ``doubtful`` separate besides the sure ones."""
    t = body(text)
    if not t:
        return []
    cuts = [i for i, ch in free_marks(t) if ch in SURE or ch in doubtful and _stands_free(t, i, ch)]
    pieces = [t[a:b] for a, b in zip([0, *[c + 1 for c in cuts]], [*cuts, len(t)])]
    filled = [k for k, p in enumerate(pieces) if p.strip()]
    values = [clean(pieces[k], k == filled[-1]) for k in filled]
    return [v for v in values if v and v.lower() not in NOT_STATED]


def _stands_free(text: str, i: int, ch: str) -> bool:
    """Hyphens, pluses and dots bind words unless blanks stand on both sides."""
    return ch not in "-·+" or text[i - 1 : i].isspace() and text[i + 1 : i + 2].isspace()


def mark_scores(text: str | None) -> list[tuple[str, int, int, int]]:
    """(mark, pieces, regular pieces, own cuts) of every doubtful mark in one record; '' stands for the record itself."""
    t = body(text)
    if not t:
        return []
    marks = free_marks(t)
    out = [("", 0, 0, 0)]
    for d in dict.fromkeys(ch for _, ch in marks if ch in DOUBTFUL):
        cuts = [i for i, ch in marks if ch in SURE or ch == d and _stands_free(t, i, ch)]
        own = sum(t[i] == d for i in cuts)
        if not own:
            continue
        pieces = [t[a:b].strip() for a, b in zip([0, *[c + 1 for c in cuts]], [*cuts, len(t)])]
        regular = sum(not p or _regular(p) for p in pieces)
        out.append((d, len(pieces), regular, own))
    return out


def _regular(piece: str) -> bool:
    """A value is a name: it starts with a letter, bracket or quotation mark and is no bare number or unit."""
    return not re.fullmatch(r"[\d.,%\s]*(?:mg|g|kg|ml|l)?", piece, re.IGNORECASE) and (
        piece[0].isalpha() or piece[0] in '"“「『（(【[' or piece[0].isdigit()
    )


#: A doubtful mark separates in a source if at least this share of its pieces is regular.
REGULAR_SHARE = 0.8
#: And if it cuts this share of the records, or if the variance of its cuts per record is so many times their mean
#: (1 where cuts fall on records one by one, at random).
CUT_SHARE, SPREAD = 1 / 3, 1.5
#: Records that a source must have to be judged by itself.
ENOUGH = 8

_SUMS = ("records", "pieces", "regular", "cuts", "squares")


def _consistent(mark: Column, records: Column) -> Column:
    """Whether the sums of a mark show that it separates, among so many records."""
    return (mark["records"] >= CUT_SHARE * records) | (mark["squares"] / mark["cuts"] - mark["cuts"] / records >= SPREAD)


def source_delimiters(rows: DataFrame, source: str, field: str) -> DataFrame:
    """(source, marks): the doubtful marks that separate in each source, by their scores over all its records."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: dict[tuple, list[int]] = {}
            for s, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for d, pieces, regular, cuts in mark_scores(text):
                    t = total.setdefault((s, d), [0] * len(_SUMS))
                    for k, x in enumerate((1, pieces, regular, cuts, cuts * cuts)):
                        t[k] += x
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in total], pa.string()),
                    pa.array([k[1] for k in total], pa.string()),
                    *(pa.array([v[k] for v in total.values()], pa.int64()) for k in range(len(_SUMS))),
                ],
                names=["source", "mark", *_SUMS],
            )

    def by_mark(keys: list[str], scores: DataFrame) -> DataFrame:
        """The number of records and the sums of each of the handful of marks."""
        return scores.groupBy(*keys).agg(
            F.max(F.when(F.col("mark") == "", F.col("records"))).alias("records"),
            F.collect_list(F.when(F.col("mark") != "", F.struct("mark", *_SUMS))).alias("found"),
        )

    sums = [F.sum(c).alias(c) for c in _SUMS]
    scores = checkpointed(  # few rows a source, read twice below
        rows.select(F.col(source).alias("source"), F.col(field).alias("text"))
        .mapInArrow(score, "source string, mark string, " + ", ".join(f"{c} long" for c in _SUMS))
        .groupBy("source", "mark")
        .agg(*sums)
    )
    pooled = by_mark([], scores.groupBy("mark").agg(*sums))  # one row
    agreed = pooled.select(
        F.transform(F.filter("found", lambda m: _consistent(m, F.col("records"))), lambda m: m["mark"]).alias("agreed")
    ).scalar()
    consistent = lambda m: F.when(F.col("records") >= ENOUGH, _consistent(m, F.col("records"))).otherwise(
        F.array_contains(F.col("agreed"), m["mark"])  # of one row
    )
    separates = F.filter("found", lambda m: (m["regular"] >= REGULAR_SHARE * m["pieces"]) & consistent(m))
    return (
        by_mark(["source"], scores)
        .withColumn("agreed", agreed)
        .select("source", F.array_join(F.array_sort(F.transform(separates, lambda m: m["mark"])), "").alias("marks"))
        .where(F.col("marks") != "")
    )


def packed_values(rows: DataFrame, key: str, source: str, field: str, out: str) -> DataFrame:
    """(key, value_no, out): one row per value with its position from 1."""
    from labelloom.operators.skew import salted_join

    base = rows.where(F.col(key).isNotNull() & F.col(field).isNotNull()).select(
        F.col(key).alias("__key"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(field).alias("__text")
    )
    delims = source_delimiters(base, "source", "__text")
    joined = salted_join(base, delims, ["source"], F.col("__key"), "left").select("__key", "__text", "marks")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, nos, values = [], [], []
            for k, text, marks in zip(*(b.column(i).to_pylist() for i in range(3))):
                for n, v in enumerate(split_values(text, marks or ""), 1):
                    keys.append(k)
                    nos.append(n)
                    values.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(nos, pa.int32()), pa.array(values, pa.string())],
                names=[key, "value_no", out],
            )

    return joined.mapInArrow(split, f"{key} string, value_no int, {out} string").distinct()
