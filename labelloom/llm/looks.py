"""Visually identical text brought to one form (problem 1).

A whole Arrow column becomes one numpy array of code points. Two lookup tables give every code point the length and
the place of its replacement; expansion offsets (``repeat`` and ``cumsum``) write all replacements at once; combining
marks are then put in canonical order and composed, one round per position in a run of marks. No string method is
called per row.

What keeps its look: full and half width, presentation forms of the same letters, radicals and compatibility
ideographs, the way an accent is stored, invisible characters, the kind of a space, letters of another script with the
same shape. What does not: case, a space present or absent, other punctuation, raised, lowered and circled figures.

Defined results: null stays null, empty stays empty; blank texts give no pair; texts of any length are folded whole;
an id delivered twice with the same text counts once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql import functions as F

from labelloom.operators.skew import salted_join
from labelloom.session import checkpointed

#: Letters of other scripts (left) with the shape of a Latin letter (right).
LOOKALIKES = (
    "Аa Вb Еe Кk Мm Нh Оo Рp Сc Тt Хx Ѕs Іi Јj Ԍg Ԛq Ԝw Үy "  # Cyrillic capitals, shown by the lower-case letter
    "аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ѵv ӏl ґr "  # Cyrillic small letters
    "Αa Βb Εe Ζz Ηh Ιi Κk Μm Νn Οo Ρp Τt Υy Χx "  # Greek capitals
    "οo νv ρp ιi αa υu κk χx "  # Greek small letters
    "օo սu հh ոn ցg "  # Armenian
    "ɑa ɡg ıi ꞵb"
)
_FOLDED_TAGS = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>", "<vertical>", "<small>"}
_SPACES = {0x09, 0x85, 0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000, 0x1680}
_INVISIBLE_EXTRA = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0x180B, 0x1810), *range(0xE0100, 0xE01F0)}


@cache
def _latin() -> dict[int, int]:
    """Lookalike to Latin letter; capitals map to capitals."""
    out = {}
    for pair in LOOKALIKES.split():
        a, b = pair
        out[ord(a)] = ord(b.upper() if unicodedata.category(a) == "Lu" else b)
    return out


def _expand(cp: int) -> tuple[int, ...] | None:
    """The replacement of one code point, fully decomposed; None if it stands for itself."""
    ch = chr(cp)
    cat = unicodedata.category(ch)
    if cat == "Zs" or cp in _SPACES:
        return (0x20,)
    if cat == "Cf" or cp in _INVISIBLE_EXTRA or (cat == "Cc" and cp not in (0x0A, 0x0D, 0x09)):
        return ()
    if cp in _latin():
        return (_latin()[cp],)
    if 0xAC00 <= cp <= 0xD7A3:
        return None
    d = unicodedata.decomposition(ch)
    if not d:
        return None
    parts = d.split()
    if parts[0].startswith("<"):
        if parts[0] == "<compat>":
            if cat[0] not in "LSN" or cat in ("No", "Sk"):
                return None
        elif parts[0] not in _FOLDED_TAGS:
            return None
        parts = parts[1:]
    out: list[int] = []
    for p in parts:
        sub = _expand(int(p, 16))
        out.extend((int(p, 16),) if sub is None else sub)
    return tuple(out)


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(length, start, pool, combining class, pair keys, pair results), built from the Unicode database by rule."""
    top = 0x110000
    length = np.ones(top, np.uint8)
    start = np.zeros(top, np.uint32)
    ccc = np.zeros(top, np.uint8)
    pool: list[int] = [0]  # place 0 marks a code point that stands for itself
    pairs: dict[int, int] = {}
    for lo, hi in ((0, 0x3400), (0xA000, 0xAC00), (0xF900, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE0200)):
        for cp in range(lo, hi):
            if 0xD800 <= cp < 0xE000:
                continue
            ch = chr(cp)
            ccc[cp] = unicodedata.combining(ch)
            r = _expand(cp)
            if r is not None:
                length[cp] = len(r)
                start[cp] = len(pool)
                pool.extend(r)
            d = unicodedata.decomposition(ch)
            if d and not d.startswith("<") and len(two := d.split()) == 2 and unicodedata.normalize("NFC", ch) == ch:
                pairs[(int(two[0], 16) << 21) | int(two[1], 16)] = cp
    keys = np.array(sorted(pairs), np.int64)
    return length, start, np.array(pool, np.uint32), ccc, keys, np.array([pairs[k] for k in keys.tolist()], np.uint32)


def _compose(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order and composition of marks; ``row`` is each code point's row. Marks never cross rows."""
    _, _, _, ccc, keys, made = tables()
    cls = ccc[cp]
    marks = np.flatnonzero(cls)
    if not len(marks):
        return cp, row
    # a run is a maximal stretch of marks within a row; its base is the code point before it
    new_run = np.ones(len(marks), bool)
    new_run[1:] = (np.diff(marks) != 1) | (row[marks[1:]] != row[marks[:-1]])
    run = np.cumsum(new_run) - 1
    order = np.lexsort((np.arange(len(marks)), cls[marks], run))  # stable by class within each run
    cp = cp.copy()
    cp[marks] = cp[marks[order]]
    cls = ccc[cp]
    first = marks[new_run]
    base = first - 1
    has_base = (first > 0) & (row[np.maximum(base, 0)] == row[first])
    rank = np.arange(len(marks)) - np.flatnonzero(new_run)[run]
    alive = np.ones(len(cp), bool)
    last = np.zeros(len(first), np.int16)  # class of the last mark of each run that was kept
    by_rank = np.argsort(rank, kind="stable")
    bounds = np.searchsorted(rank[by_rank], np.arange(rank.max() + 2))
    for a, b in zip(bounds[:-1], bounds[1:]):
        at = by_rank[a:b]
        at = at[has_base[run[at]]]
        pos, r = marks[at], run[at]
        free = (last[r] < cls[pos]) | (last[r] == 0)
        key = (cp[base[r]].astype(np.int64) << 21) | cp[pos]
        k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        joined = free & (keys[k] == key)
        cp[base[r[joined]]] = made[k[joined]]
        alive[pos[joined]] = False
        last[r[~joined]] = cls[pos[~joined]]
    return cp[alive], row[alive]


def fold(texts: pa.Array) -> pa.Array:
    """The one form of every text of an Arrow string column."""
    texts = texts.cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    filled = pc.fill_null(texts, "") if texts.null_count else texts
    offsets = np.frombuffer(filled.buffers()[1], np.int64, n + 1, filled.offset * 8)
    data = filled.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    if not len(raw):
        return texts.cast(pa.string())
    cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    begins = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[offsets - offsets[0]]  # byte to code point offsets
    row = np.repeat(np.arange(n), np.diff(begins))
    length, start, pool = tables()[:3]
    many = length[cp].astype(np.int64)
    begin = start[cp].astype(np.int64)
    own = begin == 0
    ends = np.cumsum(many)
    total = int(ends[-1])
    within = np.arange(total) - np.repeat(ends - many, many)
    out = np.repeat(cp, many)
    swap = np.repeat(~own, many)
    out[swap] = pool[(np.repeat(begin, many) + within)[swap]]
    out, row = _compose(out, np.repeat(row, many))
    wide = 1 + (out > 0x7F).astype(np.int64) + (out > 0x7FF) + (out > 0xFFFF)
    sizes = np.bincount(row, weights=wide, minlength=n).astype(np.int64) if len(row) else np.zeros(n, np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    utf8 = out.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    made = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(utf8)])
    if texts.null_count:
        made = pc.if_else(texts.is_valid(), made, pa.scalar(None, pa.large_string()))
    return made.cast(pa.string())


def with_look(df: DataFrame, text: str, look: str = "look") -> DataFrame:
    """``df`` with the one form of column ``text`` in a new column ``look``; rows and partitions stay as they are."""
    schema = T.StructType([*df.schema.fields, T.StructField(look, T.StringType())])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, fold(b.column(at))], names=[*b.schema.names, look])

    return df.mapInArrow(run, schema)


def written_looks(rows: DataFrame, groups: list[str], key: str, text: str) -> DataFrame:
    """(groups, id, txt, look): each id with the 128-bit digests of its text and of its look, blank looks left out.

    From here on texts are only compared, so their digests travel in their place. They are written once: every text is
    read and folded a single time, whatever reads them afterwards.
    """
    base = rows.where(F.col(key).isNotNull() & F.col(text).isNotNull() & (F.length(F.trim(text)) > 0)).select(
        *groups, F.col(key).alias("id"), F.col(text).alias("txt")
    )
    for g in groups:
        base = base.where(F.col(g).isNotNull())
    digest = lambda c: F.unhex(F.md5(c)).alias(c)
    return checkpointed(with_look(base, "txt").where(F.length(F.trim("look")) > 0).select(*groups, "id", digest("txt"), digest("look")))


def look_counts(looks: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_ids, n_forms): looks written in at least two ways, with their distinct (id, text) and texts.

    Both counts are combined map-side over (look, text), so a look of a third of all rows is one row per map task and text.
    """
    ids = looks.groupBy(*by, "txt", "id").agg(F.lit(1).alias("one"))
    forms = ids.groupBy(*by, "txt").agg(F.count(F.lit(1)).alias("n"))
    return forms.groupBy(*by).agg(F.sum("n").alias("n_ids"), F.count(F.lit(1)).alias("n_forms")).where(F.col("n_forms") > 1)


def same_look_classes(rows: DataFrame, groups: list[str], key: str, text: str) -> DataFrame:
    """(groups, id, class_id, n_forms, n_links): each id that looks like another one but is written differently.

    ``class_id`` is the look's digest, ``n_forms`` in how many ways the look is written, ``n_links`` how many (id, text)
    of the class are written otherwise. One row per id and text, whatever the size of the class.
    """
    looks = written_looks(rows, groups, key, text)
    by = [*groups, "look"]
    own = looks.groupBy(*by, "txt").agg(F.countDistinct("id").alias("own"))
    classes = look_counts(looks, by)
    linked = own.join(classes, by).select(*by, "txt", "own", "n_ids", "n_forms")
    member = looks.groupBy(*by, "txt", "id").agg(F.lit(1).alias("one")).drop("one")
    return salted_join(member, linked, [*by, "txt"], F.col("id"), "inner").select(
        *groups, "id", F.lower(F.hex("look")).alias("class_id"), "n_forms", (F.col("n_ids") - F.col("own")).alias("n_links")
    )


def same_look_pairs(rows: DataFrame, groups: list[str], key: str, text: str, hot_rows: int = 2_000) -> DataFrame:
    """(rec_a, rec_b): pairs of different ids within ``groups`` whose texts look the same and are different strings.

    Only looks written in at least two ways are joined. Such a look with more than ``hot_rows`` rows has its rows
    spread over salts on one side and repeated on the other, so no task holds all of its pairs.
    """
    looks = written_looks(rows, groups, key, text)
    by = [*groups, "look"]
    # Hot looks are known only after counting; the count is combined map-side and never larger than the distinct looks.
    ways = looks.groupBy(*by).agg(F.min("txt").alias("lo"), F.max("txt").alias("hi"), F.count(F.lit(1)).alias("n"))
    several = ways.where(F.col("lo") != F.col("hi")).select(
        *by, F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(hot_rows))).cast("int").alias("parts")
    )
    written = salted_join(looks, several, by, F.xxhash64("id", "txt"), "inner").groupBy(*by, "id", "txt").agg(F.max("parts").alias("parts"))
    left = written.withColumn("part", F.pmod(F.xxhash64("id", "txt"), F.col("parts")).cast("int")).drop("parts")
    right = written.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    a = left.select(*by, "part", F.col("id").alias("rec_a"), F.col("txt").alias("txt_a"))
    b = right.select(*by, "part", F.col("id").alias("rec_b"), F.col("txt").alias("txt_b"))
    return (
        a.join(b, [*by, "part"])
        .where((F.col("rec_a") < F.col("rec_b")) & (F.col("txt_a") != F.col("txt_b")))
        .select("rec_a", "rec_b")
        .distinct()
    )
