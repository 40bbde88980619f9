"""Address records that denote the same place (problem 7).

A gazetteer is built from the records themselves. Names that carry a level mark (province, city, district) give the
administrative names and what lies in what; street spellings are clustered within their locality (city and kind of
street) and each cluster gets one identifier. Every address is resolved by a beam search over the gazetteer: its parts
are read as administrative names, street, number and unit in any order, marked or not, and the best reading wins.
Records are then joined on (city, street identifier, number, unit).

Chinese and English spellings meet in one alphabet, that of the syllables, in which typed homophones coincide too. The
readings of all ideographs come from the Unicode library that Spark brings along, not from a list.
English slips and unknown characters are mended by the street gazetteer: a spelling that is no sequence of syllables
takes the best supported spelling of its locality that differs by one letter or one syllable.

Defined results: null, blank and texts without a street and number give no pair, nor do equal texts of these kinds; a
unit must be equal or absent on both sides; equal spellings of an address are always a pair; postal codes, remarks in
brackets and headings are not read; repeated rows of an id count once; a text of any length is read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.operators.skew import salted_join
from labelloom.session import balanced, checkpointed

#: A gazetteer of administrative names larger than this is not sent to the executors.
MAX_ADMIN = 500_000
#: A name must be marked with its level in so many different addresses.
ADMIN_SUPPORT = 2
#: Readings of an address that are kept while it is read.
BEAM = 12

#: Readings in names of places of characters that have others.
IN_NAMES = "长chang 地di 重chong 厦xia 都du 乐le 会hui 六liu 石shi 朝chao 行hang 单shan 尉wei 蔚wei 大da 堡bao 番pan 浒hu"
#: Characters of names (left) and those of like shape that are typed for them (right).
TYPED_FOR = "锦绵 清靖 野墅 枝技"
#: Sides in English names of streets, by their syllables; in Chinese they stand last.
_EN_SIDES = {"east": "dong", "west": "xi", "south": "nan", "north": "bei", "middle": "zhong", "central": "zhong"}
KINDS = {"大道": "avenue", "路": "road", "街": "street", "巷": "lane", "弄": "lane", "胡同": "lane"}
#: What an address without a street is numbered in.
ESTATES = ("花园", "小区", "新村", "社区", "工业园", "产业园", "园区", "广场", "大厦", "村", "苑")
_EN_KINDS = {"street": "street", "st": "street", "str": "street", "road": "road", "rd": "road", "lane": "lane", "ln": "lane", "avenue": "avenue", "ave": "avenue", "av": "avenue", "boulevard": "avenue", "blvd": "avenue"}
_EN_LEVELS = {"province": "p", "prov": "p", "city": "c", "district": "d", "dist": "d", "county": "d"}
_ZH_LEVELS = {"省": "p", "市": "c", "区": "d", "县": "d"}
_ZH = re.compile(r"[一-鿿]")
_DIGIT = {c: str(i) for i, c in enumerate("零一二三四五六七八九")} | {"〇": "0", "○": "0", "两": "2"}

_HEAD = re.compile(r"^\s*(?:(?:生产|注册|经营|公司|工厂|通讯|联系)?(?:地址|厂址|住所)|(?:manufacturer )?address|addr)\s*[:：]\s*", re.I)
_POSTCODE = re.compile(r"[,，\s]{0,3}(?:P\.?\s?C\.?|post ?code|zip(?: code)?|邮编|邮政编码)\s*[:：]?\s*\d{6}|(?:^|(?<=[,，\s]))\d{6}(?=$|[,，\s])", re.I)
_ZH_NUM = r"(?:\d+|[零〇○一二两三四五六七八九十百]+)"
_ZH_STREET = re.compile(
    rf"(?P<kind>大道|路|街|巷|弄|胡同)(?P<side>[东西南北中](?=\s*(?:No|第|{_ZH_NUM})))?\s*[-·,]?\s*(?:No\.?\s*|第)?(?P<num>{_ZH_NUM})\s*(?:号(?!楼|院)|#(?!楼))?(?P<rest>.*)$", re.I
)
_ZH_ESTATE = re.compile(rf"(?P<kind>{'|'.join(ESTATES)})(?P<side>)(?:No\.?\s*|第)?(?P<num>{_ZH_NUM})\s*号(?!楼|院)(?P<rest>.*)$", re.I)
_ZH_UNIT = re.compile(rf"^[\s\-·,之]*(?:(?P<n>{_ZH_NUM})\s*(?:号楼|#楼|幢|栋|座|号院|单元)|(?:Building|Bldg|Block)\.?\s*(?P<m>\d+))", re.I)
_EN_UNIT = re.compile(r"\b(?:building|bldg|block|blk|unit)\b\.?\s*(?:no\.?\s*)?#?(\d+)", re.I)
_EN_STREET = re.compile(
    r"(?:\bno\.?\s*|#)?(?P<before>(?<!\d)\d{1,9})?[\s,]{0,9}(?<![A-Za-z'])(?P<name>[A-Za-z'](?:[A-Za-z']*+ {1,3}){0,4}?[A-Za-z']*+)\s{1,9}(?P<kind>street|str|st|road|rd|lane|ln|avenue|ave|av|boulevard|blvd)\b\.?[\s,]*(?:(?:no\.?\s*|#)?(?P<after>\d+))?",
    re.I,
)


class Spelling:
    """The reading of every character, and simplified for traditional ones."""

    def __init__(self, table: dict[str, str], simple: dict[int, str]):
        self.table, self.simple = table, simple
        syllables = sorted(set(table.values()), key=len, reverse=True)
        self._syllable = "|".join(syllables)
        # within a name a syllable begins with a consonant; others are set off with an apostrophe
        self._sound = re.compile(rf"(?:{self._syllable})(?:(?![aeo])(?:{self._syllable})){{0,4}}")

    def __reduce__(self):
        return Spelling, (self.table, self.simple)

    def spelled(self, name: str) -> str:
        """A name in syllables; characters without a known reading stay as they are."""
        return "".join(self.table.get(ch, ch) for ch in name)

    def is_sound(self, spelling: str) -> bool:
        """Whether a spelling is written as a sequence of known syllables."""
        return self._sound.fullmatch(spelling) is not None

    def keys(self, street: str) -> list[str]:
        """What two spellings that differ by one letter or one syllable have in common."""
        out = {street} | {street[:i] + street[i + 1 :] for i in range(len(street))}
        if not street.isascii():  # a character without a reading stands for any syllable
            out |= {re.sub(r"[^a-z]", "*", street)}
        elif self.is_sound(street):
            for i in range(1, len(street)):
                head, tail = street[:i], street[i:]
                if re.fullmatch(self._syllable, head) and re.fullmatch(self._syllable, tail):
                    out |= {f"*{tail}", f"{head}*"}
        return sorted(out)


_SPELLINGS: dict[str, Spelling] = {}


def spelling(spark: SparkSession) -> Spelling:
    """Readings of all ideographs and their simplified forms, by the Unicode library that Spark brings along.

    It runs in the driver's JVM, once a session; the table of some 20 000 characters goes to the executors.
    """
    app = spark.sparkContext.applicationId
    if app not in _SPELLINGS:
        library = spark._jvm.com.ibm.icu.text.Transliterator
        chars = [chr(c) for c in range(0x4E00, 0xA000)]
        read = library.getInstance("Han-Latin").transliterate("|".join(chars)).split("|")
        plain = ("".join(c for c in unicodedata.normalize("NFD", r) if c.isascii() and c.isalpha()).lower() for r in read)
        table = {ch: r for ch, r in zip(chars, plain) if r}
        table |= {x[0]: x[1:] for x in IN_NAMES.split()}
        table |= {typed: table[ch] for ch, typed in TYPED_FOR.split()}
        simple = library.getInstance("Traditional-Simplified").transliterate("".join(chars))
        _SPELLINGS.clear()
        _SPELLINGS[app] = Spelling(table, {ord(a): b for a, b in zip(chars, simple) if a != b})
    return _SPELLINGS[app]


def _number(text: str) -> str:
    """A number in digits."""
    if text.isdigit():
        return text.lstrip("0") or "0"
    if "十" in text or "百" in text:
        total, digit = 0, 0
        for ch in text:
            if ch == "百":
                total, digit = total + (digit or 1) * 100, 0
            elif ch == "十":
                total, digit = total + (digit or 1) * 10, 0
            else:
                digit = int(_DIGIT.get(ch, "0"))
        return str(total + digit)
    return "".join(_DIGIT.get(ch, "") for ch in text).lstrip("0") or "0"


def _plain(raw: str, simple: dict[int, str]) -> str:
    t = unicodedata.normalize("NFKC", raw).translate(simple)
    t = _without_brackets(_HEAD.sub("", " ".join(t.split())))
    return _POSTCODE.sub(" ", t).strip(" \t\r\n,，。.;；")


def _without_brackets(t: str) -> str:
    """``t`` without what stands in brackets, however deep; a bracket without its other half stays."""
    if "(" not in t and "[" not in t and "【" not in t:
        return t
    open_at: list[int] = []
    drop: list[tuple[int, int]] = []
    for i, ch in enumerate(t):
        if ch in "([【":
            open_at.append(i)
        elif ch in ")]】" and open_at:
            start = open_at.pop()
            while drop and drop[-1][0] > start:
                drop.pop()
            drop.append((start, i + 1))
    out, at = [], 0
    for a, b in drop:
        out += [t[at:a], " "]
        at = b
    return " ".join("".join([*out, t[at:]]).split())


class Gazetteer:
    """Administrative names by level, and what lies in what."""

    def __init__(self, names: dict[str, set[str]], city_of: dict[str, str], spelling: Spelling):
        self.spelling = spelling
        self.names = names  # 'p', 'c', 'd' -> spellings
        self.city_of = city_of  # district -> its city, where there is only one

    def level(self, name: str, mark: str = "") -> str:
        """The level of a name; a mark decides if the name is known there or nowhere."""
        if mark:
            return mark
        return next((k for k in "cdp" if name in self.names.get(k, ())), "")

    def read(self, raw: str | None) -> tuple | None:
        """(province, city, district, kind, street, number, unit) of an address; None without street and number."""
        t = _plain(raw or "", self.spelling.simple)
        if not t:
            return None
        return self._chinese(t) if re.search(r"[一-鿿]", t) else self._english(t)

    # -- Chinese: parts in any order, names possibly run together
    def _chinese(self, t: str) -> tuple | None:
        return self._chinese_by(t, _ZH_STREET) or self._chinese_by(t, _ZH_ESTATE)

    def _chinese_by(self, t: str, street_of: re.Pattern) -> tuple | None:
        parts = [p for p in re.split(r"[,，、\s·]+|(?<=[一-鿿])-(?=[一-鿿])", t) if p]
        found, admin, k = None, [], 0
        while k < len(parts):
            m = None if found else street_of.search(parts[k])
            if not m and not found and k + 1 < len(parts) and re.search(r"(?:大道|路|街|巷|弄|胡同)$", parts[k]):
                parts[k : k + 2] = [parts[k] + parts[k + 1]]  # the number stands apart
                m = street_of.search(parts[k])
            if m:
                rest = m["rest"] + " " + " ".join(parts[k + 1 : k + 2])
                unit = _ZH_UNIT.match(m["rest"]) or _ZH_UNIT.match(rest.strip())
                found = (m["kind"], _number(m["num"]), _number(unit["n"] or unit["m"]) if unit else "", m["side"] or "")
                admin.append((parts[k][: m.start("kind")], True))
            elif not _ZH_UNIT.match(parts[k]):
                admin.append((parts[k], False))
            k += 1
        if not found:
            return None
        place = {"p": "", "c": "", "d": ""}
        street = ""
        for text, has_street in admin:
            levels, rest = self._beam(text, has_street, place)
            for lv, name in levels:
                place[lv] = place[lv] or name
            if has_street:
                street = rest
        if not street:
            return None
        return self._placed(place, KINDS.get(found[0], "estate"), self.spelling.spelled(street + found[3]), found[1], found[2])

    def _beam(self, text: str, has_street: bool, place: dict) -> tuple[list[tuple[str, str]], str]:
        """The best reading of names run together: (level, name) of each, and what is left for the street."""
        beam: list[tuple[float, int, tuple]] = [(0.0, 0, ())]
        best: tuple[float, tuple, str] | None = None
        for _ in range(5):
            nxt = []
            for score, at, levels in beam:
                rest = text[at:]
                if has_street and rest:
                    known = 1.0 if len(rest) == 2 else 0.4 if len(rest) in (1, 3) else -0.5 * (len(rest) - 3)
                    if best is None or score + known > best[0]:
                        best = (score + known, levels, rest)
                elif not rest and (best is None or score > best[0]):
                    best = (score, levels, "")
                for n in (2, 3, 4, 1):
                    name, mark = rest[:n], rest[n : n + 1]
                    if len(name) < n or has_street and len(rest) <= n:
                        continue
                    s = self.spelling.spelled(name)
                    if mark in _ZH_LEVELS and not any(ch in _ZH_LEVELS for ch in name):
                        lv = _ZH_LEVELS[mark]
                        nxt.append((score + (2.2 if s in self.names.get(lv, ()) else 1.2 - 0.2 * abs(n - 2)), at + n + 1, (*levels, (lv, s))))
                    for lv in "pcd":
                        if s in self.names.get(lv, ()) and lv not in [x for x, _ in levels]:
                            fits = lv != "d" or self._fits(s, place, levels)
                            nxt.append((score + (1.5 if fits else 0.6), at + n, (*levels, (lv, s))))
            if not nxt:
                break
            beam = sorted(nxt, key=lambda x: -x[0])[:BEAM]
        return (list(best[1]), best[2]) if best else ([], text if has_street else "")

    def _fits(self, district: str, place: dict, levels: tuple) -> bool:
        city = dict(levels).get("c") or place["c"]
        return not city or self.city_of.get(district) in (None, city)

    # -- English: parts between commas or dashes
    def _english(self, t: str) -> tuple | None:
        unit = _EN_UNIT.search(t)
        rest = t[: unit.start()] + " , " + t[unit.end() :] if unit else t
        m = None
        for m in _EN_STREET.finditer(rest):
            if m["before"] or m["after"]:
                break
        if not m:
            return None
        number = m["before"] or m["after"]
        if not number:  # the number may be a part of its own, before or after the street
            alone = re.search(r"(?:^|[,\-])\s*(?:no\.?\s*|#)?(\d+)\s*(?=$|[,\-])", rest, re.I)
            number = alone[1] if alone else ""
        if not number:
            return None
        place = {"p": "", "c": "", "d": ""}
        for part in re.split(r"\s*[,;]\s*|\s+-\s+|(?<=[a-z.])-(?=[A-Z])", rest[: m.start()] + " , " + rest[m.end() :]):
            words = re.findall(r"[A-Za-z]+", part.lower())
            if not words:
                continue
            mark = _EN_LEVELS.get(words[-1], "") if len(words) > 1 else ""
            name = "".join(words[:-1] if mark else words)
            lv = self.level(name, mark)
            if lv and not place[lv]:
                place[lv] = name
        words = re.findall(r"[a-z]+", m["name"].lower().split(" no ")[-1])
        if len(words) > 1:  # a side comes last, as in Chinese
            words = [w for w in words if w not in _EN_SIDES] + [_EN_SIDES[w] for w in words if w in _EN_SIDES]
        street = "".join(words)
        return self._placed(place, _EN_KINDS[m["kind"].lower()], street, _number(number), _number(unit[1]) if unit else "")

    def _placed(self, place: dict, kind: str, street: str, number: str, unit: str) -> tuple:
        city = place["c"] if place["c"] in self.names.get("c", ()) else ""
        city = city or self.city_of.get(place["d"], "") or place["c"]
        return place["p"], city, place["d"], kind, street, number, unit


_MARKED_EN = re.compile(r"(?<![A-Za-z])(?P<name>[A-Za-z]++(?: [A-Za-z]++)?)\s+(?P<mark>Province|Prov|City|District|Dist)\b", re.I)


def marked_names(raw: str | None, spelling: Spelling) -> dict[str, str]:
    """The names of an address that carry their level mark."""
    t = _plain(raw or "", spelling.simple)
    out: dict[str, str] = {}
    if re.search(r"[一-鿿]", t):
        for part in re.split(r"[,，、\s·]+|-", t):
            rest = part
            while (m := re.match(r"([一-鿿]{2,3}?)([省市区])", rest)) is not None:
                out.setdefault(_ZH_LEVELS[m[2]], spelling.spelled(m[1]))
                rest = rest[m.end() :]
    else:
        for m in _MARKED_EN.finditer(t):
            lv = _EN_LEVELS[m["mark"].lower()]
            out.setdefault(lv, re.sub(r"[^a-z]", "", m["name"].lower().split("  ")[-1]))
    return out


def build_gazetteer(addresses: DataFrame, spelling: Spelling) -> Gazetteer:
    """The administrative gazetteer of distinct addresses: counts are made distributed, only the names are fetched.

    Administrative names are a closed set; their number is checked before they are fetched.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c: Counter = Counter()
            for raw in b.column(0).to_pylist():
                names = marked_names(raw, spelling)
                for lv, n in names.items():
                    c[lv, n, ""] += 1
                if "c" in names and "d" in names:
                    c["in", names["d"], names["c"]] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in c], pa.string()) for i in range(3)] + [pa.array(list(c.values()), pa.int64())],
                names=["level", "name", "city", "n"],
            )

    counts = (
        addresses.mapInArrow(emit, "level string, name string, city string, n long")
        .groupBy("level", "name", "city")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= ADMIN_SUPPORT)
    )
    rows = counts.take(MAX_ADMIN + 1)
    if len(rows) > MAX_ADMIN:
        raise ValueError(f"more than {MAX_ADMIN} administrative names")
    names: dict[str, set[str]] = {"p": set(), "c": set(), "d": set()}
    within: dict[str, Counter] = {}
    for r in rows:
        if r.level == "in":
            within.setdefault(r.name, Counter())[r.city] += r.n
        else:
            names[r.level].add(r.name)
    city_of = {}
    for d, cities in within.items():
        (city, n), *others = cities.most_common(2)
        if not others or n >= 5 * others[0][1]:
            city_of[d] = city
    return Gazetteer(names, city_of, spelling)


def same_places(records: DataFrame, key: str, address: str) -> DataFrame:
    """(rec_a, rec_b): pairs of different records at the same place."""
    return _pairs(located_records(records, key, address))


def place_classes(records: DataFrame, key: str, address: str) -> DataFrame:
    """(rec, class_id, n_links): each record that shares a place with others; one row per record and place.

    ``class_id`` is the first record of the place, ``n_links`` the number of the others.
    """
    located = located_records(records, key, address)
    sizes = located.groupBy("place").agg(F.min("rec").alias("class_id"), (F.count(F.lit(1)) - 1).alias("n_links")).where(F.col("n_links") > 0)
    return salted_join(located, sizes, ["place"], F.col("rec"), "inner").select("rec", "class_id", "n_links")


def located_records(records: DataFrame, key: str, address: str) -> DataFrame:
    """(rec, place): each record whose address is one, with its place."""
    base = records.where(F.col(key).isNotNull() & F.col(address).isNotNull()).select(
        F.col(key).alias("rec"), F.col(address).alias("raw")
    )
    sounds = spelling(records.sparkSession)
    distinct = balanced(base.select("raw").distinct())  # few bytes and much to do with each
    gaz = build_gazetteer(distinct, sounds)
    columns = ["province", "city", "district", "kind", "street", "number", "unit"]

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(0).to_pylist()
            read = [gaz.read(x) for x in raw]
            ok = [i for i, x in enumerate(read) if x]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(ok, pa.int64()))]
                + [pa.array([read[i][k] for i in ok], pa.string()) for k in range(7)]
                + [pa.array([read[i][4].isascii() if _ZH.search(raw[i]) else sounds.is_sound(read[i][4]) for i in ok], pa.bool_())],
                names=["raw", *columns, "sound"],
            )

    schema = "raw string, " + ", ".join(f"{c} string" for c in columns) + ", sound boolean"
    # one resolution per distinct text; three joins below read it, so it is written once
    places = checkpointed(distinct.mapInArrow(resolve, schema))
    places = _with_city(places)
    streets = _street_ids(places, sounds)
    keyed = places.join(streets, ["city", "kind", "number", "street"]).select(
        "raw", F.concat_ws("|", "city", "kind", "street_id", "number", "unit").alias("place")
    )
    return _located(base, keyed)


def _with_city(places: DataFrame) -> DataFrame:
    """Fill a missing city from other addresses: the same district, or province, street and number, in one city only."""
    known = places.where(F.col("city") != "")
    by_street = (
        known.where(F.col("sound"))
        .groupBy(F.col("province").alias("province"), "kind", "street", "number")
        .agg(F.min("city").alias("lo"), F.max("city").alias("hi"))
        .where((F.col("lo") == F.col("hi")) & (F.col("province") != ""))
        .select("province", "kind", "street", "number", F.col("lo").alias("__city"))
    )
    missing = places.where(F.col("city") == "").join(by_street, ["province", "kind", "street", "number"], "left")
    return known.unionByName(missing.withColumn("city", F.coalesce("__city", F.lit(""))).drop("__city"))


def _street_ids(places: DataFrame, sounds: Spelling) -> DataFrame:
    """(city, kind, number, street, street_id): the spelling that each spelling of a locality stands for.

    A doubtful spelling takes the best supported neighbour with the same house number, if that is written more often
    there; one that nothing else speaks for takes the best supported neighbour of the locality. Doubtful is what is no
    sequence of syllables, or is not written in Chinese with its number. A spelling is attested if it is a sequence of syllables that someone
    writes in Chinese or that occurs more than once in the locality. Neighbours are found among the streets of a
    locality, whatever their number of houses, by what both spellings have in common.
    """
    # read four times below: a short lineage keeps the plan, and with it the driver's memory, small
    spellings = checkpointed(
        places.groupBy("city", "kind", "number", "street").agg(
            F.count(F.lit(1)).alias("n"), F.max("sound").alias("sound"), F.max(F.col("raw").rlike("[一-鿿]")).alias("zh")
        )
    )
    doubtful = ~F.col("sound") | ~F.col("zh")
    streets = spellings.groupBy("city", "kind", "street").agg(
        F.max("sound").alias("sound"), (F.max("sound") & (F.max("zh") | (F.sum("n") > 1))).alias("attested"), F.max(doubtful).alias("doubtful"), F.sum("n").alias("n")
    )
    keyed = _keyed(streets.where(F.col("doubtful") | F.col("sound")), sounds)
    odd = keyed.where("doubtful").select("city", "kind", "k", F.col("street").alias("odd"), F.col("sound").alias("odd_sound"), F.col("attested").alias("odd_attested"))
    good = keyed.where("sound").select("city", "kind", "k", F.col("street").alias("to"), F.col("n").alias("to_n"), F.col("attested").alias("to_attested"))
    met = checkpointed(  # few doubtful spellings meet others; read twice
        odd.join(good, ["city", "kind", "k"])
        # a sound spelling is mended only by a letter, not by a syllable, which makes another name, and only to an attested one
        .where((F.col("odd") != F.col("to")) & (~F.col("odd_sound") | F.col("to_attested") & ~F.col("k").contains("*")))
        .select("city", "kind", "odd", "odd_attested", "to", "to_n")
        .distinct()
    )
    housed = spellings.where("sound").select("city", "kind", "number", F.col("street").alias("to"), F.col("n").alias("here"))
    near = (
        spellings.where(doubtful).select("city", "kind", "number", F.col("street").alias("odd"), F.col("n").alias("own"))
        .join(met, ["city", "kind", "odd"])
        .join(housed, ["city", "kind", "number", "to"])
        .where(~F.col("odd_attested") | (F.col("here") > F.col("own")))
        .groupBy("city", "kind", "number", "odd")
        .agg(F.max_by("to", F.struct("here", "to")).alias("near"))
    )
    wide = met.where(~F.col("odd_attested")).groupBy("city", "kind", "odd").agg(F.max_by("to", F.struct("to_n", "to")).alias("wide"))
    return (
        spellings.select("city", "kind", "number", "street", F.col("street").alias("odd"))
        .join(near, ["city", "kind", "number", "odd"], "left")
        .join(wide, ["city", "kind", "odd"], "left")
        .select("city", "kind", "number", "street", F.coalesce("near", "wide", "street").alias("street_id"))
    )


def _keyed(streets: DataFrame, sounds: Spelling) -> DataFrame:
    """``streets``, a row for each key of the spelling in ``k``."""
    at = streets.columns.index("street")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            many = [sounds.keys(s) for s in b.column(at).to_pylist()]
            rows = pa.array([i for i, ks in enumerate(many) for _ in ks], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(c.take(rows) for c in b.columns), pa.array([k for ks in many for k in ks], pa.string())],
                names=[*b.schema.names, "k"],
            )

    return streets.mapInArrow(keys, T.StructType([*streets.schema.fields, T.StructField("k", T.StringType())]))


def _located(base: DataFrame, keyed: DataFrame) -> DataFrame:
    """(rec, place): each record with its place, written once."""
    return checkpointed(salted_join(base, keyed, ["raw"], F.col("rec"), "inner").select("rec", "place").distinct())


def _pairs(located: DataFrame, hot_rows: int = 2_000) -> DataFrame:
    """Pairs of records with the same place; a place with many records is spread over salts."""
    sizes = located.groupBy("place").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    sized = salted_join(
        located, sizes.select("place", F.ceil(F.col("n") / F.lit(hot_rows)).cast("int").alias("parts")), ["place"], F.col("rec"), "inner"
    )
    a = sized.select("place", F.pmod(F.xxhash64("rec"), F.col("parts")).cast("int").alias("part"), F.col("rec").alias("rec_a"))
    b = sized.select("place", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("rec").alias("rec_b"))
    return a.join(b, ["place", "part"]).where(F.col("rec_a") < F.col("rec_b")).select("rec_a", "rec_b").distinct()
