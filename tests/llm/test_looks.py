import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from labelloom.llm import looks
from tests.conftest import rows


def fold(*texts):
    return looks.fold(pa.array(texts, pa.string())).to_pylist()


def slow(text):
    """The same form, a character at a time."""
    out = "".join(ch if (r := looks._expand(ord(ch))) is None else "".join(map(chr, r)) for ch in text)
    return unicodedata.normalize("NFC", out)


def test_same_looks():
    for a, b in [("ＡＢ　１", "AB 1"), ("é", "é"), ("а́", "á"), ("a​b﻿", "ab"), ("a b", "a b"), ("ｶﾞ", "ガ"), ("ガ", "ガ"), ("⾷品", "食品"), ("精", "精"), ("Ѕоlе", "Sole"), ("Νｅt", "Net"), ("，", ","), ("ậ", "ậ"), ("ﬁ", "fi")]:
        assert fold(a) == fold(b), (a, b)
    for a, b in [("A", "a"), ("a b", "ab"), ("a.", "a,"), ("m²", "m2"), ("①", "1"), ("β", "b"), ("、", ","), ("—", "-")]:
        assert fold(a) != fold(b), (a, b)


def test_nulls_order_and_slices():
    assert fold(None, "", "ａ", None, "é" * 1000) == [None, "", "a", None, "é" * 1000]
    assert looks.fold(pa.array(["x", "ａ", None, "ｂ"]).slice(1, 3)).to_pylist() == ["a", None, "b"]
    assert looks.fold(pa.array([], pa.string())).to_pylist() == []
    assert fold("́x", "a" + "́" * 300)[0] == "́x"


@given(st.lists(st.text(st.characters(exclude_categories=("Cs",)), max_size=12), max_size=6))
@settings(max_examples=400, deadline=None)
def test_equals_the_slow_form(texts):
    got = fold(*texts)
    for t, g in zip(texts, got):
        if not any(unicodedata.combining(c) == 0 and unicodedata.normalize("NFC", "a" + c) != "a" + c or "ᄀ" <= c <= "ᇿ" for c in t):
            assert unicodedata.normalize("NFD", g) == unicodedata.normalize("NFD", slow(t)), t
    assert fold(*got) == got


def test_pairs_equal_brute_force(spark):
    data = [(f"s{n}", f"j{n % 3}", t, "x") for n, t in enumerate(["Net", "Νet", "Net", "Ｎet", None, " ", "​", "net"] * 6)] + [("s0", "j0", "Net", "x"), (None, "j0", "Net", "x")]
    df = spark.createDataFrame(data, "rec string, job string, txt string, look string")
    want = set()
    for a in data:
        for b in data:
            if a[0] and b[0] and a[0] < b[0] and a[1] == b[1] and a[2] and b[2] and slow(a[2]).strip() and a[2] != b[2] and slow(a[2]) == slow(b[2]):
                want.add((a[0], b[0]))
    for hot in (2, 10_000):
        assert rows(looks.same_look_pairs(df, ["job"], "rec", "txt", hot)) == sorted(want)
    assert looks.same_look_pairs(df.where("false"), ["job"], "rec", "txt").count() == 0


def test_classes_hold_all_links(spark):
    data = [(f"s{n}", f"j{n % 3}", t) for n, t in enumerate(["Net", "Νet", "Net", "Ｎet", None, " ", "net"] * 6)] + [("s0", "j0", "Net"), (None, "j0", "Net")]
    df = spark.createDataFrame(data, "rec string, job string, txt string")
    pairs = rows(looks.same_look_pairs(df, ["job"], "rec", "txt"))
    got = looks.same_look_classes(df, ["job"], "rec", "txt").collect()
    want = {}
    for a, b in pairs:
        want[a], want[b] = want.get(a, 0) + 1, want.get(b, 0) + 1
    assert {r.id: r.n_links for r in got} == want and len(got) == len(want)
    assert len({r.class_id for r in got}) == 1 and {r.n_forms for r in got} == {3}
    assert looks.same_look_classes(df.where("false"), ["job"], "rec", "txt").count() == 0
