"""Texts that make careless patterns slow: every scanner must stay near linear."""

import time

import pytest

from labelloom.llm import canon, leaks, places, residue, scans

N = 6000
TEXTS = {
    "ideographs": "字" * N, "letters": "a" * N, "digits": "1" * N, "digits_end": "1" * 200 + "z", "blanks": " " * N + "x", "brackets": "(" * N, "pairs": "()" * (N // 2),
    "quotes": '"' * N, "hyphens": "a-" * (N // 2), "streets": "路1" * (N // 2), "english": "street road " * (N // 12), "braces": "{" * N, "lines": "\n" * N, "keys": "asdf" * (N // 4) + "!", "test": "测试" * (N // 2) + "x",
}


@pytest.mark.parametrize("name", list(TEXTS))
def test_linear(name, spark):
    text = TEXTS[name]
    gazetteer = places.Gazetteer({"p": set(), "c": {"linyang"}, "d": set()}, {}, places.spelling(spark))
    v = scans.Vocabulary({"street": 9, "#": 50}, {}, (2, 2))
    tree, listed, finder = residue.TemplateTree(), canon.Canon([(1, ["产品名称"])]), leaks.LeakFinder([(1, "abc字" * 60)])
    began = time.perf_counter()
    gazetteer.read(text)
    places.marked_names(text, gazetteer.spelling)
    residue.is_residue(text, tree)
    listed.resolve(text)
    v.misread(text)
    scans.broken_end(text, None)
    scans.page_number_alone(text)
    scans.split_header(text)
    finder.leaked(text)
    assert time.perf_counter() - began < 10
