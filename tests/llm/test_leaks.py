import random

from labelloom.llm.leaks import LeakFinder, block_length, leaking_documents, letters, myers_reach
from tests.conftest import rows

random.seed(5)
WORDS = ["净含量", "复核", "模板", "印刷", "条码", "封口", "label", "panel", "review", "seal"]
ITEM = "，".join("".join(random.choices(WORDS, k=4)) + str(random.randint(10, 99)) for _ in range(16)) + "。"


def prefix_distances(p, t):
    row = list(range(len(p) + 1))
    best = row[:]
    for ch in t:
        now = [row[0] + 1]
        for i, x in enumerate(p, 1):
            now.append(min(row[i] + 1, now[i - 1] + 1, row[i - 1] + (x != ch)))
        row = now
        best = [min(a, b) for a, b in zip(best, row)]
    return best


def test_reach_against_dynamic_programming():
    for _ in range(300):
        p = "".join(random.choices("abcdefgh", k=random.randint(0, 80)))
        t = list(p)
        for _ in range(random.randint(0, 3)):
            if t:
                k = random.randrange(len(t))
                t[k : k + 1] = random.choice([["z"], [], [t[k], "y"]])
        got = myers_reach(p, "".join(t), 6)
        assert got == prefix_distances(p, "".join(t))[: len(got)] and len(got) == len(p) + 1


def test_leaks():
    f = LeakFinder([(1, ITEM), (2, None), (3, "。。")])
    t = letters(ITEM)
    least, b = block_length(len(t))
    assert f.leaked(ITEM) == [1] and f.leaked("x" * 50 + ITEM[: len(ITEM) * 6 // 10] + "y" * 50) == [1]
    spaced = " ".join(ITEM[10 : 10 + len(ITEM) * 6 // 10]).upper()
    assert f.leaked(spaced) == [1]
    noisy = list(t[: least + 6])
    for k in range(11, len(noisy), 25):
        noisy[k] = "错"
    assert f.leaked("".join(noisy)) == [1]
    spoilt = list(t)
    for k in range(0, len(spoilt), 8):
        spoilt[k] = "错"
    for no in ("", None, ITEM[: len(ITEM) // 3], "".join(spoilt), "净含量复核模板" * 100):
        assert f.leaked(no) == []
    assert LeakFinder([]).leaked(ITEM) == []


def test_operator(spark):
    docs = spark.createDataFrame([(1, ITEM, 7), (1, ITEM, 7), (2, "x", 7), (3, None, 7), (None, ITEM, 7), (4, "前" * 20000 + ITEM + "后" * 20000, 7)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(9, ITEM, "zh"), (None, ITEM, "zh"), (8, None, None)], "item_id long, text string, doc_id string")
    assert rows(leaking_documents(docs, items)) == [(1, 9), (4, 9)]
    assert leaking_documents(docs.where("false"), items).count() == 0
    assert leaking_documents(docs, items.where("false")).count() == 0


def test_short_items_off_the_block_grid():
    """Every stretch of half an item is found wherever it starts in the item."""
    from labelloom.llm.leaks import LeakFinder

    for n in range(8, 41):
        item = "abcdefghijklmnopqrstuvwxyz0123456789甲乙丙丁"[:n]
        finder, least = LeakFinder([(1, item)]), -(-n // 2)
        for at in range(n - least + 1):
            assert finder.leaked("天地" + item[at : at + least] + "玄黄") == [1], (n, at)
        if least < 20:  # no letter may differ
            assert finder.leaked("天地" + item[: least - 1] + "玄黄") == []


def test_every_stretch_with_all_its_errors():
    """Stretches of each length with as many errors as they may have, one a block, are found wherever they start."""
    for n in (39, 40, 78, 79, 118, 158, 198, 240):
        item = "".join(chr(0x4E00 + 7 * i) for i in range(n))
        finder, (least, b) = LeakFinder([(1, item)]), block_length(n)
        for length in sorted({least, least + 1, *(20 * k for k in range(1, n // 20 + 1) if least <= 20 * k <= n)}):
            for at in range(n - length + 1):
                first = -at % b  # of the first whole block
                for extra in (0, 1):
                    part = list(item[at : at + length])
                    wrong = length // 20 + extra
                    for k in range(wrong):
                        part[min(first + b // 2 + k * b, length - 2 - (wrong - 1 - k))] = "错"
                    if extra == 0 or length == least:
                        assert finder.leaked("天地" + "".join(part) + "玄黄") == ([1] if not extra else []), (n, length, at)
