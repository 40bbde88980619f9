from labelloom.llm.canon import Canon, edit_distance, map_to_catalog
from tests.conftest import rows

ENTRIES = [(1, ["产品名称", "Product Name", "品名"]), (2, ["配料表", "Ingredient List", "配料"]), (30, ["适宜人群", "Suitable Consumers"]), (31, ["不适宜人群", "Unsuitable Consumers"]), (9, ["生产日期"]), (8, ["保质期"])]


def test_resolve():
    c = Canon(ENTRIES)
    for label, want in {
        "产品名称": 1, "Ｐｒｏｄｕｃｔ　Ｎａｍｅ": 1, "产 品 名 称": 1, "產品名稱": 1, "11) 产品名称（必填）": 1, "产品名秤-": 1, "Prodcut Name": 1, "品名：": 1, "产品名称\nProduct Name": 1,
        "不适宜人群": 31, "不适宜人": 31, "适宜群": 30, "配料": 2, "Ingredient_List*": 2, "交货日期": 0, "设计师": 0, "asdf": 0, "---": 0, "": 0,
    }.items():
        assert c.resolve(label) == want, label
    assert c.resolve("List of ingredient") == 0 and c.resolve("Name, Product") == 1 and c.resolve("LIST (Ingredient)") == 2
    assert Canon([]).resolve("产品名称") == 0


def test_edit_distance():
    assert [edit_distance(a, b, 2) for a, b in [("abc", "abc"), ("abc", "acb"), ("abc", "ab"), ("abc", "xyz"), ("", "ab"), ("abcd", "badc")]] == [0, 1, 1, 3, 2, 2]


def test_operator(spark):
    catalog = spark.createDataFrame([(e, n[0], n[1] if len(n) > 1 else None, n[2:] or None, "k") for e, n in ENTRIES] + [(None, "x", "y", None, "k")], "catalog_id int, display_name string, name_en string, aliases array<string>, value string")
    data = [("a", "产品名称", 1), ("b", " 产品名称", 1), ("b", " 产品名称", 2), ("c", None, 1), ("d", " 　", 1), (None, "品名", 1), ("e", "x" * 5000, 1)]
    df = spark.createDataFrame(data, "rec string, label string, catalog_id int")
    out = map_to_catalog(df, "rec", "label", catalog).select("rec_id", "catalog_id").distinct()
    assert rows(out) == [("b", 1), ("e", 0)]
    assert map_to_catalog(df.where("false"), "rec", "label", catalog).count() == 0
    assert rows(map_to_catalog(df.where("rec = 'b'"), "rec", "label", catalog.where("false")).select("catalog_id").distinct()) == [(0,)]


def test_every_name_within_the_budget_is_compared():
    """Against all names: also where many others have more pairs in common, or none is shared."""
    import random

    draw = random.Random(5)
    names = sorted({"".join(draw.choices("abcd", k=draw.randint(3, 24))) for _ in range(400)})
    canon = Canon([(n, [name]) for n, name in enumerate(names, 1)])
    for _ in range(400):
        t = list(draw.choice(names))
        for _ in range(draw.randint(1, 2)):
            t[draw.randrange(len(t))] = draw.choice("abcdx")
        t = "".join(t)
        most = max(1, len(t) // 10)
        found = [(d, e) for e, k in enumerate(names, 1) if (d := edit_distance(t, k, most)) <= most and len(k) > 2 * d]
        closest = [e for d, e in found if d == min(found)[0]]
        assert canon._nearest(t) == (closest[0] if len(closest) == 1 else 0), t
