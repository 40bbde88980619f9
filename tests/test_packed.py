from hypothesis import given, settings
from hypothesis import strategies as st

from labelloom.operators.packed import body, packed_values, split_values
from tests.conftest import rows


def test_rules():
    assert split_values('配料：小麦粉、植物油（大豆油，棕榈油）、"复配,B型 ""老街"""、浓缩汁1,700mg/kg／糖。', ",/") == ["小麦粉", "植物油（大豆油，棕榈油）", '复配,B型 "老街"', "浓缩汁1,700mg/kg", "糖"]
    assert split_values("Pea protein / Oil (a/b [max 5%, dry]) / Salt 1,300 mg", ",/") == ["Pea protein", "Oil (a/b [max 5%, dry])", "Salt 1,300 mg"]
    assert split_values("β-胡萝卜素 / D-异抗坏血酸钠", ",/-") == ["β-胡萝卜素", "D-异抗坏血酸钠"]
    assert split_values("a，，b； ；c", ",") == ["a", "b", "c"]
    assert split_values("“甲、乙”；丙", "") == ["甲、乙", "丙"]
    assert split_values("甲（乙，丙", "") == ["甲（乙", "丙"]  # a bracket that never closes protects nothing
    for nothing in (None, "", "  ", "无", "不适用", "待确认。", "N/A", "配料：无"):
        assert split_values(nothing, ",/") == []
    assert body("Ingredients: Salt") == "Salt"


@given(st.text(alphabet='甲乙ab,，、"“”()（）[]/ .。|\n1', max_size=40))
@settings(max_examples=300, deadline=None)
def test_never_fails_and_keeps_letters(text):
    out = split_values(text, ",/")
    assert all(v.strip() == v and v for v in out)
    assert sum(v.count("甲") for v in out) == body(text).count("甲")


def test_operator(spark):
    data = [("r1", "s", "糖、盐，水", "x", 1), ("r1", "s", "糖、盐，水", "x", 1), ("r2", "s", None, None, None), (None, "s", "糖", None, None), ("r3", None, "Salt, Oil" + ", Oil" * 3000, None, None)]
    df = spark.createDataFrame(data, "k string, job string, raw string, source string, mark int")
    out = packed_values(df, "k", "job", "raw", "v")
    assert rows(out.where("k <> 'r3'")) == [("r1", 1, "糖"), ("r1", 2, "盐"), ("r1", 3, "水")]
    assert out.where("k = 'r3'").count() == 3002
    assert packed_values(df.where("false"), "k", "job", "raw", "v").count() == 0


def test_consistency(spark):
    """A mark inside one value of one record does not separate in a source that shows enough records; lists still do."""
    data = [(f"a{n}", "plain", "Sugar；Oil；Malt" if n else "Salt, iodised；Oil / fat；Malt") for n in range(12)]
    data += [(f"b{n}", "mixed", "Sugar；Oil" if n % 4 else "Salt, Oil, Malt, Honey / Egg / Rice") for n in range(12)]
    data += [(f"c{n}", "lists", "Salt, Oil / Malt") for n in range(12)]
    data += [("d1", "single", "Salt, Oil / Malt")]
    df = spark.createDataFrame(data, "k string, job string, raw string")
    got: dict = {}
    for k, _, v in rows(packed_values(df, "k", "job", "raw", "v")):
        got.setdefault(k, []).append(v)
    assert got["a0"] == ["Salt, iodised", "Oil / fat", "Malt"]
    assert got["b0"] == ["Salt", "Oil", "Malt", "Honey", "Egg", "Rice"]
    assert got["c3"] == got["d1"] == ["Salt", "Oil", "Malt"]  # a source of one row follows the others
