import difflib
import unicodedata

from pyspark.sql import functions as F

from labelloom.functions import geometry as geo
from labelloom.functions import text as tx
from labelloom.functions import values as val


def one(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first()[0]


def test_compare_key(spark):
    cases = {"净含量： １０.0 克": "净含量:10克", "A×B——C": "axb-c", "≥5%，X": ">=5%,x", None: None, "": "", " 3.05 ": "3.05"}
    for t, want in cases.items():
        assert one(spark, "t string", (t,), tx.compare_key(F.col("t"))) == want
    assert one(spark, "t string", ("ﬁ ①",), tx.compare_key(F.col("t"), True)) == "fi1"
    assert one(spark, "t string", ("Ⅳ",), tx.nfkc(F.col("t"))) == unicodedata.normalize("NFKC", "Ⅳ")


def test_labels_and_rows(spark):
    assert one(spark, "t string", ("保质期：9个月",), tx.label_part(F.col("t"))) == "保质期"
    assert one(spark, "t string", ("保质期：9个月",), tx.value_part(F.col("t"))) == "9个月"
    assert one(spark, "t string", ("能量 810 千焦 10%",), tx.split_row(F.col("t"))) == ("能量", "810 千焦", "10%")
    assert one(spark, "t string", ("能量 810",), tx.split_row(F.col("t"))) == ("能量", "810", "")
    assert one(spark, "t string", ("<b>a</b> &lt; **b**",), tx.without_markup(F.col("t"))) == "a < b"
    assert one(spark, "t string", ("甲（乙",), tx.issue_of_value(F.col("t"))) == "unbalanced_brackets"
    assert one(spark, "t string", ("mail a@b.co token=xyz /root/x",), tx.redacted(F.col("t"))) == "mail <email> token=<redacted> <path>"


def test_scores(spark):
    score = tx.match_score(F.col("a"), F.col("b"), F.col("l"))
    for a, b, want in [("abc", "abc", 1.0), ("abc", "xabcx", 0.65), ("xabcx", "abc", 0.45), ("", "a", 0.0), ("abcd", "abxd", difflib.SequenceMatcher(None, "abcd", "abxd").ratio())]:
        assert abs(one(spark, "a string, b string, l boolean", (a, b, False), score) - want) < 1e-9
    long = one(spark, "a string, b string, l boolean", ("aaa,bbb", "zzaaa,bbbzz", True), score)
    assert long >= 0.82
    assert one(spark, "a string, b string, l boolean", ("aaa,bbb,ccc,ddd", "aaa", True), score) <= 0.68


def test_gtin(spark):
    for code, want in [("4006381333931", "passed"), ("4006381333932", "bad_check_digit"), ("123", "bad_length"), ("40063813339a1", "bad_characters"), ("96385074", "passed"), ("036000291452", "passed")]:
        assert one(spark, "t string", (code,), val.gtin_status(F.col("t"))) == want


def test_ratios_and_ids(spark):
    assert one(spark, "n int, d int", (1, 0), val.rate_or_null(F.col("n"), F.col("d"))) is None
    assert one(spark, "n int, d int", (0, 0), val.rate_or_one(F.col("n"), F.col("d"))) == 1.0
    assert one(spark, "n int", (7,), val.stable_id("x", F.col("n"))) == "x_0007"
    assert one(spark, "t string", ('```json {"a": {"b": 1}} ```',), val.first_json_object(F.col("t"))) == '{"a": {"b": 1}}'


BOX = "struct<x:double,y:double,width:double,height:double,page_width:double,page_height:double>"


def test_boxes(spark):
    a, b = (0.0, 0.0, 10.0, 10.0, 100.0, 200.0), (5.0, 5.0, 10.0, 10.0, 100.0, 200.0)
    s = f"a {BOX}, b {BOX}"
    assert one(spark, s, (a, b), geo.overlap_area(F.col("a"), F.col("b"))) == 25.0
    assert one(spark, s, (a, b), geo.overlap_ratio(F.col("a"), F.col("b"))) == 0.25
    assert one(spark, s, (a, None), geo.overlap_area(F.col("a"), F.col("b"))) == 0.0
    assert one(spark, s, (a, b), geo.same_row(F.col("a"), F.col("b"))) is True
    assert tuple(one(spark, s, (a, b), geo.unit_box(F.col("b")))) == (0.05, 0.025, 0.15, 0.075)
    assert one(spark, s, (None, b), geo.unit_box(F.col("a"))) is None
    assert one(spark, s, ((-1.0, 0.0, 0.0, 5.0, 10.0, 10.0), b), geo.box_violations(F.col("a"))) == ["empty", "negative"]
