from pyspark.sql import functions as F

from labelloom.operators import grounding, layout, tables
from tests.conftest import rows


def test_words_and_atoms(spark):
    words = spark.createDataFrame([(1, 0.0, 10.0, 0.0, 10.0, "a"), (1, 12.0, 20.0, 1.0, 11.0, "b"), (1, 80.0, 90.0, 0.5, 10.5, "c"), (1, 0.0, 9.0, 30.0, 40.0, "d")], "p int, x0 double, x1 double, top double, bottom double, text string")
    lined = layout.words_to_lines(words, ["p"])
    assert rows(layout.line_spans(lined, ["p"]).select("line_no", "span_no", "text")) == [(1, 1, "a b"), (1, 2, "c"), (2, 1, "d")]
    chars = spark.createDataFrame([(1, 0.0, 5.0, "a"), (1, 5.0, 10.0, "b"), (1, 10.0, 12.0, " "), (1, 12.0, 17.0, "c"), (1, 40.0, 45.0, "d"), (1, 46.0, 47.0, "\x01")], "l int, x0 double, x1 double, text string")
    assert rows(layout.atoms(chars, ["l"]).groupBy("atom_no").agg(F.count("text").alias("n")).select("n")) == [(1,), (1,), (2,)]


def test_rows_and_paragraphs(spark):
    s = spark.createDataFrame([(1, 5.0, 0.0), (1, 0.0, 0.6), (1, 0.0, 1.2), (2, 0.0, 9.0)], "p int, x double, y double")
    assert rows(layout.rows_by_first(s, ["p"], 1.0).select("p", "y", "row_no")) == [(1, 0.0, 1), (1, 0.6, 1), (1, 1.2, 2), (2, 9.0, 1)]
    lines = spark.createDataFrame([(1, 0.1, y / 100, y / 100 + 0.02) for y in (0, 3, 6, 30)] + [(1, 0.5, 0.0, 0.02)], "p int, x1 double, y1 double, y2 double")
    assert sorted(r.block_no for r in layout.paragraphs(lines, ["p"]).collect()) == [1, 1, 1, 2, 3]


def test_labels(spark):
    df = spark.createDataFrame([(1, "产地：甲 保质期: 9个月"), (2, "无标签"), (3, None)], "k int, t string")
    assert rows(layout.label_segments(df, ["k"], "t", ["产地", "保质期", "质期"])) == [(1, 1, "产地", "甲"), (1, 2, "保质期", "9个月")]
    assert rows(layout.longest_labels(df, "k", "t", ["产地", "保质期", "质期"])) == [(1, "产地", 0), (1, "保质期", 5)]
    spans = df.select("k", F.col("k").alias("ord"), F.col("k").cast("string").alias("span_id"), "t").withColumn("g", F.lit(1))
    assert rows(layout.first_matches(spans, ["g"], "ord", "t", {"o": "产地", "s": "标签"}).select("semantic_key", "span_id")) == [("o", "1"), ("s", "2")]


def test_titles_bands_cover(spark):
    s = spark.createDataFrame([(1, n, t) for n, t in enumerate(["T", "r1", "r2", "x", "r3", "T", "r4"])], "g int, o int, t string")
    found = layout.rows_after_title(s, ["g"], "o", F.col("t") == "T", F.col("t").startswith("r"))
    assert rows(found.select("table_no", "t")) == [(1, "r1"), (1, "r2"), (2, "r4")]
    lines = spark.createDataFrame([("p", "l1", 0.05), ("p", "l2", 0.2), ("p", "l3", 0.6)], "d string, line_id string, y double")
    anchors = spark.createDataFrame([("p", "a1", 0.1), ("p", "a2", 0.5)], "d string, anchor_id string, y double")
    assert rows(layout.bands(lines, anchors, ["d"])) == [("p", "l2", "a1"), ("p", "l3", "a2")]
    tab = spark.createDataFrame([("p", "t1", 0.1, 0.5, 0.30)], "d string, table_id string, x1 double, x2 double, y1 double")
    titles = spark.createDataFrame([("p", "h1", 0.1, 0.4, 0.29), ("p", "h2", 0.6, 0.9, 0.29), ("p", "h3", 0.1, 0.4, 0.24), ("p", "h4", 0.1, 0.4, 0.1)], "d string, title_id string, x1 double, x2 double, y2 double")
    assert rows(layout.nearest_title(tab, titles, ["d"]).select("table_id", "title_id")) == [("t1", "h1")]
    texts = spark.createDataFrame([("p", 1, "aaaa"), ("p", 2, "bbbb"), ("p", 3, "cccc"), ("p", 4, "aaaa")], "d string, ord int, text string")
    want = spark.createDataFrame([("p", "t", "aaaabbbbcccc"), ("p", "u", "aaaaccccbbbb"), ("p", "v", "bb")], "d string, target_id string, expected string")
    assert rows(layout.sequence_cover(want, texts, ["d"])) == [("p", "t", 3, 1)]
    blocks = spark.createDataFrame([(1, n, "x" if n == 3 else "-") for n in range(6)], "g int, o int, t string")
    assert [r.o for r in layout.with_neighbours(blocks, ["g"], "o", F.col("t") == "x").orderBy("o").collect()] == [2, 3, 4]
    assert layout.round_robin(blocks, "g", F.col("t") == "x", ["o"], 2).collect()[0].o == 3


def test_tables(spark):
    head = spark.createDataFrame([("d", "1", "表一", 1)], "doc string, table_no string, title string, ord int")
    det = spark.createDataFrame([("d", "1", 1, "能量", "810", None), ("d", "1", 2, "钠", " ", ""), ("d", "2", 3, "钠", None, "1%")], "doc string, table_no string, ord int, item string, amount string, nrv string")
    joined = tables.joined_tables(head, det, ["doc"])
    assert rows(joined.select("table_no", "title", "item")) == [("1", "表一", "能量"), ("2", None, "钠")]
    assert rows(tables.table_text(joined, ["table_no"])) == [("1", "能量 810"), ("2", "钠 1%")]
    cells = spark.createDataFrame([("t", 1, 1, "项目", "钠"), ("t", 1, 2, "每100g", "5"), ("t", 1, 3, "x", "9"), ("t", 1, 4, "y", "8"), ("t", 2, 1, "item", "糖")], "t string, row_no int, col_no int, column string, text string")
    assert rows(tables.fixed_columns(cells, ["t"])) == [("t", 1, "钠", "5", "9 8"), ("t", 2, "糖", "", "")]
    assert rows(tables.table_issues(cells, ["t"])) == [("t", 2, 5, 0, "ragged")]
    copies = spark.createDataFrame([("k", "b", 1.0, 3, False, True), ("k", "a", 1.0, 3, False, True), ("k", "c", 0.5, 9, False, True)], "k string, table_id string, alignment double, n_rows int, review_required boolean, exact_title boolean")
    kept, removed = tables.best_tables(copies, ["k"])
    assert [r.table_id for r in kept.collect()] == ["a"] and removed.count() == 2


def test_grounding(spark):
    src = spark.createDataFrame([("s1", "净含量："), ("s2", "10 克")], "source_id string, text string")
    items = spark.createDataFrame([("a", "净含量10克", ["s1", "s2"]), ("b", "12克", ["s2"]), ("c", "10克", ["zz"]), ("d", "10克", None), ("e", " ", ["s1"])], "item_id string, text string, source_ids array<string>")
    kept, rejected = grounding.grounded(items, src)
    assert [r.item_id for r in kept.collect()] == ["a"]
    assert {r.item_id: r.reason for r in rejected.collect()} == {"b": "not_in_source", "c": "unknown_source", "d": "no_source", "e": "empty_text"}
    l = spark.createDataFrame([("x", ["1", "2", "2"])], "l string, i array<string>")
    r = spark.createDataFrame([("y", ["2", "3"]), ("z", ["9"])], "r string, j array<string>")
    assert rows(grounding.overlapping_sets(l, r, [], "l", "i", "r", "j", 0.5)) == [("x", "y", 1)]
    base = spark.createDataFrame([("k", "long text"), ("m", None)], "k string, t string")
    rep = spark.createDataFrame([("k", "short"), ("m", "new"), ("n", "added")], "k string, t string")
    assert rows(grounding.upserted(base, rep, ["k"], "t")) == [("k", "long text"), ("m", "new"), ("n", "added")]
    dec = spark.createDataFrame([("x", "accepted", 1), ("x", "rejected", 2), ("?", "accepted", 3)], "l string, decision string, o int")
    assert rows(grounding.last_decisions(l.select("l"), dec, "l", "o")) == [("x", "rejected")]
