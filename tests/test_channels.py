"""Two readings of a page, the document graph and the summaries on small fixtures."""

from pyspark.sql import functions as F

from labelloom.operators import channels, document_graph, matching, summaries
from tests.conftest import rows

BOX = "struct<x:double,y:double,width:double,height:double,page_height:double>"
L = f"j string, p int, line_id string, line_key string, line_box {BOX}"
S = f"j string, p int, span_id string, span_key string, span_box {BOX}, text string"


def box(x, y, w=50.0, h=10.0):
    return (x, y, w, h, 800.0)


def test_matched_lines(spark):
    lines = [("j", 1, "l1", "abcdef", box(0.0, 10.0)), ("j", 1, "l2", "only", box(0.0, 100.0)), ("j", 1, "l3", "leftright", box(0.0, 200.0, 120.0)), ("j", 1, "l4", "abcdefgh", box(0.0, 300.0)),
             ("j", 1, "l5", "kitchen", box(0.0, 400.0)), ("j", 1, "l6", "nothing", box(0.0, 500.0)), ("j", 1, "l7", "", box(0.0, 10.0)), ("j", 2, "l8", "abcdef", None)]
    spans = [("j", 1, "s1", "abcdef", box(5.0, 11.0), ""), ("j", 1, "s0", "abcdef", box(30.0, 11.0), ""), ("j", 1, "s2", "only", box(0.0, 700.0), ""), ("j", 1, "s4", "left", box(0.0, 200.0), ""), ("j", 1, "s5", "right", box(60.0, 201.0), ""),
             ("j", 1, "s6", "abcdefg", box(0.0, 302.0), ""), ("j", 1, "s7", "kitchxn", box(0.0, 400.0), ""), ("j", 1, "s8", "", box(0.0, 500.0), ""), ("j", 2, "s9", "abcdef", None, "")]
    a, b = spark.createDataFrame(lines, L), spark.createDataFrame(spans, S)
    got = {r.line_id: (r.tier, r.span_ids) for r in channels.matched_lines(a, b, ["j", "p"]).collect()}
    assert got == {"l1": (1, "s1"), "l2": (2, "s2"), "l3": (3, "s4+s5"), "l4": (3, "s6"), "l5": (3, "s7"), "l8": (2, "s9")}
    sure = {r.line_id for r in channels.matched_lines(a, b, ["j", "p"], with_ratio=False).collect()}
    assert sure == {"l1", "l2", "l3", "l4", "l8"}
    assert channels.matched_lines(a.where("false"), b, ["j", "p"]).count() == 0


def test_superseded_spans(spark):
    seg = [("j", 1, "a", "net", box(0.0, 10.0, 20.0)), ("j", 1, "b", "weight", box(30.0, 10.0, 20.0)), ("j", 1, "c", "x", box(52.0, 10.0, 5.0)), ("j", 1, "d", "one", box(0.0, 100.0, 20.0)), ("j", 1, "e", "two", box(22.0, 100.0, 20.0))]
    spans = [("j", 1, "glued", "netweight", box(0.0, 10.0, 60.0), ""), ("j", 1, "near", "onetwo", box(0.0, 100.0, 60.0), ""), ("j", 1, "other", "net", box(0.0, 10.0, 60.0), "")]
    got = channels.superseded_spans(spark.createDataFrame(spans, S), spark.createDataFrame(seg, L), ["j", "p"])
    assert rows(got) == [("j", 1, "glued")]  # the segments of the other stand too near


def test_account(spark):
    one = lambda n: spark.createDataFrame([("j",)] * n, "j string")
    assert rows(channels.fusion_account(one(5), one(1), one(2), one(6), ["j"])) == [("j", 5, 1, 2, 6, True)]
    assert rows(channels.fusion_account(one(5), one(0), one(2), one(6), ["j"])) == [("j", 5, 0, 2, 6, False)]


def test_graph(spark):
    s = spark.createDataFrame([("j", 1, "s1", 0.0, 10.0, 10.0), ("j", 1, "s2", 60.0, 12.0, 10.0), ("j", 1, "s3", 0.0, 40.0, 10.0), ("j", 1, "s4", None, None, None), ("j", 1, "s1", 0.0, 10.0, 10.0)], "job_id string, page int, span_id string, x double, y double, height double")
    r = spark.createDataFrame([("j", "front", "s1"), ("j", "front", None)], "job_id string, region_id string, span_id string")
    c = spark.createDataFrame([("j", "t", "r", "c1", ["s3", "gone", None]), ("j", "t", None, "c2", [])], "job_id string, table_id string, row_key string, cell_id string, span_ids array<string>")
    n, e = document_graph.nodes(s, r, c), document_graph.edges(s, r, c)
    assert {x.kind: x["count"] for x in n.groupBy("kind").count().collect()} == {"page": 1, "text_span": 4, "region": 1, "table": 1, "table_row": 1, "table_cell": 2}
    found = {(x.source, x.target, x.kind) for x in e.collect()}
    assert {("s1", "s2", "same_row"), ("s2", "s3", "above"), ("s1", "s3", "same_column"), ("s1", "region|j|front", "in_region"), ("c1", "gone", "cell_source")} <= found
    assert len({k for _, _, k in found}) == 11
    assert rows(document_graph.edge_faults(n, e)) == [("c1", "gone", "cell_source", "unknown_node")]
    assert rows(document_graph.edges_among(e, spark.createDataFrame([("s1",), ("s2",)], "node_id string")).select("kind")) == [("reading_order",), ("same_row",)]


def test_arbitration(spark):
    data = [("a", "f", "pass"), ("a", "l", "critical_missing"), ("b", "f", "critical_mismatch"), ("b", "l", "pass"), ("c", "f", "critical_mismatch"), ("c", "l", "critical_missing"), ("d", "l", "critical_mismatch"), ("e", "f", "critical_missing")]
    got = {r.t: (r.st, r.source, r.flag) for r in matching.arbitrated(spark.createDataFrame(data, "t string, ch string, st string"), "t", "ch", "st", "f").collect()}
    assert got == {"a": ("pass", "structured", "channels_differ"), "b": ("pass", "lines", None), "c": ("critical_mismatch", "structured", None), "d": ("critical_mismatch", "lines", None), "e": ("critical_missing", "structured", None)}


def test_conflict_clusters(spark):
    data = [("k", "long value here"), ("k", "long value"), ("k", None), ("m", "abc"), ("m", "abcd"), ("n", "one")]
    assert rows(matching.conflict_clusters(spark.createDataFrame(data, "k string, v string"), ["k"], "v")) == [("m", 2, 2)]


def test_summaries(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "x", 2), ("a", "y", 3), ("b", None, 1)], "k string, v string, o int")
    assert rows(summaries.merged_objects(df, ["k"], ["o"], ["v"])) == [("a", "x"), ("b", None)]
    assert rows(summaries.measures(df, ["k"], {"has": F.col("v").isNotNull()}, {"o": F.col("o")})) == [("a", 3, 0.6667, 2.0), ("b", 1, 0.0, 1.0)]
    assert rows(df.select(summaries.is_noise(F.col("v"), ["y"]))) == [(True,)] * 4
    ids = spark.createDataFrame([("table 10",), ("table 2",)], "t string")
    assert [r.t for r in ids.orderBy(*summaries.natural_order(F.col("t"))).collect()] == ["table 2", "table 10"]


def test_page_structure(spark):
    from labelloom.operators import structure

    cols = "p int, span_id string, x double, y double, w double, h double, page_h double"
    t = spark.createDataFrame([(1, "a", 0.0, 100.0, 20.0, 10.0, 800.0), (1, "b", 200.0, 102.0, 20.0, 10.0, 800.0), (1, "c", 0.0, 150.0, 20.0, 10.0, 800.0), (1, "n", None, None, None, None, None)], cols)
    w = {r.span_id: (r.x1, r.x2, r.y1, r.y2) for r in structure.title_windows(t, ["p"]).collect()}
    assert w == {"a": (0.0, 110.0, 94.0, 144.0), "b": (110.0, None, 96.0, 144.0), "c": (0.0, None, 144.0, 285.0)}
    boxes = spark.createDataFrame([(1, "k1", 50.0, 120.0, 800.0), (1, "k2", 150.0, 120.0, 800.0), (1, "k3", 5.0, 790.0, 800.0)], "p int, box_id string, bx double, by_ double, page_h double")
    assert rows(structure.inside(structure.title_windows(t, ["p"]), boxes, ["p"])) == [("a", "k1"), ("b", "k2")]
    runs = spark.createDataFrame([(1, "a", 0.0, 0.0, 9.0, 10.0, 800.0), (1, "b", 0.0, 20.0, 9.0, 10.0, 800.0), (1, "c", 0.0, 60.0, 9.0, 10.0, 800.0)], cols)
    assert [r.run_no for r in structure.column_runs(runs, ["p"]).orderBy("y").collect()] == [1, 1, 2]
    cut = spark.createDataFrame([("净含量：5克 产地：甲",), ("产地：甲",), (None,)], "t string")
    assert rows(cut.select(structure.cut_at_label(F.col("t"), ["产地"]))) == sorted([("净含量：5克",), ("产地：甲",), (None,)], key=repr)
