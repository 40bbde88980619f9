from pyspark.sql import functions as F

from labelloom.operators import compare, extract, fusion, graph, metrics, quality, sequences, sets
from labelloom.operators.skew import salted_join
from tests.conftest import rows


def test_sequences(spark):
    df = spark.createDataFrame([("a", 1, "x", 1.0), ("a", 2, None, 1.5), ("a", 4, "y", 9.0), ("b", 1, None, 0.0)], "g string, o int, t string, v double")
    assert rows(sequences.carried(df, ["g"], ["o"], F.col("t"), "c").select("g", "o", "c")) == [("a", 1, "x"), ("a", 2, "x"), ("a", 4, "y"), ("b", 1, None)]
    assert rows(sequences.asof_marker(df, ["g"], ["o"], F.col("t").isNotNull(), "o").select("g", "o", "marker")) == [("a", 1, None), ("a", 2, 1), ("a", 4, 1), ("b", 1, None)]
    assert rows(sequences.missing_numbers(df, ["g"], "o")) == [("a", 3, 3)]
    assert rows(sequences.sliding_frames(df.na.fill("-"), ["g"], "o", "t", 2, 3).select("first", "n_lines", "text")) == [(1, 2, "x-"), (1, 3, "x-y"), (2, 2, "-y")]
    assert rows(sequences.mean_clusters(df, ["g"], "v", "o", 1.25).select("g", "o", "cluster_no")) == [("a", 1, 1), ("a", 2, 1), ("a", 4, 2), ("b", 1, 1)]
    assert rows(sequences.packed_chunks(df, ["g"], "o", "o", 2, 100).select("g", "o", "chunk_no")) == [("a", 1, 1), ("a", 2, 1), ("a", 4, 2), ("b", 1, 1)]
    assert rows(sequences.adjacent_edges(df, ["g"], ["o"], "o").select("source", "target")) == [(1, 2), (2, 4)]
    lines = spark.createDataFrame([(1, "a\r\n\n b"), (2, None), (3, "")], "k int, t string")
    assert rows(sequences.exploded_lines(lines, ["k"], "t")) == [(1, 1, "a"), (1, 3, " b")]


def test_sets(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (None, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (3, "q")], "k int, v string")
    assert rows(sets.multiset_overlap(a, b, ["v"])) == [("q", 0, 1, 0, 0, 1), ("x", 2, 1, 1, 1, 0), ("y", 1, 0, 0, 1, 0), ("z", 1, 0, 0, 1, 0)]
    assert rows(sets.plan_diff(a.distinct(), b, ["k"], "v")) == [(2, "remove"), (3, "add"), (None, "remove")]
    assert rows(sets.union_first_wins([b, a], ["v"], ["k"])) == [(1, "x"), (2, "y"), (3, "q"), (None, "z")]
    assert rows(sets.except_by(a, b, ["v"])) == [(2, "y"), (None, "z")]
    assert rows(sets.duplicates(a, ["v"])) == [("x", 2)]


def test_salted_join_equals_plain_join(spark):
    left = spark.createDataFrame([("hot", n) for n in range(100)] + [("a", 1), (None, 2), ("b", 3)], "k string, n int")
    right = spark.createDataFrame([("hot", "h"), ("a", "A"), (None, "N")], "k string, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = salted_join(left, right, ["k"], F.col("n"), how, hot_rows=10)
        assert rows(got) == rows(left.join(right, "k", how)), how


def test_match_status(spark):
    items = spark.createDataFrame(
        [("i1", "j", "k", "净含量：10克", True, False, 1), ("i2", "j", "k", "abcdefgh", True, False, 1), ("i3", "j", "k", "zzz", True, False, 1), ("i4", "j", "k", "x", False, False, 1), ("i5", "j", "k", "x", True, True, 1), ("i1", "j", "k", "later", True, False, 2), ("i6", "j", "k", " ", True, False, 1)],
        "id string, job_id string, semantic_key string, text string, comparison_required boolean, review_required boolean, ingested_at int",
    )
    cands = spark.createDataFrame(
        [("c1", "i1", "净含量:１０ 克", 0.5, ["l1"]), ("c0", "i1", "净含量", 0.9, None), ("c2", "i2", "abcdefgx", 0.1, ["l"]), ("c3", "i3", "qqq", 0.9, ["l"])],
        "candidate_id string, target_id string, text string, score double, source_ocr_line_ids array<string>",
    )
    got = {r.target_id: (r.status, r.candidate_id) for r in compare.match_status(compare.standard_targets(items), cands).collect()}
    assert got == {"i1": ("pass", "c1"), "i2": ("critical_mismatch", "c2"), "i3": ("critical_missing", None), "i4": ("manual_review", None), "i5": ("manual_review", None)}


def test_greedy_pairs(spark):
    df = spark.createDataFrame([("g", "a", "x", 0.9), ("g", "a", "y", 0.8), ("g", "b", "x", 0.85), ("g", "b", "y", 0.1), ("h", "a", "x", 0.5)], "g string, l string, r string, s double")
    assert rows(compare.greedy_pairs(df, ["g"], "l", "r", "s")) == [("g", "a", "x", 0.9), ("g", "b", "y", 0.1), ("h", "a", "x", 0.5)]


def test_compile_fields(spark):
    plan = spark.createDataFrame([("f1", "critical", 2, "s2", 0, 2), ("f1", "critical", 1, "s1", 1, 3), ("f2", "normal", 1, "s1", 2, 9), ("f3", "normal", 1, "zz", 0, 1)], "field_id string, criticality string, range_no int, span_id string, start_offset int, end_offset int")
    spans = spark.createDataFrame([("s1", "abcd", (1.0,)), ("s2", "xy", None)], "span_id string, text string, bbox_pdf struct<x:double>")
    fields, rejects = extract.compile_fields(plan, spans)
    assert rows(fields.select("field_id", "raw_value", "confidence", "review_required")) == [("f1", "bcxy", 0.8, True)]
    assert rows(rejects.select("field_id", "reject_reason")) == [("f2", "bad_range"), ("f3", "unknown_span")]
    claimed = plan.withColumn("text", F.lit("cd"))
    assert rows(extract.repaired_ranges(claimed.where("span_id = 's1' and range_no = 1 and field_id = 'f1'"), spans)) == [("f1", 1, "s1", 2, 4, "moved")]


def test_best_overlap_equals_brute_force(spark):
    import random

    random.seed(1)
    box = lambda: (random.uniform(0, 900), random.uniform(0, 900), random.uniform(1, 300), random.uniform(1, 300))
    b, s = {f"l{n}": box() for n in range(40)}, {f"s{n}": box() for n in range(40)}
    kind = "g int, line_id string, box struct<x:double,y:double,width:double,height:double>"
    got = fusion.best_overlap(spark.createDataFrame([(1, k, v) for k, v in b.items()] + [(1, "null", None)], kind), spark.createDataFrame([(1, k, v) for k, v in s.items()], kind.replace("line_id", "span_id").replace("box ", "bbox ")), ["g"])

    def ratio(p, q):
        w = max(0, min(p[0] + p[2], q[0] + q[2]) - max(p[0], q[0]))
        h = max(0, min(p[1] + p[3], q[1] + q[3]) - max(p[1], q[1]))
        return round(w * h / min(max(p[2] * p[3], 1), max(q[2] * q[3], 1)), 4)

    want = {}
    for k, p in b.items():
        best = max((ratio(p, q), n) for n, q in s.items())
        if best[0] >= 0.2:
            want[k] = best[1]
    assert {r.line_id: r.span_id for r in got.collect()} == want


def test_contract(spark):
    t = {
        "a": spark.createDataFrame([("1", "x", ["p"]), ("1", "y", ["q"]), ("2", None, None)], "id string, t string, refs array<string>"),
        "b": spark.createDataFrame([("p", "has x")], "id string, s string"),
    }
    rules = [
        quality.row_rule("text", "a", "id", {"no_text": F.col("t").isNull()}),
        quality.unique_rule("unique", "a", "id", level="medium"),
        quality.reference_rule("refs", "a", "id", F.col("refs"), [("b", "id")]),
        quality.text_rule("evidence", "a", "id", "t", "refs", "b", "id", "s"),
        quality.route_rule("route", "a", "id", F.col("t") == "y", "b", "id"),
        quality.aggregate_rule("some", "b", F.count(F.lit(1)) == 0),
    ]
    report = {r.check: (r.result, r.n_failures) for r in quality.contract_report(rules, t).collect()}
    assert report == {"text": ("failed", 1), "unique": ("failed", 1), "refs": ("failed", 1), "evidence": ("passed", 0), "route": ("failed", 1), "some": ("passed", 0)}
    risks = quality.risks_of(quality.failures_of(rules, t))
    assert {(r.target_id, r.risk_level) for r in risks.collect()} == {("1", "high"), ("2", "high")}
    assert quality.review_tasks_of(risks).count() == 2


def test_graph_and_metrics(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("a", "c", "x"), ("z", "b", "y")], "source string, target string, edge_type string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node_id string")
    assert rows(graph.unresolved_edges(nodes, edges)) == [("z", "b", "y")]
    assert rows(graph.neighbours(edges, 1).select("source", "target")) == [("a", "b"), ("z", "b")]
    e = spark.createDataFrame([("j", 1), ("j", 2)], "g string, k int")
    a = spark.createDataFrame([("j", 2), ("h", 3)], "g string, k int")
    assert rows(metrics.recall_precision(e, a, ["g"], ["k"])) == [("h", 0, 1, 0, 1.0, 0.0), ("j", 2, 1, 1, 0.5, 1.0)]
