from datetime import datetime

from labelloom.operators.references import broken_references, reference_report
from tests.conftest import rows

T1, T2, T3 = datetime(2025, 1, 1), datetime(2025, 2, 1), datetime(2025, 3, 1)
ITEM = "id string, source_ids array<string>, evidence_refs array<string>, created_at timestamp, ingested_at timestamp, seen string, ref_id int"
EV = "evidence_id string, ingested_at timestamp, deleted_at timestamp, gone string"


def frames(spark, items, evidence, spans=(), lines=()):
    return (
        spark.createDataFrame(list(items), ITEM),
        spark.createDataFrame(list(evidence), EV),
        spark.createDataFrame(list(spans), "span_id string, ingested_at timestamp"),
        spark.createDataFrame(list(lines), "ocr_line_id string, ingested_at timestamp"),
    )


def test_states(spark):
    items = [
        ("a", ["SP_1 ", "ol_1", "ol_9", None, ""], ["ev_1", " EV_2", "ev_3", "sp_1"], T1, T2, "x", 1),
        ("a", None, ["ev_3", "ev_3"], T1, T1, "x", 1),  # an earlier delivery of the same item
        ("b", None, None, T1, T1, None, None),
        (None, ["zz"], ["zz"], T1, T1, None, None),
    ]
    evidence = [("ev_1", T1, None, "g"), ("ev_2", T1, T3, None), ("ev_2", T2, None, None), ("ev_3", T3, None, None), ("ev_3", T2, None, None), (None, T1, None, None)]
    out = broken_references(*frames(spark, items, evidence, [("sp_1", T1)], [("OL_1", T2), (None, T1)]))
    assert rows(out.drop("period")) == [
        ("a", "evidence_refs", "ev_2", "deleted"),
        ("a", "evidence_refs", "ev_3", "late"),
        ("a", "evidence_refs", "sp_1", "missing"),
        ("a", "source_ids", "ol_1", "late"),
        ("a", "source_ids", "ol_9", "missing"),
    ]
    report = {tuple(r)[:3]: r.n_refs for r in reference_report(out).collect()}
    assert report[("evidence_refs", "2025-01", "missing")] == 1


def test_hot_parent_gives_the_same_rows(spark):
    items = [(f"i{n}", None, ["ev_hot" if n % 3 else f"ev_{n}"], T1, T1, None, None) for n in range(300)]
    f = frames(spark, items, [("ev_hot", T2, None, None), ("ev_0", T1, None, None)])
    assert rows(broken_references(*f, hot_rows=10)) == rows(broken_references(*f, hot_rows=10_000))


def test_empty_tables(spark):
    assert broken_references(*frames(spark, [], [])).count() == 0
    assert rows(broken_references(*frames(spark, [("a", ["x"], None, None, None, None, None)], [])).drop("period")) == [("a", "source_ids", "x", "missing")]
