"""A valid result passes every check; each mutation fails exactly the checks that it breaks."""

import pytest
from pyspark.sql import functions as F

from labelloom.operators.quality import contract_report
from labelloom.plans.result_contract import EXPORT_CHECKS, RESULT_TABLES, ROOT, result_contract, with_empty

VALID = {
    "job": [("j", "done")],
    "document": [("d", "a.pdf", "sha256:" + "0" * 64, 1, [1.0])],
    "metadata": [("d", True, list(EXPORT_CHECKS), "2025-01-01T00:00:00", list(ROOT))],
    "spans": [("s1",)],
    "evidence": [("e1", "净含量：10克", 1, ["pdf_text"], "available", True)],
    "fields": [("f1", "k", "10克", "10克", None, "compiled", "critical", 0.9, True, False, ["e1"])],
    "checks": [(f"c{n}", t, "f1", "passed") for n, t in enumerate(["evidence_ref_integrity", "no_guessing", "schema"])],
    "items": [("i1", "f1", "k", "10克", True, ["text"], ["e1"])],
    "item_index": [("i1", "k|10克")],
    "risks": [("r1", "f1", "field", "high", "low_confidence", "m", ["e1"])],
    "tasks": [("t1", "f1", "field", "high", "why", True, None)],
    "gate": [("d", False, "manual_review", 1, False)],
    "ocr_lines": [("l1", 1, "x", 0.5, "missing")],
    "ocr_blocks": [("b1", ["l1"], 1)],
    "regions": [("rg", "front", "Front", 1, ["s1"], ["f1"])],
    "nodes": [("rg", "region"), ("n1", "text_span")],
    "edges": [("x1", "rg", "n1", "in_region")],
    "candidate_nodes": [("n1", "text_span")],
    "candidate_edges": [("x2", "n1", "n1", "self")],
    "reports": [(r, "passed", "1") for r in ("vdg_quality", "vdg_context", "vdg_consumption", "scope_context", "scope_report", "layout_quality", "semantic_review")],
    "group_texts": [("g", "i1", "10克")],
    "auto_items": [("i1", "f1", "10克", ["e1"])],
}
MUTATIONS = [
    ("job", "status", "null", {"job_contract"}),
    ("metadata", "no_guessing", "false", {"no_guessing_policy"}),
    ("regions", "source_span_ids", "array('zz')", {"region_source_refs"}),
    ("regions", "artifact_ids", "array('zz')", {"region_artifact_refs"}),
    ("nodes", "node_type", "null", {"visual_document_graph_contract"}),
    ("edges", "target", "'zz'", {"visual_document_graph_contract_ends"}),
    ("candidate_nodes", "node_type", "null", {"candidate_visual_document_graph_contract"}),
    ("candidate_edges", "target", "'zz'", {"candidate_visual_document_graph_contract_ends"}),
    ("reports", "status", "'failed'", {"vdg_quality_report_contract", "vdg_agent_context_contract", "vdg_consumption_report_contract", "label_text_scope_agent_context_contract", "label_text_scope_report_contract", "layout_evidence_contract", "semantic_review_contract"}),
    ("group_texts", "text", "'x'", {"field_group_text_matches_standard_item"}),
    ("auto_items", "field_id", "'zz'", {"auto_ingest_refs"}),
    ("ocr_blocks", "line_ids", "array('zz')", {"ocr_block_refs"}),
    ("risks", "target_id", "'zz'", {"risk_target_refs", "high_risk_review_tasks"}),
    ("evidence", "evidence_id", "null", {"evidence_contract", "field_evidence_refs", "standard_item_refs", "risk_evidence_refs"}),
    ("evidence", "has_bbox", "false", {"evidence_bbox_status_consistency"}),
    ("fields", "raw_value", "'12克'", {"field_text_from_evidence", "field_normalization_contract"}),
    ("items", "text", "'11克'", {"standard_item_text_from_evidence"}),
    ("tasks", "target_id", "'zz'", {"critical_low_confidence_review_tasks", "review_task_target_refs", "high_risk_review_tasks"}),
    ("item_index", "item_id", "'zz'", {"comparison_index_contract"}),
    ("checks", "result", "'failed'", set()),
    ("ocr_blocks", "line_count", "2", {"ocr_block_refs_count"}),
    ("metadata", "root_keys", "array('job')", {"required_keys_present"}),
    ("gate", "ingest_allowed", "true", {"auto_ingest_quality_gate"}),
    ("checks", "check_type", "'schema'", {"cross_validation_required_checks"}),
]


def failed(tables):
    return {r.check for r in contract_report(result_contract(), tables).where("result = 'failed'").collect()}


def test_there_are_72_checks(spark):
    names = [r.check for r in result_contract()]
    assert len(names) == len(set(names))
    assert len({n for n in names if not n.endswith(("_ends", "_refs_count"))}) == 72


@pytest.fixture(scope="module")
def valid(spark):
    return with_empty(spark, {n: spark.createDataFrame(r, RESULT_TABLES[n]) for n, r in VALID.items()})


def test_valid(valid):
    assert failed(valid) == set()


def test_mutations(valid):
    rules = {r.check: r for r in result_contract()}
    for table, column, value, want in MUTATIONS:
        changed = valid | {table: valid[table].withColumn(column, F.expr(value))}
        for check in want | {"evidence_unique_ids", "risk_contract"}:
            assert (rules[check].failures(changed).count() > 0) == (check in want), (table, column, check)
