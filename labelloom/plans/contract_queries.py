"""The whole result contract as a query: the relational form derived from this project's tables, all checks at once.

The derivations are plain SQL that both engines run; the checks are those of ``result_contract`` on one side and SQL
written for each of them on the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.operators.quality import contract_report, failures_of
from labelloom.plans.result_contract import EXPORT_CHECKS, ROOT, result_contract, with_empty
from labelloom.session import table

SOURCES = ("text_spans", "evidence_items", "standard_items", "source_alignments", "compare_candidates", "main_labels", "enterprises", "content_items", "label_catalog")

#: Each table of the relational form; {name} is a table of this project, SHA, SET and FIRST stand for functions.
FORM = {
    "job": "SELECT job_id, max(CASE WHEN page < 3 THEN 'done' END) AS status FROM {text_spans} GROUP BY job_id",
    "document": "SELECT job_id AS document_id, min(file_name) AS file_name, 'sha256:' || SHA(min(file_name)) AS file_hash, max(page) AS page_count, SET(bbox_pdf.page_width) AS page_widths FROM {text_spans} GROUP BY job_id",
    "metadata": "SELECT job_id AS document_id, min(page) = 1 AS no_guessing, SET(source) AS export_checks, max(CASE WHEN source = 'ocr' THEN '2025-01-01T00:00:00' END) AS created_at, SET(source) AS root_keys FROM {text_spans} GROUP BY job_id",
    "schema_fields": "SELECT semantic_key AS field_key, min(group_id) AS section_id, min(row_key) AS field_type, SET(row_key) AS source_span_ids FROM {standard_items} GROUP BY semantic_key",
    "spans": "SELECT DISTINCT span_id FROM {text_spans}",
    "evidence": "SELECT evidence_id, source_text, page, extraction_methods, bbox_status, page > 1 AS has_bbox FROM {evidence_items} WHERE deleted_at IS NULL",
    "fields": "SELECT id AS field_id, semantic_key, text AS raw_value, replace(text, ' ', '') AS normalized_value, source_ids AS normalization_rules, CASE WHEN comparison_required THEN 'compiled' ELSE 'open' END AS status, CASE WHEN table_id IS NULL THEN 'critical' ELSE 'normal' END AS criticality, CASE WHEN group_id = 'product_001' THEN CAST(0.9 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS confidence, review_required, table_id IS NULL AS bbox_missing, evidence_refs FROM {standard_items}",
    "checks": "SELECT alignment_id AS check_id, CASE WHEN text_relation = 'equivalent' THEN 'schema' ELSE 'no_guessing' END AS check_type, ocr_line_id AS target_id, CASE WHEN text_similarity < 0.8 THEN 'failed' ELSE 'passed' END AS result FROM {source_alignments}",
    "source_issues": "SELECT DISTINCT alignment_id AS issue_id, text_relation AS issue_type, CASE WHEN text_similarity < 0.8 THEN 'high' ELSE 'low' END AS severity FROM {source_alignments} WHERE text_similarity < 0.95",
    "entities": "SELECT record_id AS entity_id, trim(enterprise_role) AS entity_type, 'confirmed' AS status, CASE WHEN website IS NULL THEN CAST(1.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS confidence, CAST(NULL AS STRS) AS field_ids, ARR(license_no) AS table_ids, CAST(NULL AS STRS) AS evidence_refs FROM {enterprises}",
    "items": "SELECT id AS item_id, id AS field_id, semantic_key, text, comparison_required, source_ids AS profile, evidence_refs FROM {standard_items}",
    "item_index": "SELECT DISTINCT target_id AS item_id, target_id AS comparison_key FROM {compare_candidates}",
    "missing_items": "SELECT DISTINCT semantic_key FROM {label_catalog} WHERE catalog_id > 20",
    "tables": "SELECT job_id || table_id AS table_id, 'nutrition' AS table_type, CASE WHEN max(row_key) IS NULL THEN 'open' ELSE 'recovered' END AS status, count(*) < 2 AS review_required, CAST(count(row_key) AS INT) AS n_rows, SET(row_key) AS evidence_refs FROM {standard_items} WHERE table_id IS NOT NULL AND job_id IS NOT NULL GROUP BY job_id || table_id",
    "cells": "SELECT id AS cell_id, table_id, row_key, label AS column_id, text AS raw_value, evidence_refs FROM {standard_items} WHERE table_id IS NOT NULL",
    "requirements": "SELECT row_id AS requirement_id, remark AS requirement_text, coord AS status, ARR(field_code) AS evidence_refs FROM {main_labels}",
    "regions": "SELECT candidate_id AS region_id, region_id AS region_type, candidate_type AS display_name, CAST(CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS INT) AS page, source_ocr_line_ids AS source_span_ids, ARR(target_id) AS artifact_ids FROM {compare_candidates}",
    "candidate_nodes": "SELECT DISTINCT span_id AS node_id, source AS node_type FROM {text_spans} WHERE confidence > 0.8",
    "candidate_edges": "SELECT alignment_id AS edge_id, FIRST(pdf_span_ids) AS source, FIRST(pdf_span_ids) AS target, text_relation AS edge_type FROM {source_alignments}",
    "nodes": "SELECT DISTINCT ocr_line_id AS node_id, text_relation AS node_type FROM {source_alignments}",
    "edges": "SELECT candidate_id AS edge_id, FIRST(source_ocr_line_ids) AS source, FIRST(source_ocr_line_ids) AS target, reason AS edge_type FROM {compare_candidates}",
    "reports": " UNION ALL ".join(f"SELECT '{r}' AS report, CASE WHEN count(*) > {n} THEN 'passed' ELSE 'failed' END AS status, '1' AS version FROM {{text_spans}} WHERE page > {n}" for n, r in enumerate(("vdg_quality", "vdg_context", "vdg_consumption", "scope_context", "scope_report", "layout_quality", "semantic_review"))),
    "scope_terms": "SELECT display_name AS term, CASE WHEN catalog_id > 30 THEN '' ELSE semantic_key END AS category FROM {label_catalog}",
    "groups": "SELECT job_id || group_id AS group_id, max(row_key) AS group_type, SET(id) AS field_ids, SET(table_id) AS table_ids FROM {standard_items} WHERE job_id IS NOT NULL AND group_id IS NOT NULL GROUP BY job_id || group_id",
    "group_texts": "SELECT group_id, id AS item_id, trim(text) AS text FROM {standard_items}",
    "lists": "SELECT content_row_id AS list_id, product_category AS list_type, CAST(1 AS INT) AS item_count, ARR(content_no) AS group_ids FROM {content_items}",
    "revisions": "SELECT row_id AS revision_id, CASE WHEN row_no > 3 THEN 'after' ELSE 'draft' END AS role, 'current' AS status, ARR(field_code) AS field_ids, ARR(coord) AS source_span_ids, ARR(remark) AS evidence_refs FROM {main_labels}",
    "auto_items": "SELECT id AS item_id, id AS field_id, replace(text, ' ', '') AS text, evidence_refs FROM {standard_items} WHERE NOT review_required",
    "gate": "SELECT job_id AS document_id, min(score) > 0.1 AS downstream_allowed, CASE WHEN max(score) > 0.95 THEN 'pass' ELSE 'manual_review' END AS status, CAST(count(CASE WHEN score < 0.2 THEN 1 END) AS INT) AS n_high, max(score) > 0.9 AS ingest_allowed FROM {compare_candidates} GROUP BY job_id",
    "risks": "SELECT candidate_id AS risk_id, target_id, 'field' AS target_type, CASE WHEN score < 0.2 THEN 'high' WHEN score < 0.5 THEN 'medium' WHEN score < 0.9 THEN 'low' ELSE 'none' END AS risk_level, candidate_type AS risk_type, reason AS message, source_ocr_line_ids AS evidence_refs FROM {compare_candidates}",
    "tasks": "SELECT candidate_id AS task_id, target_id, 'field' AS target_type, 'high' AS risk_level, region_id AS reason, score < 0.1 AS required, source_ocr_line_ids AS evidence_refs FROM {compare_candidates} WHERE score < 0.3",
    "ocr_lines": "SELECT ocr_line_id AS line_id, page, ocr_text AS text, text_similarity AS confidence, CASE WHEN line_no > 1 THEN 'missing' ELSE 'open' END AS bbox_status FROM {source_alignments}",
    "ocr_tokens": "SELECT span_id AS token_id, file_name AS line_id, page, text, CASE WHEN bbox_pdf.x IS NULL THEN 'none' ELSE 'available' END AS bbox_status FROM {text_spans} WHERE source = 'ocr'",
    "ocr_blocks": "SELECT candidate_id AS block_id, source_ocr_line_ids AS line_ids, CAST(2 AS INT) AS line_count FROM {compare_candidates}",
}


def relational_form(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The tables of a result's relational form, as far as this project's tables give them."""
    named = {n: table(spark, d, n) for n in SOURCES}
    out = {}
    for name, sql in FORM.items():
        s = sql.replace("SHA(min(file_name))", "sha2(min(file_name), 256)").replace("SET(", "collect_set(").replace("STRS", "array<string>").replace("ARR(", "array(")
        s = s.replace("FIRST(pdf_span_ids)", "get(pdf_span_ids, 0)").replace("FIRST(source_ocr_line_ids)", "get(source_ocr_line_ids, 0)")
        out[name] = spark.sql(s, **{n: df for n, df in named.items() if "{" + n + "}" in s})
    return with_empty(spark, out)


def _form_sql() -> str:
    parts = []
    for name, sql in FORM.items():
        s = sql.replace("SHA(", "sha256(").replace("STRS", "VARCHAR[]").replace("ARR(", "list_value(").replace("FIRST(pdf_span_ids)", "pdf_span_ids[1]").replace("FIRST(source_ocr_line_ids)", "source_ocr_line_ids[1]")
        while "SET(" in s:
            a = s.index("SET(")
            b = s.index(")", a)
            inner = s[a + 4 : b]
            s = s[:a] + f"coalesce(list(DISTINCT {inner}) FILTER ({inner} IS NOT NULL), [])" + s[b + 1 :]
        for n in SOURCES:
            s = s.replace("{" + n + "}", n)
        parts.append(f"r_{name} AS ({s})")
    return ", ".join(parts)


def _blank(c: str) -> str:
    return f"({c} IS NULL OR trim({c}) = '')"


def _row(check: str, name: str, key: str, *blank: str, refs: str = "", **codes: str) -> list[str]:
    wrong = {f"no_{c}": _blank(c) for c in blank} | ({f"no_{refs}": f"coalesce(len({refs}), 0) = 0"} if refs else {}) | codes
    return [f"SELECT DISTINCT '{check}' AS c, CAST({key} AS VARCHAR) AS t, '{code}' AS code FROM r_{name} WHERE {w}" for code, w in wrong.items()]


def _ref(check: str, name: str, key: str, refs: list[str], *known: str) -> list[str]:
    long = " UNION ALL ".join(f"SELECT {key} AS t, {r} AS ref FROM r_{name}" for r in refs)
    among = " AND ".join(f"ref NOT IN (SELECT {k.split('.')[1]} FROM r_{k.split('.')[0]} WHERE {k.split('.')[1]} IS NOT NULL)" for k in known)
    return [f"SELECT DISTINCT '{check}', CAST(t AS VARCHAR), 'unknown_reference' FROM ({long}) WHERE ref IS NOT NULL AND {among}"]


def _text(check: str, name: str, key: str, text: str) -> list[str]:
    sq = lambda c: rf"regexp_replace({c}, '[\s\x0b]+', '', 'g')"
    return [f"SELECT '{check}', t, 'text_not_in_evidence' FROM (SELECT {key} AS t, {sq(text)} AS x, unnest(evidence_refs) AS ref FROM r_{name} WHERE trim({text}) <> '') n LEFT JOIN r_evidence e ON e.evidence_id = n.ref GROUP BY t HAVING NOT bool_or(coalesce(contains({sq('e.source_text')}, x), false))"]


def _route(check: str, name: str, key: str, cond: str, other: str, other_key: str) -> list[str]:
    return [f"SELECT DISTINCT '{check}', CAST({key} AS VARCHAR), 'no_route' FROM r_{name} WHERE ({cond}) AND NOT EXISTS (SELECT 1 FROM r_{other} o WHERE o.{other_key} = r_{name}.{key})"]


def _unique(check: str, name: str, key: str) -> list[str]:
    return [f"SELECT '{check}', CAST({key} AS VARCHAR), 'duplicate' FROM r_{name} WHERE {key} IS NOT NULL GROUP BY {key} HAVING count(*) > 1"]


def _same(check: str, name: str) -> list[str]:
    return [f"SELECT DISTINCT '{check}', a.item_id, 'text_differs' FROM r_{name} a JOIN r_items i ON i.item_id = a.item_id WHERE a.text IS DISTINCT FROM i.text"]


def _report(check: str, report: str) -> list[str]:
    return _row(check, "reports", "report", not_ready=f"report = '{report}' AND (status IS NULL OR status NOT IN ('passed', 'warning', 'skipped'))")


_TARGETS = ("fields.field_id", "entities.entity_id", "tables.table_id", "regions.region_id", "requirements.requirement_id", "missing_items.semantic_key", "source_issues.issue_id", "checks.check_id", "document.document_id")
_EV, _SP, _PAGE = "evidence.evidence_id", "spans.span_id", "(page IS NULL OR page < 1)"
_BOX = "coalesce(bbox_status, '') NOT IN ('available', 'missing')"
_LEVEL = "risk_level NOT IN ('low', 'medium', 'high')"
_U = "unnest({})".format


def _lacks(column: str, wanted: tuple[str, ...]) -> str:
    return f"len(list_filter([{', '.join(repr(w) for w in wanted)}], lambda v: NOT list_contains(coalesce({column}, []), v))) > 0"


_CHECKS = [
    *_row("job_contract", "job", "job_id", "job_id", "status"),
    *_row("document_contract", "document", "document_id", "document_id", "file_name", bad_hash="NOT regexp_matches(file_hash, '^sha256:[0-9a-f]{64}$')", bad_pages="len(page_widths) <> page_count"),
    *_row("no_guessing_policy", "metadata", "document_id", guessing="NOT coalesce(no_guessing, false)"),
    *_row("json_export_contract", "metadata", "document_id", lacks_checks=_lacks("export_checks", EXPORT_CHECKS)),
    *_row("metadata_created_at", "metadata", "document_id", no_iso_time=r"NOT coalesce(regexp_matches(created_at, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}'), false)"),
    *_row("generated_schema_contract", "schema_fields", "field_key", "field_key", "section_id", "field_type"),
    *_ref("generated_schema_source_refs", "schema_fields", "field_key", [_U("source_span_ids")], _SP),
    *_row("evidence_contract", "evidence", "evidence_id", "evidence_id", "source_text", bad_page=_PAGE, no_method="coalesce(len(extraction_methods), 0) = 0", bad_bbox_status=_BOX),
    *_unique("evidence_unique_ids", "evidence", "evidence_id"),
    *_row("evidence_bbox_status_consistency", "evidence", "evidence_id", no_box="bbox_status = 'available' AND NOT coalesce(has_bbox, false)"),
    *_row("field_contract", "fields", "field_id", "field_id", "semantic_key", bad_status="status NOT IN ('compiled', 'confirmed', 'review_required', 'missing')"),
    *_ref("field_evidence_refs", "fields", "field_id", [_U("evidence_refs")], _EV),
    *_text("field_text_from_evidence", "fields", "field_id", "raw_value"),
    *_row("field_normalization_contract", "fields", "field_id", no_rule="normalized_value <> raw_value AND coalesce(len(normalization_rules), 0) = 0", unsure="normalized_value <> raw_value AND confidence < 0.95 AND NOT review_required"),
    *_route("critical_field_bbox_risk", "fields", "field_id", "criticality = 'critical' AND bbox_missing", "tasks", "target_id"),
    *_route("critical_low_confidence_review_tasks", "fields", "field_id", "criticality = 'critical' AND confidence < 0.95", "tasks", "target_id"),
    *_route("field_missing_bbox_risks", "fields", "field_id", "bbox_missing", "risks", "target_id"),
    "SELECT 'cross_validation_required_checks', 'checks', 'aggregate' FROM r_checks HAVING " + _lacks("list(DISTINCT check_type)", ("evidence_ref_integrity", "no_guessing", "schema")),
    *_route("failed_validation_risk_routes", "checks", "target_id", "result = 'failed'", "risks", "target_id"),
    *_route("source_consistency_issue_risk_routes", "source_issues", "issue_id", "severity IN ('high', 'medium')", "risks", "target_id"),
    *_row("entity_contract", "entities", "entity_id", "entity_id", "entity_type", "status", bad_confidence="NOT (confidence BETWEEN 0 AND 1)"),
    *_ref("entity_refs", "entities", "entity_id", [_U("field_ids"), _U("table_ids"), _U("evidence_refs")], "fields.field_id", "tables.table_id", _EV),
    *_row("standard_item_contract", "items", "item_id", "item_id", "semantic_key", "text", refs="evidence_refs"),
    *_ref("standard_item_refs", "items", "item_id", ["field_id", _U("evidence_refs")], "fields.field_id", _EV),
    *_text("standard_item_text_from_evidence", "items", "item_id", "text"),
    *_row("standard_item_comparison_profile", "items", "item_id", refs="profile"),
    *_route("comparison_index_contract", "items", "item_id", "comparison_required", "item_index", "item_id"),
    "SELECT DISTINCT 'missing_items_excluded', semantic_key, 'excluded' FROM r_items WHERE semantic_key IN (SELECT semantic_key FROM r_missing_items)",
    *_route("missing_item_risk_routes", "missing_items", "semantic_key", "true", "risks", "target_id"),
    *_row("table_contract", "tables", "table_id", "table_id", "table_type", "status", no_rows="coalesce(n_rows, 0) = 0"),
    *_ref("table_evidence_refs", "tables", "table_id", [_U("evidence_refs")], _EV),
    *_text("table_cell_text_from_evidence", "cells", "cell_id", "raw_value"),
    *_route("table_structure_risk_routes", "tables", "table_id", "review_required OR status <> 'recovered'", "risks", "target_id"),
    *_row("requirement_contract", "requirements", "requirement_id", "requirement_id", "requirement_text", "status", refs="evidence_refs"),
    *_ref("requirement_evidence_refs", "requirements", "requirement_id", [_U("evidence_refs")], _EV),
    *_text("requirement_text_from_evidence", "requirements", "requirement_id", "requirement_text"),
    *_row("region_contract", "regions", "region_id", "region_id", "region_type", "display_name", refs="source_span_ids", bad_page=_PAGE),
    *_ref("region_source_refs", "regions", "region_id", [_U("source_span_ids")], _SP, "nodes.node_id"),
    *_ref("region_artifact_refs", "regions", "region_id", [_U("artifact_ids")], "fields.field_id", "tables.table_id", "entities.entity_id", _EV),
    *_row("candidate_visual_document_graph_contract", "candidate_nodes", "node_id", "node_id", "node_type"),
    *_ref("candidate_visual_document_graph_contract_ends", "candidate_edges", "edge_id", ["source", "target"], "candidate_nodes.node_id"),
    *_row("visual_document_graph_contract", "nodes", "node_id", "node_id", "node_type"),
    *_ref("visual_document_graph_contract_ends", "edges", "edge_id", ["source", "target"], "nodes.node_id"),
    *_report("vdg_quality_report_contract", "vdg_quality"), *_report("vdg_agent_context_contract", "vdg_context"), *_report("vdg_consumption_report_contract", "vdg_consumption"),
    *_row("label_text_scope_reference_contract", "scope_terms", "term", "term", "category"),
    *_report("label_text_scope_agent_context_contract", "scope_context"), *_report("label_text_scope_report_contract", "scope_report"), *_report("layout_evidence_contract", "layout_quality"), *_report("semantic_review_contract", "semantic_review"),
    *_route("region_vdg_refs", "regions", "region_id", "true", "nodes", "node_id"),
    *_row("field_group_contract", "groups", "group_id", "group_id", "group_type"),
    *_ref("field_group_refs", "groups", "group_id", [_U("field_ids"), _U("table_ids")], "fields.field_id", "tables.table_id"),
    *_same("field_group_text_matches_standard_item", "group_texts"),
    *_row("list_contract", "lists", "list_id", "list_id", "list_type", bad_count="item_count <> coalesce(len(group_ids), 0)"),
    *_ref("list_group_refs", "lists", "list_id", [_U("group_ids")], "groups.group_id"),
    *_row("revision_block_contract", "revisions", "revision_id", "revision_id", refs="evidence_refs", bad_role="role NOT IN ('before', 'after')", bad_status="status NOT IN ('current', 'historical')"),
    *_ref("revision_block_refs", "revisions", "revision_id", [_U("field_ids"), _U("source_span_ids"), _U("evidence_refs")], "fields.field_id", _SP, _EV),
    *_ref("auto_ingest_refs", "auto_items", "item_id", ["item_id", "field_id"], "items.item_id", "fields.field_id"),
    *_same("auto_ingest_text_matches_standard_item", "auto_items"),
    *_row("auto_ingest_quality_gate", "gate", "document_id", high_risk="ingest_allowed AND n_high > 0"),
    *_row("risk_contract", "risks", "risk_id", "target_id", "risk_type", "message", bad_level=_LEVEL),
    *_row("review_task_contract", "tasks", "task_id", "target_id", "reason", bad_level=_LEVEL, no_flag="required IS NULL"),
    *_ref("risk_evidence_refs", "risks", "risk_id", [_U("evidence_refs")], _EV),
    *_ref("risk_target_refs", "risks", "risk_id", ["target_id"], *_TARGETS),
    *_ref("review_task_evidence_refs", "tasks", "task_id", [_U("evidence_refs")], _EV),
    *_ref("review_task_target_refs", "tasks", "task_id", ["target_id"], *_TARGETS),
    *_route("high_risk_review_tasks", "risks", "target_id", "risk_level = 'high'", "tasks", "target_id"),
    *_row("quality_report_downstream_gate", "gate", "document_id", differs="downstream_allowed <> (status = 'pass')"),
    *_row("ocr_line_contract", "ocr_lines", "line_id", "line_id", "text", bad_page=_PAGE, bad_confidence="NOT coalesce(confidence BETWEEN 0 AND 1, false)", bad_bbox_status=_BOX),
    *_row("ocr_token_contract", "ocr_tokens", "token_id", "token_id", "text", bad_page=_PAGE, bad_bbox_status=_BOX),
    *_ref("ocr_block_refs", "ocr_blocks", "block_id", [_U("line_ids")], "ocr_lines.line_id"),
    *_row("ocr_block_refs_count", "ocr_blocks", "block_id", bad_count="line_count <> coalesce(len(line_ids), 0)"),
    *_row("required_keys_present", "metadata", "document_id", lacks_keys=_lacks("root_keys", ROOT)),
]


def contract_full(spark: SparkSession, d: str) -> DataFrame:
    """Every check of the result contract with its number of failures."""
    return contract_report(result_contract(), relational_form(spark, d))


def contract_failures(spark: SparkSession, d: str) -> DataFrame:
    """Failures of every check by kind and level."""
    f = failures_of(result_contract(), relational_form(spark, d))
    return f.groupBy("check", "code").agg(F.count(F.lit(1)).alias("n"), F.min("target_id").alias("first_target"))


def _sql(select: str) -> str:
    return f"WITH {_form_sql()}, f AS ({' UNION ALL '.join(_CHECKS)}) {select}"


QUERIES = {"contract_full": contract_full, "contract_failures": contract_failures}
_NAMES = """job_contract document_contract no_guessing_policy json_export_contract metadata_created_at generated_schema_contract generated_schema_source_refs evidence_contract evidence_unique_ids
  evidence_bbox_status_consistency field_contract field_evidence_refs field_text_from_evidence field_normalization_contract critical_field_bbox_risk critical_low_confidence_review_tasks field_missing_bbox_risks
  cross_validation_required_checks failed_validation_risk_routes source_consistency_issue_risk_routes entity_contract entity_refs standard_item_contract standard_item_refs standard_item_text_from_evidence
  standard_item_comparison_profile comparison_index_contract missing_items_excluded missing_item_risk_routes table_contract table_evidence_refs table_cell_text_from_evidence table_structure_risk_routes
  requirement_contract requirement_evidence_refs requirement_text_from_evidence region_contract region_source_refs region_artifact_refs candidate_visual_document_graph_contract
  candidate_visual_document_graph_contract_ends visual_document_graph_contract visual_document_graph_contract_ends vdg_quality_report_contract vdg_agent_context_contract vdg_consumption_report_contract
  label_text_scope_reference_contract label_text_scope_agent_context_contract label_text_scope_report_contract layout_evidence_contract semantic_review_contract region_vdg_refs field_group_contract field_group_refs
  field_group_text_matches_standard_item list_contract list_group_refs revision_block_contract revision_block_refs auto_ingest_refs auto_ingest_text_matches_standard_item auto_ingest_quality_gate risk_contract
  review_task_contract risk_evidence_refs risk_target_refs review_task_evidence_refs review_task_target_refs high_risk_review_tasks quality_report_downstream_gate ocr_line_contract ocr_token_contract ocr_block_refs
  ocr_block_refs_count required_keys_present""".split()
SQL = {
    "contract_full": _sql(f"""SELECT n AS "check", CASE WHEN count(f.code) = 0 THEN 'passed' ELSE 'failed' END AS result, count(f.code) AS n_failures FROM (SELECT unnest({_NAMES}) AS n) LEFT JOIN f ON f.c = n GROUP BY 1"""),
    "contract_failures": _sql("""SELECT c AS "check", code, count(*) AS n, min(t) AS first_target FROM f GROUP BY 1, 2"""),
}
