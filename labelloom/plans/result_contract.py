"""The contract of a result document, over its relational form: 72 checks as declarations.

``RESULT_TABLES`` is the relational form: one table per part, arrays kept. ``result_contract`` gives the checks; they
run by ``quality.failures_of`` and ``quality.contract_report`` for any number of documents at once. Tables that are
left out count as empty (``with_empty``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.operators.quality import Rule, aggregate_rule, reference_rule, route_rule, row_rule, text_rule, unique_rule

_REFS = "evidence_refs array<string>"
RESULT_TABLES = {
    "job": "job_id string, status string",
    "document": "document_id string, file_name string, file_hash string, page_count int, page_widths array<double>",
    "metadata": "document_id string, no_guessing boolean, export_checks array<string>, created_at string, root_keys array<string>",
    "schema_fields": "field_key string, section_id string, field_type string, source_span_ids array<string>",
    "spans": "span_id string",
    "evidence": "evidence_id string, source_text string, page int, extraction_methods array<string>, bbox_status string, has_bbox boolean",
    "fields": f"field_id string, semantic_key string, raw_value string, normalized_value string, normalization_rules array<string>, status string, criticality string, confidence double, review_required boolean, bbox_missing boolean, {_REFS}",
    "checks": "check_id string, check_type string, target_id string, result string",
    "source_issues": "issue_id string, issue_type string, severity string",
    "entities": f"entity_id string, entity_type string, status string, confidence double, field_ids array<string>, table_ids array<string>, {_REFS}",
    "items": f"item_id string, field_id string, semantic_key string, text string, comparison_required boolean, profile array<string>, {_REFS}",
    "item_index": "item_id string, comparison_key string",
    "missing_items": "semantic_key string",
    "tables": f"table_id string, table_type string, status string, review_required boolean, n_rows int, {_REFS}",
    "cells": f"cell_id string, table_id string, row_key string, column_id string, raw_value string, {_REFS}",
    "requirements": f"requirement_id string, requirement_text string, status string, {_REFS}",
    "regions": "region_id string, region_type string, display_name string, page int, source_span_ids array<string>, artifact_ids array<string>",
    "candidate_nodes": "node_id string, node_type string",
    "candidate_edges": "edge_id string, source string, target string, edge_type string",
    "nodes": "node_id string, node_type string",
    "edges": "edge_id string, source string, target string, edge_type string",
    "reports": "report string, status string, version string",
    "scope_terms": "term string, category string",
    "groups": "group_id string, group_type string, field_ids array<string>, table_ids array<string>",
    "group_texts": "group_id string, item_id string, text string",
    "lists": "list_id string, list_type string, item_count int, group_ids array<string>",
    "revisions": f"revision_id string, role string, status string, field_ids array<string>, source_span_ids array<string>, {_REFS}",
    "auto_items": f"item_id string, field_id string, text string, {_REFS}",
    "gate": "document_id string, downstream_allowed boolean, status string, n_high int, ingest_allowed boolean",
    "risks": f"risk_id string, target_id string, target_type string, risk_level string, risk_type string, message string, {_REFS}",
    "tasks": f"task_id string, target_id string, target_type string, risk_level string, reason string, required boolean, {_REFS}",
    "ocr_lines": "line_id string, page int, text string, confidence double, bbox_status string",
    "ocr_tokens": "token_id string, line_id string, page int, text string, bbox_status string",
    "ocr_blocks": "block_id string, line_ids array<string>, line_count int",
}
ROOT = ("job", "document", "generated_schema", "extracted_data", "evidence", "cross_validation", "coverage", "validation", "quality", "risks", "review_tasks", "metadata")
EXPORT_CHECKS = ("machine_parseable_json", "root_keys_present", "evidence_refs_resolve", "risk_targets_resolve", "review_task_targets_resolve", "no_guessing")
#: What a risk or task may point at.
TARGETS = [("fields", "field_id"), ("entities", "entity_id"), ("tables", "table_id"), ("regions", "region_id"), ("requirements", "requirement_id"), ("missing_items", "semantic_key"), ("source_issues", "issue_id"), ("checks", "check_id"), ("document", "document_id")]
LOW = 0.95


def with_empty(spark: SparkSession, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables of the relational form, empty where not given."""
    return {n: tables[n] if n in tables else spark.createDataFrame([], s) for n, s in RESULT_TABLES.items()}


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(c) == "")


def _refs(c: str = "evidence_refs") -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def _needs(*columns: str, refs: str | None = None, **more: Column) -> dict[str, Column]:
    """Violations: a column that is blank, references that are empty, and whatever ``more`` says."""
    out = {f"no_{c}": _blank(c) for c in columns}
    if refs:
        out[f"no_{refs}"] = F.size(_refs(refs)) == 0
    return out | more


def _graph(prefix: str, check: str) -> list[Rule]:
    return [
        row_rule(check, f"{prefix}nodes", "node_id", _needs("node_id", "node_type")),
        reference_rule(f"{check}_ends", f"{prefix}edges", "edge_id", F.array("source", "target"), [(f"{prefix}nodes", "node_id")]),
    ]


def _report(check: str, report: str) -> Rule:
    bad = (F.col("report") == report) & (F.col("status").isNull() | ~F.col("status").isin("passed", "warning", "skipped"))
    return row_rule(check, "reports", "report", {"not_ready": bad})


def result_contract() -> list[Rule]:
    """The checks C01 to C72 in order; a check of two parts has a second rule with a suffix."""
    ev = [("evidence", "evidence_id")]
    spans = [("spans", "span_id")]
    bad_status = lambda *ok: ~F.col("status").isin(*ok)
    page = F.col("page").isNull() | (F.col("page") < 1)
    box_status = ~F.coalesce("bbox_status", F.lit("")).isin("available", "missing")
    unsure = (F.col("criticality") == "critical") & (F.col("confidence") < LOW)
    return [
        row_rule("job_contract", "job", "job_id", _needs("job_id", "status")),
        row_rule("document_contract", "document", "document_id", _needs("document_id", "file_name", bad_hash=~F.col("file_hash").rlike("^sha256:[0-9a-f]{64}$"), bad_pages=F.size(_refs("page_widths").cast("array<double>")) != F.col("page_count"))),
        row_rule("no_guessing_policy", "metadata", "document_id", {"guessing": ~F.coalesce("no_guessing", F.lit(False))}),
        row_rule("json_export_contract", "metadata", "document_id", {"lacks_checks": F.size(F.array_except(F.array(*map(F.lit, EXPORT_CHECKS)), _refs("export_checks"))) > 0}),
        row_rule("metadata_created_at", "metadata", "document_id", {"no_iso_time": ~F.coalesce(F.col("created_at").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"), F.lit(False))}),
        row_rule("generated_schema_contract", "schema_fields", "field_key", _needs("field_key", "section_id", "field_type")),
        reference_rule("generated_schema_source_refs", "schema_fields", "field_key", _refs("source_span_ids"), spans),
        row_rule("evidence_contract", "evidence", "evidence_id", _needs("evidence_id", "source_text", bad_page=page, no_method=F.size(_refs("extraction_methods")) == 0, bad_bbox_status=box_status)),
        unique_rule("evidence_unique_ids", "evidence", "evidence_id"),
        row_rule("evidence_bbox_status_consistency", "evidence", "evidence_id", {"no_box": (F.col("bbox_status") == "available") & ~F.coalesce("has_bbox", F.lit(False))}),
        row_rule("field_contract", "fields", "field_id", _needs("field_id", "semantic_key", bad_status=bad_status("compiled", "confirmed", "review_required", "missing"))),
        reference_rule("field_evidence_refs", "fields", "field_id", _refs(), ev),
        text_rule("field_text_from_evidence", "fields", "field_id", "raw_value", "evidence_refs", "evidence", "evidence_id", "source_text"),
        row_rule("field_normalization_contract", "fields", "field_id", {"no_rule": (F.col("normalized_value") != F.col("raw_value")) & (F.size(_refs("normalization_rules")) == 0), "unsure": (F.col("normalized_value") != F.col("raw_value")) & (F.col("confidence") < LOW) & ~F.col("review_required")}),
        route_rule("critical_field_bbox_risk", "fields", "field_id", (F.col("criticality") == "critical") & F.col("bbox_missing"), "tasks", "target_id"),
        route_rule("critical_low_confidence_review_tasks", "fields", "field_id", unsure, "tasks", "target_id"),
        route_rule("field_missing_bbox_risks", "fields", "field_id", F.col("bbox_missing"), "risks", "target_id"),
        aggregate_rule("cross_validation_required_checks", "checks", F.size(F.array_except(F.array(*map(F.lit, ("evidence_ref_integrity", "no_guessing", "schema"))), F.collect_set("check_type"))) > 0),
        route_rule("failed_validation_risk_routes", "checks", "target_id", F.col("result") == "failed", "risks", "target_id"),
        route_rule("source_consistency_issue_risk_routes", "source_issues", "issue_id", F.col("severity").isin("high", "medium"), "risks", "target_id"),
        row_rule("entity_contract", "entities", "entity_id", _needs("entity_id", "entity_type", "status", bad_confidence=~F.col("confidence").between(0, 1))),
        reference_rule("entity_refs", "entities", "entity_id", F.concat(_refs("field_ids"), _refs("table_ids"), _refs()), [("fields", "field_id"), ("tables", "table_id"), *ev]),
        row_rule("standard_item_contract", "items", "item_id", _needs("item_id", "semantic_key", "text", refs="evidence_refs")),
        reference_rule("standard_item_refs", "items", "item_id", F.concat(F.array("field_id"), _refs()), [("fields", "field_id"), *ev]),
        text_rule("standard_item_text_from_evidence", "items", "item_id", "text", "evidence_refs", "evidence", "evidence_id", "source_text"),
        row_rule("standard_item_comparison_profile", "items", "item_id", {"no_profile": F.size(_refs("profile")) == 0}),
        route_rule("comparison_index_contract", "items", "item_id", F.col("comparison_required"), "item_index", "item_id"),
        _intersect("missing_items_excluded", "items", "semantic_key", "missing_items", "semantic_key"),
        route_rule("missing_item_risk_routes", "missing_items", "semantic_key", F.lit(True), "risks", "target_id"),
        row_rule("table_contract", "tables", "table_id", _needs("table_id", "table_type", "status", no_rows=F.coalesce("n_rows", F.lit(0)) == 0)),
        reference_rule("table_evidence_refs", "tables", "table_id", _refs(), ev),
        text_rule("table_cell_text_from_evidence", "cells", "cell_id", "raw_value", "evidence_refs", "evidence", "evidence_id", "source_text"),
        route_rule("table_structure_risk_routes", "tables", "table_id", F.col("review_required") | (F.col("status") != "recovered"), "risks", "target_id"),
        row_rule("requirement_contract", "requirements", "requirement_id", _needs("requirement_id", "requirement_text", "status", refs="evidence_refs")),
        reference_rule("requirement_evidence_refs", "requirements", "requirement_id", _refs(), ev),
        text_rule("requirement_text_from_evidence", "requirements", "requirement_id", "requirement_text", "evidence_refs", "evidence", "evidence_id", "source_text"),
        row_rule("region_contract", "regions", "region_id", _needs("region_id", "region_type", "display_name", refs="source_span_ids", bad_page=page)),
        reference_rule("region_source_refs", "regions", "region_id", _refs("source_span_ids"), [*spans, ("nodes", "node_id")]),
        reference_rule("region_artifact_refs", "regions", "region_id", _refs("artifact_ids"), [("fields", "field_id"), ("tables", "table_id"), ("entities", "entity_id"), *ev]),
        *_graph("candidate_", "candidate_visual_document_graph_contract"),
        *_graph("", "visual_document_graph_contract"),
        _report("vdg_quality_report_contract", "vdg_quality"),
        _report("vdg_agent_context_contract", "vdg_context"),
        _report("vdg_consumption_report_contract", "vdg_consumption"),
        row_rule("label_text_scope_reference_contract", "scope_terms", "term", _needs("term", "category")),
        _report("label_text_scope_agent_context_contract", "scope_context"),
        _report("label_text_scope_report_contract", "scope_report"),
        _report("layout_evidence_contract", "layout_quality"),
        _report("semantic_review_contract", "semantic_review"),
        route_rule("region_vdg_refs", "regions", "region_id", F.lit(True), "nodes", "node_id"),
        row_rule("field_group_contract", "groups", "group_id", _needs("group_id", "group_type")),
        reference_rule("field_group_refs", "groups", "group_id", F.concat(_refs("field_ids"), _refs("table_ids")), [("fields", "field_id"), ("tables", "table_id")]),
        _same_text("field_group_text_matches_standard_item", "group_texts"),
        row_rule("list_contract", "lists", "list_id", _needs("list_id", "list_type", bad_count=F.col("item_count") != F.size(_refs("group_ids")))),
        reference_rule("list_group_refs", "lists", "list_id", _refs("group_ids"), [("groups", "group_id")]),
        row_rule("revision_block_contract", "revisions", "revision_id", _needs("revision_id", refs="evidence_refs", bad_role=~F.col("role").isin("before", "after"), bad_status=bad_status("current", "historical"))),
        reference_rule("revision_block_refs", "revisions", "revision_id", F.concat(_refs("field_ids"), _refs("source_span_ids"), _refs()), [("fields", "field_id"), *spans, *ev]),
        reference_rule("auto_ingest_refs", "auto_items", "item_id", F.array("item_id", "field_id"), [("items", "item_id"), ("fields", "field_id")]),
        _same_text("auto_ingest_text_matches_standard_item", "auto_items"),
        row_rule("auto_ingest_quality_gate", "gate", "document_id", {"high_risk": F.col("ingest_allowed") & (F.col("n_high") > 0)}),
        row_rule("risk_contract", "risks", "risk_id", _needs("target_id", "risk_type", "message", bad_level=~F.col("risk_level").isin("low", "medium", "high"))),
        row_rule("review_task_contract", "tasks", "task_id", _needs("target_id", "reason", bad_level=~F.col("risk_level").isin("low", "medium", "high"), no_flag=F.col("required").isNull())),
        reference_rule("risk_evidence_refs", "risks", "risk_id", _refs(), ev),
        reference_rule("risk_target_refs", "risks", "risk_id", F.array("target_id"), TARGETS),
        reference_rule("review_task_evidence_refs", "tasks", "task_id", _refs(), ev),
        reference_rule("review_task_target_refs", "tasks", "task_id", F.array("target_id"), TARGETS),
        route_rule("high_risk_review_tasks", "risks", "target_id", F.col("risk_level") == "high", "tasks", "target_id"),
        row_rule("quality_report_downstream_gate", "gate", "document_id", {"differs": F.col("downstream_allowed") != (F.col("status") == "pass")}),
        row_rule("ocr_line_contract", "ocr_lines", "line_id", _needs("line_id", "text", bad_page=page, bad_confidence=~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), bad_bbox_status=box_status)),
        row_rule("ocr_token_contract", "ocr_tokens", "token_id", _needs("token_id", "text", bad_page=page, bad_bbox_status=box_status)),
        reference_rule("ocr_block_refs", "ocr_blocks", "block_id", _refs("line_ids"), [("ocr_lines", "line_id")]),
        row_rule("ocr_block_refs_count", "ocr_blocks", "block_id", {"bad_count": F.col("line_count") != F.size(_refs("line_ids"))}),
        row_rule("required_keys_present", "metadata", "document_id", {"lacks_keys": F.size(F.array_except(F.array(*map(F.lit, ROOT)), _refs("root_keys"))) > 0}),
    ]


def _intersect(check: str, table: str, key: str, other: str, other_key: str) -> Rule:
    def failures(t: dict[str, DataFrame]) -> DataFrame:
        a = t[table].select(F.col(key).alias("target_id"))
        return a.intersect(t[other].select(F.col(other_key).alias("target_id"))).select("target_id", F.lit("excluded").alias("code"))

    return Rule(check, table, failures)


def _same_text(check: str, table: str) -> Rule:
    def failures(t: dict[str, DataFrame]) -> DataFrame:
        items = t["items"].select("item_id", F.col("text").alias("__t"))
        joined = t[table].join(items, "item_id").where(~F.col("text").eqNullSafe(F.col("__t")))
        return joined.select(F.col("item_id").alias("target_id"), F.lit("text_differs").alias("code")).distinct()

    return Rule(check, table, failures)
