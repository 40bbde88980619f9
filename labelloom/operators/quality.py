"""Checks as rows: rules over tables give check results; failed ones become risks, high risks become review tasks.

A contract is a list of rules. Each rule is one of a few kinds, so that every check of a contract is a declaration:
a row rule (violation codes per row), a unique rule, a reference rule (anti-join), a route rule (every failure must be
answered by a risk or task) and an aggregate rule.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """One check: ``failures(tables)`` gives (target_id, code) of everything that violates it."""

    check: str
    target: str
    failures: Callable[[dict[str, DataFrame]], DataFrame]
    level: str = "high"
    #: Of a row rule its (key, codes), of a reference rule its (key, refs, to): rules of one table share a scan.
    codes: tuple[str, dict[str, Column]] | None = None
    refs: tuple[str, Column, list[tuple[str, str]]] | None = None


def row_rule(check: str, table: str, key: str, codes: dict[str, Column], level: str = "high") -> Rule:
    """Every row of ``table`` is checked for the violations ``codes`` (code: condition that is wrong)."""

    def failures(t: dict[str, DataFrame]) -> DataFrame:
        found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in codes.items()]))
        return t[table].select(F.col(key).cast("string").alias("target_id"), F.explode(found).alias("code")).distinct()

    return Rule(check, table, failures, level, codes=(key, codes))


def unique_rule(check: str, table: str, key: str, by: list[str] | None = None, level: str = "high") -> Rule:
    """``key`` occurs once (among distinct rows of ``by``)."""

    def failures(t: dict[str, DataFrame]) -> DataFrame:
        rows = t[table].where(F.col(key).isNotNull())
        rows = rows.select(*dict.fromkeys([key, *by])).distinct() if by else rows
        return (
            rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
            .select(F.col(key).cast("string").alias("target_id"), F.lit("duplicate").alias("code"))
        )

    return Rule(check, table, failures, level)


def reference_rule(check: str, table: str, key: str, refs: Column, to: list[tuple[str, str]], level: str = "high") -> Rule:
    """Every element of ``refs`` (an array column) is a key of one of the tables ``to``."""

    def failures(t: dict[str, DataFrame]) -> DataFrame:
        known = None
        for other, column in to:
            k = t[other].select(F.col(column).cast("string").alias("ref"))
            known = k if known is None else known.unionAll(k)
        named = t[table].select(F.col(key).cast("string").alias("target_id"), F.explode(refs).alias("ref")).where(F.col("ref").isNotNull())
        return (
            named.withColumn("ref", F.col("ref").cast("string"))
            .join(known.distinct(), "ref", "left_anti")
            .select("target_id", F.lit("unknown_reference").alias("code"))
            .distinct()
        )

    return Rule(check, table, failures, level, refs=(key, refs, to))


def text_rule(check: str, table: str, key: str, text: str, refs: str, evidence: str, evidence_key: str, source: str, level: str = "high") -> Rule:
    """The letters of ``text`` stand in the text of at least one referenced evidence; a reference that leads nowhere holds
    none. Rows without text or without references are left to other rules."""

    def failures(t: dict[str, DataFrame]) -> DataFrame:
        squeeze = lambda c: F.regexp_replace(c, r"\s+", "")
        rows = t[table].where(F.trim(text) != "")
        named = rows.select(F.col(key).cast("string").alias("target_id"), squeeze(F.col(text)).alias("t"), F.explode(refs).alias("ref"))
        seen = named.join(t[evidence].select(F.col(evidence_key).alias("ref"), squeeze(F.col(source)).alias("s")), "ref", "left")
        return (
            seen.groupBy("target_id").agg(F.bool_or(F.coalesce(F.contains("s", "t"), F.lit(False))).alias("ok")).where(~F.col("ok"))
            .select("target_id", F.lit("text_not_in_evidence").alias("code"))
        )

    return Rule(check, table, failures, level)


def route_rule(check: str, table: str, key: str, condition: Column, answered_by: str, answer_key: str, level: str = "high") -> Rule:
    """Every row of ``table`` under ``condition`` has an answer in ``answered_by``."""

    def failures(t: dict[str, DataFrame]) -> DataFrame:
        open_rows = t[table].where(condition).select(F.col(key).cast("string").alias("target_id")).distinct()
        answers = t[answered_by].select(F.col(answer_key).cast("string").alias("target_id")).distinct()
        return open_rows.join(answers, "target_id", "left_anti").select("target_id", F.lit("no_route").alias("code"))

    return Rule(check, table, failures, level)


def aggregate_rule(check: str, table: str, wrong: Column, level: str = "high") -> Rule:
    """An aggregate over the whole table is as it must be."""

    def failures(t: dict[str, DataFrame]) -> DataFrame:
        return t[table].agg(wrong.alias("wrong")).where("wrong").select(F.lit(table).alias("target_id"), F.lit("aggregate").alias("code"))

    return Rule(check, table, failures, level)


_FAILURE = ["check", "target_type", "target_id", "code", "level"]


def _row_failures(name: str, rules: list[Rule], df: DataFrame) -> DataFrame:
    """All row rules of a table in one scan."""
    found = []
    for r in rules:
        key, codes = r.codes
        for code, wrong in codes.items():
            one = F.struct(F.lit(r.check).alias("check"), F.col(key).cast("string").alias("target_id"), F.lit(code).alias("code"), F.lit(r.level).alias("level"))
            found.append(F.when(F.coalesce(wrong, F.lit(False)), one))
    out = df.select(F.explode(F.array_compact(F.array(*found))).alias("f"))
    return out.select("f.check", F.lit(name).alias("target_type"), "f.target_id", "f.code", "f.level").distinct()


def _named_by(r: Rule, sets: list) -> Callable[[Column], Column]:
    of = sets.index(tuple(r.refs[2]))
    return lambda x: F.struct(
        F.lit(r.check).alias("check"), F.col(r.refs[0]).cast("string").alias("target_id"), F.lit(r.level).alias("level"), F.lit(of).alias("of"), x.alias("ref")
    )


def _reference_failures(rules: list[Rule], tables: dict[str, DataFrame]) -> DataFrame:
    """All reference rules in one anti-join: references of a table come from one scan, keys of a table are read once."""
    sets = list(dict.fromkeys(tuple(r.refs[2]) for r in rules))
    named = None
    for name in dict.fromkeys(r.target for r in rules):
        own = [r for r in rules if r.target == name]
        arrays = [F.transform(F.coalesce(r.refs[1].cast("array<string>"), F.array().cast("array<string>")), _named_by(r, sets)) for r in own]
        one = tables[name].select(F.lit(name).alias("target_type"), F.explode(F.concat(*arrays)).alias("f")).select("target_type", "f.*").where(F.col("ref").isNotNull())
        named = one if named is None else named.unionByName(one)
    known = None
    for table, column in dict.fromkeys(x for to in sets for x in to):
        of = F.array(*[F.lit(n) for n, to in enumerate(sets) if (table, column) in to])
        k = tables[table].select(F.explode(of).alias("of"), F.col(column).cast("string").alias("ref"))
        known = k if known is None else known.unionAll(k)
    return (
        named.join(known.distinct(), ["of", "ref"], "left_anti")
        .select("check", "target_type", "target_id", F.lit("unknown_reference").alias("code"), "level")
        .distinct()
    )


def failures_of(rules: list[Rule], tables: dict[str, DataFrame]) -> DataFrame:
    """(check, target_type, target_id, code, level) of all failures of all rules."""
    parts = []
    rows = [r for r in rules if r.codes]
    for name in dict.fromkeys(r.target for r in rows):
        parts.append(_row_failures(name, [r for r in rows if r.target == name], tables[name]))
    if refs := [r for r in rules if r.refs]:
        parts.append(_reference_failures(refs, tables))
    for r in rules:
        if not r.codes and not r.refs:
            parts.append(r.failures(tables).select(F.lit(r.check).alias("check"), F.lit(r.target).alias("target_type"), "target_id", "code", F.lit(r.level).alias("level")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p.select(*_FAILURE))
    return out


def contract_report(rules: list[Rule], tables: dict[str, DataFrame]) -> DataFrame:
    """(check, result, n_failures): one row per check, passed ones too."""
    spark = next(iter(tables.values())).sparkSession
    names = spark.createDataFrame([(r.check,) for r in rules], "check string")
    counts = failures_of(rules, tables).groupBy("check").agg(F.count(F.lit(1)).alias("n_failures"))
    return names.join(F.broadcast(counts), "check", "left").select(  # one row per check
        "check",
        F.when(F.coalesce("n_failures", F.lit(0)) == 0, "passed").otherwise("failed").alias("result"),
        F.coalesce("n_failures", F.lit(0)).alias("n_failures"),
    )


def risks_of(failures: DataFrame) -> DataFrame:
    """(target_type, target_id, risk_level, n_checks): failures of one target gathered, the highest level counts."""
    rank = F.when(F.col("level") == "high", 3).when(F.col("level") == "medium", 2).when(F.col("level") == "low", 1).otherwise(0)
    return failures.groupBy("target_type", "target_id").agg(
        F.max_by("level", rank).alias("risk_level"), F.count_distinct("check").alias("n_checks")
    )


def review_tasks_of(risks: DataFrame) -> DataFrame:
    """Required review tasks: one for every high risk."""
    return risks.where(F.col("risk_level") == "high").select("target_type", "target_id", F.lit(True).alias("required"))


def gate(df: DataFrame, by: list[str], conditions: dict[str, Column]) -> DataFrame:
    """(by..., conditions..., passed): every gate and all of them together."""
    out = df.groupBy(*by).agg(*[F.bool_and(c).alias(n) for n, c in conditions.items()])
    every = F.lit(True)
    for n in conditions:
        every = every & F.col(n)
    return out.withColumn("passed", every)


#: The contract over this project's tables.
def project_contract() -> list[Rule]:
    """Checks of identity, references, evidence and routes over items, evidence, spans, alignments and candidates."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    refs = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    return [
        row_rule("evidence_contract", "evidence_items", "evidence_id", {
            "no_text": blank("source_text"), "bad_page": F.col("page").isNull() | (F.col("page") < 1),
            "no_method": F.size(refs("extraction_methods")) == 0,
            "bad_bbox_status": ~F.col("bbox_status").isin("available", "missing")}),
        unique_rule("evidence_unique_ids", "evidence_items", "evidence_id", ["source_text", "page"]),
        reference_rule("evidence_source_refs", "evidence_items", "evidence_id", refs("source_node_ids"), [("text_spans", "span_id"), ("source_alignments", "ocr_line_id")]),
        row_rule("standard_item_contract", "standard_items", "id", {
            "no_key": blank("semantic_key"), "no_label": blank("label"), "no_text": blank("text"),
            "no_flag": F.col("comparison_required").isNull() | F.col("review_required").isNull()}, "medium"),
        unique_rule("standard_item_unique_ids", "standard_items", "id", ["semantic_key", "text"]),
        reference_rule("standard_item_refs", "standard_items", "id", refs("evidence_refs"), [("evidence_items", "evidence_id")]),
        reference_rule("standard_item_source_refs", "standard_items", "id", refs("source_ids"), [("text_spans", "span_id"), ("source_alignments", "ocr_line_id")]),
        text_rule("standard_item_text_from_evidence", "standard_items", "id", "text", "evidence_refs", "evidence_items", "evidence_id", "source_text", "medium"),
        row_rule("span_contract", "text_spans", "span_id", {
            "no_text": blank("text"), "bad_page": F.col("page").isNull() | (F.col("page") < 1),
            "bad_confidence": ~F.col("confidence").between(0, 1),
            "bad_source": ~F.col("source").isin("pdf_text", "pdf_char_atom", "ocr", "xlsx_cell")}, "low"),
        row_rule("span_bbox_contract", "text_spans", "span_id", {
            "empty_box": (F.col("bbox_pdf.width") <= 0) | (F.col("bbox_pdf.height") <= 0),
            "negative_box": (F.col("bbox_pdf.x") < 0) | (F.col("bbox_pdf.y") < 0),
            "beyond_page": F.col("bbox_pdf.x") + F.col("bbox_pdf.width") > F.col("bbox_pdf.page_width")}, "medium"),
        unique_rule("span_unique_ids", "text_spans", "span_id", ["text", "job_id"]),
        row_rule("alignment_contract", "source_alignments", "alignment_id", {
            "no_line": blank("ocr_line_id"), "bad_similarity": ~F.col("text_similarity").between(0, 1)}),
        reference_rule("alignment_span_refs", "source_alignments", "alignment_id", refs("pdf_span_ids"), [("text_spans", "span_id")]),
        reference_rule("candidate_target_refs", "compare_candidates", "candidate_id", F.array("target_id"), [("standard_items", "id")]),
        reference_rule("candidate_line_refs", "compare_candidates", "candidate_id", refs("source_ocr_line_ids"), [("source_alignments", "ocr_line_id")]),
        row_rule("candidate_contract", "compare_candidates", "candidate_id", {
            "no_text": blank("text"), "bad_score": ~F.col("score").between(0, 1),
            "bad_box": (F.col("bbox_normalized.x1") > F.col("bbox_normalized.x2")) | (F.col("bbox_normalized.y1") > F.col("bbox_normalized.y2"))}),
        route_rule("compared_items_have_candidates", "standard_items", "id", F.col("comparison_required"), "compare_candidates", "target_id", "medium"),
        aggregate_rule("items_present", "standard_items", F.count(F.lit(1)) == 0),
    ]
