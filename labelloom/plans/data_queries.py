"""Queries of the general data problems (references, nested records, packed fields) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.operators import nested, packed, references
from labelloom.session import table


def _broken(spark: SparkSession, d: str) -> DataFrame:
    return references.broken_references(
        table(spark, d, "standard_items"),
        table(spark, d, "evidence_items"),
        table(spark, d, "text_spans"),
        table(spark, d, "source_alignments"),
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _broken(spark, d).select("id", "ref_column", "ref_id", "ref_state")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return references.reference_report(_broken(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.nested_links(table(spark, d, "parse_results"))


def _flat(kind: str):
    """The query of the flat table of one kind."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        nodes = nested.nested_nodes(table(spark, d, "parse_results"))
        return nested.flat_table(nodes, kind)

    return query


#: The flat table of each kind of node.
FLAT = {
    "p3_tables": "table",
    "p3_rows": "row",
    "p3_cells": "cell",
    "p3_cell_refs": "cell_ref",
    "p3_evidence": "evidence",
    "p3_nodes": "node",
    "p3_entities": "entity",
    "p3_fields": "field",
    "p3_field_refs": "field_ref",
    "p3_requirements": "requirement",
}


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.packed_values(
        table(spark, d, "content_items"), "content_row_id", "job_id", "ingredients_raw", "ingredient"
    )


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return p6_found(spark, d).groupBy("ingredient").agg(F.count(F.lit(1)).alias("n_rows"))


QUERIES = {
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p3_found": p3_found,
    **{name: _flat(kind) for name, kind in FLAT.items()},
    "p6_found": p6_found,
    "p6_counts": p6_counts,
}

_P2 = r"""
WITH refs AS (
  SELECT id, 'evidence_refs' AS ref_column, unnest(evidence_refs) AS raw, created_at FROM standard_items
  UNION ALL
  SELECT id, 'source_ids', unnest(source_ids), created_at FROM standard_items),
keyed AS (
  SELECT id, ref_column, lower(trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(8194) || chr(8195) || chr(8201) || chr(8239) || chr(12288) || chr(65279))) AS ref_id,
         min(strftime(created_at, '%Y-%m')) AS period
  FROM refs WHERE raw IS NOT NULL AND id IS NOT NULL GROUP BY 1, 2, 3),
items AS (SELECT id, min(ingested_at) AS item_seen FROM standard_items GROUP BY 1),
parents AS (
  SELECT 'evidence_refs' AS ref_column, lower(trim(evidence_id)) AS ref_id, min(ingested_at) AS first_seen,
         bool_or(deleted_at IS NOT NULL) AS gone FROM evidence_items GROUP BY 2
  UNION ALL
  SELECT 'source_ids', k, min(t), false FROM (
    SELECT lower(trim(span_id)) AS k, ingested_at AS t FROM text_spans
    UNION ALL SELECT lower(trim(ocr_line_id)), ingested_at FROM source_alignments) GROUP BY 2),
broken AS (
  SELECT k.id, k.ref_column, k.ref_id, k.period,
         CASE WHEN p.ref_id IS NULL THEN 'missing' WHEN p.gone THEN 'deleted'
              WHEN p.first_seen > i.item_seen THEN 'late' END AS ref_state
  FROM keyed k JOIN items i USING (id)
  LEFT JOIN parents p ON p.ref_column = k.ref_column AND p.ref_id = k.ref_id
  WHERE k.ref_id <> '')
"""

SQL = {
    "p2_found": _P2 + "SELECT id, ref_column, ref_id, ref_state FROM broken WHERE ref_state IS NOT NULL",
    "p2_report": _P2
    + "SELECT ref_column, period, ref_state, count(*) AS n_refs FROM broken WHERE ref_state IS NOT NULL GROUP BY 1, 2, 3",
}
