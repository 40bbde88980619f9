"""The visual document graph as two tables: nodes (node_id, node_type) and edges (source, target, edge_type)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.operators.sequences import adjacent_edges, top_k


def nodes_and_edges(spans: DataFrame, evidence: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages, spans, evidence and items with their edges: contains, reading_order, supports, cites."""
    page = F.concat_ws("#", "job_id", "page")
    s = spans.where(F.col("span_id").isNotNull()).select("span_id", "job_id", "page", "ord").distinct()
    nodes = (
        s.select(page.alias("node_id"), F.lit("page").alias("node_type"))
        .unionAll(s.select("span_id", F.lit("text_span")))
        .unionAll(evidence.select("evidence_id", F.lit("evidence")))
        .unionAll(items.select("id", F.lit("item")))
        .where(F.col("node_id").isNotNull())
        .distinct()
    )
    order = adjacent_edges(s, ["job_id", "page"], ["ord", "span_id"], "span_id").select("source", "target", "edge_type")
    edges = (
        s.select(page.alias("source"), F.col("span_id").alias("target"), F.lit("contains").alias("edge_type"))
        .unionAll(order)
        .unionAll(evidence.select(F.explode("source_node_ids"), "evidence_id", F.lit("supports")))
        .unionAll(items.select("id", F.explode("evidence_refs"), F.lit("cites")))
        .where(F.col("source").isNotNull() & F.col("target").isNotNull())
        .distinct()
    )
    return nodes, edges


def unresolved_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ids = nodes.select(F.col("node_id").alias("n")).distinct()
    bad_source = edges.join(ids, edges.source == ids.n, "left_anti")
    bad_target = edges.join(ids, edges.target == ids.n, "left_anti")
    return bad_source.unionAll(bad_target).distinct()


def neighbours(edges: DataFrame, k: int = 8) -> DataFrame:
    """The first ``k`` outgoing edges of each node, in the order of type and target."""
    return top_k(edges, ["source"], [F.col("edge_type"), F.col("target")], k, "edge_no")


def degree_counts(edges: DataFrame) -> DataFrame:
    """(edge_type, n_edges, n_sources, n_targets)."""
    return edges.groupBy("edge_type").agg(
        F.count(F.lit(1)).alias("n_edges"), F.count_distinct("source").alias("n_sources"), F.count_distinct("target").alias("n_targets")
    )


def coverage(spans: DataFrame, mappings: DataFrame) -> DataFrame:
    """(span_id, n_mappings, status): extracted, conflict (several kinds of target) or unknown."""
    per_span = mappings.groupBy("span_id").agg(
        F.count(F.lit(1)).alias("n_mappings"), F.count_distinct("target_type").alias("n_types")
    )
    return spans.select("span_id").distinct().join(per_span, "span_id", "left").select(
        "span_id",
        F.coalesce("n_mappings", F.lit(0)).alias("n_mappings"),
        F.when(F.col("n_types") > 1, "conflict").when(F.col("n_types") == 1, "extracted").otherwise("unknown").alias("status"),
    )
