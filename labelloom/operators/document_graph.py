"""The whole graph of a document: six kinds of nodes, eleven of edges, states of spans, references that hold.

Nodes (node_id, kind, job_id), edges (source, target, kind, job_id); both distinct. Neighbour edges come from windows
over a page in reading order, everything else from keys, so no page is crossed with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Share of the larger height within which centres are on one row; columns are this wide, in points.
ROW, COLUMN = 0.6, 40.0


def page_id(job: str = "job_id", page: str = "page") -> Column:
    return F.concat_ws("|", F.lit("page"), F.col(job), F.col(page).cast("string"))


def _id(kind: str, *parts: str) -> Column:
    return F.concat_ws("|", F.lit(kind), *[F.col(p) for p in parts])


def nodes(spans: DataFrame, regions: DataFrame, cells: DataFrame) -> DataFrame:
    """Pages and spans of ``spans`` (job_id, page, span_id), regions of ``regions`` (job_id, region_id, span_id), tables,
    rows and cells of ``cells`` (job_id, table_id, row_key, cell_id, span_ids)."""
    kinds = [
        spans.select(page_id().alias("node_id"), F.lit("page").alias("kind"), "job_id"),
        spans.select(F.col("span_id"), F.lit("text_span"), "job_id"),
        regions.select(_id("region", "job_id", "region_id"), F.lit("region"), "job_id"),
        cells.select(_id("table", "job_id", "table_id"), F.lit("table"), "job_id"),
        cells.where(F.col("row_key").isNotNull()).select(_id("row", "job_id", "table_id", "row_key"), F.lit("table_row"), "job_id"),
        cells.select("cell_id", F.lit("table_cell"), "job_id"),
    ]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionAll(k)
    return out.distinct()


def edges(spans: DataFrame, regions: DataFrame, cells: DataFrame) -> DataFrame:
    """Edges of eleven kinds.

    has_span, in_region, has_table, has_row, has_cell, cell_of_table, cell_source; reading_order, same_row, above between
    neighbours in reading order, and same_column between neighbours of a column.
    """
    in_order = Window.partitionBy("job_id", "page").orderBy("y", "x", "span_id")
    mid = F.col("y") + F.col("height") / 2
    placed = spans.where(F.col("y").isNotNull()).select("job_id", "page", "span_id", "x", "y", "height", mid.alias("mid")).distinct()
    pair = placed.select(
        "job_id", F.col("span_id").alias("source"), F.lead("span_id").over(in_order).alias("target"), "mid", "height",
        F.lead("mid").over(in_order).alias("mid2"), F.lead("height").over(in_order).alias("height2"),
    ).where(F.col("target").isNotNull())
    one_row = F.abs(F.col("mid") - F.col("mid2")) <= F.greatest("height", "height2") * ROW
    kinds = F.array(F.lit("reading_order"), F.when(one_row, "same_row").otherwise("above"))
    in_column = Window.partitionBy("job_id", "page", F.floor(F.col("x") / COLUMN)).orderBy("y", "x", "span_id")
    column = placed.select(F.col("span_id").alias("source"), F.lead("span_id").over(in_column).alias("target"), F.lit("same_column").alias("kind"), "job_id")
    table, row = _id("table", "job_id", "table_id"), _id("row", "job_id", "table_id", "row_key")
    parts = [
        spans.select(page_id().alias("source"), F.col("span_id").alias("target"), F.lit("has_span").alias("kind"), "job_id"),
        pair.select("source", "target", F.explode(kinds).alias("kind"), "job_id"),
        column.where(F.col("target").isNotNull()),
        regions.where(F.col("span_id").isNotNull()).select("span_id", _id("region", "job_id", "region_id"), F.lit("in_region"), "job_id"),
        cells.select(F.concat_ws("|", F.lit("job"), "job_id"), table, F.lit("has_table"), "job_id"),
        cells.where(F.col("row_key").isNotNull()).select(table, row, F.lit("has_row"), "job_id"),
        cells.where(F.col("row_key").isNotNull()).select(row, "cell_id", F.lit("has_cell"), "job_id"),
        cells.select("cell_id", table, F.lit("cell_of_table"), "job_id"),
        cells.select("cell_id", F.explode("span_ids").alias("target"), F.lit("cell_source"), "job_id").where(F.col("target").isNotNull()),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.distinct()


def edge_faults(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """(source, target, kind, fault): edges with an end that is no node, or that lead to themselves."""
    known = node_rows.select("node_id").distinct()
    ends = edge_rows.where(~F.col("source").startswith("job|")).select("source", "target", "kind", F.explode(F.array("source", "target")).alias("node_id"))
    unknown = ends.join(known, "node_id", "left_anti").select("source", "target", "kind", F.lit("unknown_node").alias("fault"))
    loops = edge_rows.where(F.col("source") == F.col("target")).select("source", "target", "kind", F.lit("loop").alias("fault"))
    return unknown.unionAll(loops).distinct()


def edges_among(edge_rows: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges whose both ends are in ``keep`` (node_id)."""
    known = keep.select("node_id").distinct()
    once = edge_rows.join(known.withColumnRenamed("node_id", "source"), "source", "left_semi")
    return once.join(known.withColumnRenamed("node_id", "target"), "target", "left_semi").select(*edge_rows.columns)


def span_states(spans: DataFrame, targets: DataFrame, listed: DataFrame, structural: Column, ignored: Column, important: Column) -> DataFrame:
    """(span_id, state): by priority structural, ignored, conflict (several targets), extracted, unknown (listed or
    important), else ignored. ``targets`` (span_id, target), ``listed`` (span_id)."""
    n = targets.groupBy("span_id").agg(F.count_distinct("target").alias("n"))
    known = listed.select("span_id").distinct().withColumn("listed", F.lit(True))
    state = (
        F.when(structural, "structural").when(ignored, "ignored").when(F.col("n") > 1, "conflict").when(F.col("n") == 1, "extracted")
        .when(F.col("listed") | important, "unknown").otherwise("ignored")
    )
    return spans.join(n, "span_id", "left").join(known, "span_id", "left").select("span_id", state.alias("state"))
