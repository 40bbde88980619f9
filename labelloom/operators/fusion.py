"""Two readings of the same pages put together, and where they differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions.geometry import overlap_ratio
from labelloom.functions.text import compact, letters_only, sequence_ratio

SIMILAR, CONTAINED, LOW_CONFIDENCE, OVERLAP = 0.72, 0.6, 0.8, 0.2


#: Cells along each side of a page.
CELLS = 32


def canonical_spans(spans: DataFrame, lines: DataFrame, alignments: DataFrame) -> DataFrame:
    """(id, source): all page spans and those scanned lines that align with none."""
    matched = alignments.where(F.size("pdf_span_ids") > 0).select("ocr_line_id").distinct()
    extra = lines.join(matched, "ocr_line_id", "left_anti").select(F.col("ocr_line_id").alias("id"), F.lit("ocr").alias("source"))
    return spans.select(F.col("span_id").alias("id"), "source").distinct().unionByName(extra.distinct())


def relation(alignments: DataFrame) -> DataFrame:
    """(alignment_id, relation): equal, contains, contained, similar or different by the compared letters."""
    a, b = letters_only(F.col("pdf_text")), letters_only(F.col("ocr_text"))
    # a ratio that high needs lengths that near; Python sees nulls for all other pairs
    near = 2 * F.least(F.length(a), F.length(b)) >= SIMILAR * (F.length(a) + F.length(b))
    asked = near & (a != b) & ~F.contains(a, b) & ~F.contains(b, a)
    return alignments.select(
        "alignment_id",
        F.when(a == b, "equal")
        .when((b != "") & F.contains(a, b), "contains")
        .when((a != "") & F.contains(b, a), "contained")
        .when(sequence_ratio(F.when(asked, a), F.when(asked, b)) >= SIMILAR, "similar")
        .otherwise("different")
        .alias("relation"),
    ).distinct()


def best_overlap(boxes: DataFrame, spans: DataFrame, by: list[str], cell: float = 200.0) -> DataFrame:
    """(by..., line_id, span_id, overlap): for each box (line_id, box) the span (span_id, bbox) that it overlaps most.

    A grid of ``cell`` points turns the spatial join into an equi-join: boxes meet only in cells that both touch. What
    lies off the ``CELLS`` cells of a large page falls to the outermost ones, so no box is spread over more than those.
    """

    def cells(df: DataFrame, box: str) -> DataFrame:
        def place(v):
            return F.least(F.greatest(F.floor(v / cell), F.lit(0)), F.lit(CELLS - 1)).cast("int")

        def steps(lo, size):
            return F.sequence(place(lo), F.greatest(place(lo), place(lo + size)))

        b = F.col(box)
        present = df.where(b.isNotNull() & (b["width"] >= 0) & (b["height"] >= 0))
        return present.withColumn("__cx", F.explode(steps(b["x"], b["width"]))).withColumn("__cy", F.explode(steps(b["y"], b["height"])))

    met = cells(boxes, "box").join(cells(spans, "bbox"), [*by, "__cx", "__cy"])
    scored = met.withColumn("overlap", F.round(overlap_ratio(F.col("box"), F.col("bbox")), 4)).where(F.col("overlap") >= OVERLAP)
    return scored.groupBy(*by, "line_id").agg(
        F.max_by("span_id", F.struct("overlap", "span_id")).alias("span_id"), F.max("overlap").alias("overlap")
    )


def adhesions(spans: DataFrame, segments: DataFrame, by: list[str]) -> DataFrame:
    """Spans (span_id, text) that equal two or more segments (ord, text) of their line run together."""
    whole = segments.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"]), "").alias("joined"),
    )
    return (
        spans.join(whole.where(F.col("n") >= 2), by)
        .where(compact(F.col("text")) == compact(F.col("joined")))
        .select(*by, "span_id")
        .distinct()
    )


def source_profile(spans: DataFrame) -> DataFrame:
    """Per source: spans, share with a box, blank texts, control characters, spaced ideographs, least and mean confidence."""
    return spans.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_spans"),
        F.count_if(F.col("bbox_pdf").isNotNull()).alias("n_with_box"),
        F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("n_blank"),
        F.count_if(F.col("text").rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")).alias("n_control"),
        F.count_if(F.col("text").rlike(r"[一-鿿] +[一-鿿]")).alias("n_spaced"),
        F.count_if(F.col("confidence") < LOW_CONFIDENCE).alias("n_low"),
    )
