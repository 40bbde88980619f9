"""Extraction plans compiled to fields that always trace back to evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fields below this confidence need review if critical.
CRITICAL_CONFIDENCE = 0.95


def compile_fields(plan: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fields, rejects) of a plan (field_id, criticality, range_no, span_id, start_offset, end_offset) over spans.

    Offsets are half-open and 0-based. A range whose span is unknown or whose bounds are wrong is a reject, and so is
    its field; nothing is guessed. Parts are joined in the order of their ranges, confidence is the least of all parts,
    0.8 for a part without a box.
    """
    joined = plan.join(spans.select("span_id", "text", F.col("bbox_pdf").isNotNull().alias("has_box")), "span_id", "left")
    bad = (
        F.when(F.col("text").isNull(), "unknown_span")
        .when((F.col("start_offset") < 0) | (F.col("end_offset") <= F.col("start_offset")) | (F.col("end_offset") > F.length("text")), "bad_range")
    )
    checked = joined.withColumn("reject_reason", bad).withColumn(
        "part", F.substring(F.col("text"), F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset"))
    )
    rejects = checked.where(F.col("reject_reason").isNotNull()).select("field_id", "range_no", "span_id", "reject_reason")
    confidence = F.min(F.when(F.col("has_box"), 1.0).otherwise(0.8))
    compiled = checked.groupBy("field_id", "criticality").agg(
        F.count_if(F.col("reject_reason").isNotNull()).alias("n_bad"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("range_no", "span_id", "part"))), lambda x: x["part"]), ""
        ).alias("raw_value"),
        F.array_sort(F.collect_set("span_id")).alias("evidence_refs"),
        confidence.alias("confidence"),
    )
    fields = compiled.where(F.col("n_bad") == 0).drop("n_bad").withColumn("review_required", needs_review())
    return fields, rejects


def needs_review() -> Column:
    """Critical fields below the threshold."""
    return (F.col("criticality") == "critical") & (F.col("confidence") < CRITICAL_CONFIDENCE)


def repaired_ranges(plan: DataFrame, spans: DataFrame) -> DataFrame:
    """Ranges whose claimed text does not stand at their offsets, moved to where it is found first in the span."""
    joined = plan.join(spans.select("span_id", F.col("text").alias("span_text")), "span_id")
    here = F.substring(F.col("span_text"), F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset"))
    found = F.locate_at(F.col("text"), F.col("span_text")) if hasattr(F, "locate_at") else F.expr("locate(text, span_text)")
    return joined.select(
        "field_id",
        "range_no",
        "span_id",
        F.when(here == F.col("text"), F.col("start_offset")).when(found > 0, found - 1).alias("start_offset"),
        F.when(here == F.col("text"), F.col("end_offset")).when(found > 0, found - 1 + F.length("text")).alias("end_offset"),
        F.when(here == F.col("text"), "ok").when(found > 0, "moved").otherwise("rejected").alias("result"),
    )


def joined_text(parts: DataFrame, by: list[str], order: str, text: str, x: Column, width: Column) -> DataFrame:
    """Parts of one line put together; a blank where letters or digits stand more than a point apart."""
    w = Window.partitionBy(*by).orderBy(order)
    gap = x - F.lag(x + width).over(w)
    before = F.lag(text).over(w)
    separator = F.when((gap > 1) & before.rlike(r"[A-Za-z0-9]$") & F.col(text).rlike(r"^[A-Za-z0-9]"), " ").otherwise("")
    return (
        parts.withColumn("__p", F.concat(separator, F.col(text)))
        .groupBy(*by)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "__p"))), lambda s: s["__p"]), "").alias(text))
    )


def revision_roles(blocks: DataFrame) -> DataFrame:
    """(field_id, role): the role that the last revision block gives to each of its fields."""
    one = blocks.select("ord", "role", F.explode("field_ids").alias("field_id"))
    return one.groupBy("field_id").agg(F.max_by("role", "ord").alias("role"))
