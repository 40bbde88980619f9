"""Queries of the text operators and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm import bpe, canon, leaks, looks, places, residue, scans
from labelloom.session import table


def _span_and_candidate_texts(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "text_spans").select(F.lit("text_spans").alias("tbl"), "job_id", F.col("span_id").alias("rec"), F.col("text").alias("txt"))
    cands = table(spark, d, "compare_candidates").select(
        F.lit("compare_candidates").alias("tbl"), "job_id", F.col("candidate_id").alias("rec"), F.col("normalized_text").alias("txt")
    )
    return spans.unionAll(cands)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return looks.same_look_pairs(_span_and_candidate_texts(spark, d), ["tbl", "job_id"], "rec", "txt")


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each record whose look is written in several ways, with its class and its number of links."""
    return looks.same_look_classes(_span_and_candidate_texts(spark, d), ["tbl", "job_id"], "rec", "txt")


def p1_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every text with its one form."""
    return looks.with_look(_span_and_candidate_texts(spark, d).select("tbl", "rec", "txt"), "txt")


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    catalog = table(spark, d, "label_catalog")
    typed = (
        table(spark, d, "main_labels").select(F.col("row_id").alias("rec"), F.col("label_item").alias("label"))
        .unionAll(table(spark, d, "standard_items").select(F.col("id").alias("rec"), "label"))
    )
    return canon.map_to_catalog(typed, "rec", "label", catalog)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).select("rec_id", "catalog_id").distinct()


def p4_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The values that mean no entry, with their number of records."""
    unmatched = _mapped(spark, d).where(F.col("catalog_id") == 0).select("rec_id", "value").distinct()
    return unmatched.groupBy("value").agg(F.count(F.lit(1)).alias("n_records"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noisy_records(table(spark, d, "source_alignments"), table(spark, d, "compare_candidates"))


def p5_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The paragraphs of all pages, blocks and loose lines as continuous text."""
    return scans.whole_paragraphs(table(spark, d, "source_alignments"), table(spark, d, "compare_candidates"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return places.same_places(table(spark, d, "enterprises"), "record_id", "address_raw")


def p7_places(spark: SparkSession, d: str) -> DataFrame:
    """Each record that shares its place with others, with the place's first record and its number of links."""
    return places.place_classes(table(spark, d, "enterprises"), "record_id", "address_raw")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_column(table(spark, d, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaking_documents(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_documents(table(spark, d, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    "p1_forms": p1_forms,
    "p4_found": p4_found,
    "p4_unmatched": p4_unmatched,
    "p5_found": p5_found,
    "p5_paragraphs": p5_paragraphs,
    "p7_found": p7_found,
    "p7_places": p7_places,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p10_found": p10_found,
}

SQL: dict[str, str] = {}
