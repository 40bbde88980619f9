"""Results written out: JSON documents, an index of what was written, reports, redacted bundles, failure results."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.text import redacted

#: The parts of a result document, in order.
ROOT_KEYS = ("job", "document", "generated_schema", "extracted_data", "evidence", "cross_validation", "coverage", "validation", "quality", "risks", "review_tasks", "metadata")


def write_documents(results: DataFrame, key: str, path: str) -> None:
    """One JSON document per row, in a folder per bucket of the key, so that no folder grows without bound."""
    body = F.to_json(F.struct(*[c for c in results.columns if c != key]), {"ignoreNullFields": "false"})
    results.select(F.col(key), body.alias("document"), F.pmod(F.xxhash64(key), F.lit(64)).alias("bucket")).write.mode("overwrite").partitionBy(
        "bucket"
    ).json(path)


def artifact_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of every file under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sha256"))


def failure_results(failures: DataFrame) -> DataFrame:
    """A whole result document for each failed job (job_id, stage, error_type, reason): every part, most of them empty."""
    empty = F.array().cast("array<string>")
    parts: dict[str, Column] = {k: F.lit(None).cast("string") for k in ROOT_KEYS}
    parts |= {k: empty for k in ("evidence", "risks", "validation")}
    parts["job"] = F.to_json(F.struct("job_id", F.lit("failed").alias("status"), "stage", "error_type"))
    parts["review_tasks"] = F.array(F.to_json(F.struct(F.col("job_id").alias("target_id"), F.col("reason"), F.lit(True).alias("required"))))
    parts["quality"] = F.to_json(F.struct(F.lit("manual_review_required").alias("overall_status"), F.lit(False).alias("auto_ingest_allowed")))
    return failures.select("job_id", *[c.alias(k) if k != "job" else c.alias("job") for k, c in parts.items()])


def redacted_bundle(documents: DataFrame, text: str) -> DataFrame:
    """The documents with secrets and paths masked, and ``leak``: whether any pattern is still there."""
    out = documents.withColumn(text, redacted(F.col(text)))
    leak = F.col(text).rlike(r"(?i)(BEGIN (RSA|OPENSSH) PRIVATE KEY|AKIA[0-9A-Z]{16}|xox[bp]-|/home/|/root/|/Users/)")
    return out.withColumn("leak", leak)


def publishable(documents: DataFrame, text: str) -> DataFrame:
    """The masked documents; the job fails as soon as one of them still leaks."""
    bundle = redacted_bundle(documents, text)
    checked = F.when(F.col("leak"), F.raise_error(F.lit("a document still holds a secret or a path")).cast("string")).otherwise(F.col(text))
    return bundle.withColumn(text, checked).drop("leak")


def write_html(rows: DataFrame, job: str, columns: list[str], path: str) -> None:
    """A preview page per job, as text files; every value is escaped."""

    cells = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), _escaped(F.col(c)), F.lit("</td>")) for c in columns], F.lit("</tr>"))
    rows.select(F.col(job).alias("job"), cells.alias("value")).write.mode("overwrite").partitionBy("job").text(path)


def _escaped(c: Column) -> Column:
    t = F.coalesce(c.cast("string"), F.lit(""))
    for ch, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(ch), F.lit(entity))
    return t


def schema_document(df: DataFrame) -> str:
    """The schema of a table as a JSON text, to be written beside it."""
    return json.dumps(json.loads(df.schema.json()), ensure_ascii=False, indent=2)
