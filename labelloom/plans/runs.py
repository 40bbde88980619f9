"""Whole runs: tables in, result documents out, with a state record for every stage."""

from __future__ import annotations

import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.operators import compare, metrics, quality
from labelloom.session import table
from labelloom.sinks import artifacts

STAGES = ("compare", "contract", "report", "index")


def consistency_run(spark: SparkSession, tables_dir: str, out: str) -> list[dict]:
    """Compare, check the contract, write one document per job; returns (stage, status, seconds, reason) of each stage.

    A stage that fails ends the run; the failure is still written as a whole result document.
    """
    record: list[dict] = []

    def stage(name: str, run):
        began = time.monotonic()
        try:
            value = run()
            record.append({"stage": name, "status": "done", "seconds": round(time.monotonic() - began, 3), "reason": None})
            return value
        except Exception as x:
            record.append({"stage": name, "status": "failed", "seconds": round(time.monotonic() - began, 3), "reason": f"{type(x).__name__}: {x}"[:500]})
            failed = spark.createDataFrame([("run", name, type(x).__name__, str(x)[:500])], "job_id string, stage string, error_type string, reason string")
            artifacts.failure_results(failed).write.mode("overwrite").json(f"{out}/failure")
            raise

    t = {n: table(spark, tables_dir, n) for n in ("standard_items", "compare_candidates", "evidence_items", "text_spans", "source_alignments")}
    results = f"{out}/results"

    def compared():
        status = compare.match_status(compare.standard_targets(t["standard_items"]), t["compare_candidates"])
        jobs = compare.standard_targets(t["standard_items"]).select("target_id", "job_id", "semantic_key")
        status.join(jobs, "target_id").write.mode("overwrite").parquet(results)

    stage("compare", compared)
    stage("contract", lambda: quality.contract_report(quality.project_contract(), t).write.mode("overwrite").json(f"{out}/contract"))
    stage("report", lambda: artifacts.write_documents(job_report(spark.read.parquet(results)), "job_id", f"{out}/documents"))
    stage("index", lambda: artifacts.artifact_index(spark, f"{out}/documents").write.mode("overwrite").json(f"{out}/index"))
    return record


def job_report(results: DataFrame) -> DataFrame:
    """(job_id, overall and counts, share of required items matched) of compared items."""
    overall = compare.overall_status(results, ["job_id"])
    required = F.col("n_pass") + F.col("n_critical")
    return overall.withColumn("matched_share", F.round(F.try_divide(F.col("n_pass"), required), 4))


def evaluate(expected: DataFrame, actual: DataFrame, by: list[str], keys: list[str], least_recall: float = 0.95) -> DataFrame:
    """(by..., recall, precision, ..., passed): an evaluation of found keys against expected ones with its gate."""
    m = metrics.recall_precision(expected, actual, by, keys)
    return m.withColumn("passed", F.col("recall") >= least_recall)


def cases(spark: SparkSession, manifest: str) -> DataFrame:
    """(case_id, ord, glob) of a case list in JSON."""
    raw = spark.read.option("multiLine", "true").json(str(Path(manifest)))
    one = raw.select(F.posexplode("cases").alias("ord", "c"))
    return one.select(F.col("c.case_id").alias("case_id"), "ord", F.col("c.glob").alias("glob"))
