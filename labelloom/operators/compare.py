"""Expected items against observed candidates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.text import compare_key, match_score
from labelloom.operators.sequences import keep_best, top_k

#: From this score a candidate that does not match is taken for the expected text misprinted.
VIABLE, VIABLE_LONG = 0.72, 0.55
#: An expected text is long from this many letters on, or if its key ends so.
LONG_LETTERS, LONG_SUFFIX = 40, ".ingredients"


def standard_targets(items: DataFrame) -> DataFrame:
    """Items to look for: with text, one row per id (the first delivery), their comparable form and whether it is long."""
    first = keep_best(items.where(F.col("id").isNotNull()), ["id"], [F.col("ingested_at"), F.col("text")])
    key = compare_key(F.col("text"))
    return first.where(F.trim("text") != "").select(
        F.col("id").alias("target_id"),
        "job_id",
        "semantic_key",
        key.alias("expected"),
        "comparison_required",
        "review_required",
        ((F.length(key) > LONG_LETTERS) | F.col("semantic_key").endswith(LONG_SUFFIX)).alias("is_long"),
    )


def candidate_texts(candidates: DataFrame) -> DataFrame:
    """One row per candidate with its comparable form."""
    return (
        candidates.where(F.col("candidate_id").isNotNull())
        .groupBy("candidate_id", "target_id")
        .agg(F.min("text").alias("text"), F.min("score").alias("score"), F.min(F.size("source_ocr_line_ids")).alias("n_lines"))
        .withColumn("observed", compare_key(F.col("text")))
    )


def match_status(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """(target_id, status, reason, candidate_id): pass, review, mismatch or missing of every target.

    Exact candidates win; else the best viable one; ties keep the first id.
    """
    scored = (
        targets.join(candidate_texts(candidates), "target_id")
        .withColumn("fit", match_score(F.col("expected"), F.col("observed"), F.col("is_long")))
        .withColumn("exact", F.col("expected") == F.col("observed"))
    )
    best = keep_best(scored, ["target_id"], [F.desc("exact"), F.desc("fit"), F.col("n_lines"), F.col("candidate_id")])
    drowned = F.contains(F.col("observed"), F.col("expected")) & (
        F.length("observed") > F.greatest(F.length("expected") * 2, F.length("expected") + 8)
    )
    viable = (F.col("fit") >= F.when(F.col("is_long"), VIABLE_LONG).otherwise(VIABLE)) & ~drowned
    joined = targets.join(best.select("target_id", "candidate_id", "exact", viable.alias("viable")), "target_id", "left")
    return joined.select(
        "target_id",
        *status_columns(F.coalesce(F.col("exact"), F.lit(False)), F.coalesce(F.col("viable"), F.lit(False))),
        F.when(F.col("exact") | F.col("viable"), F.col("candidate_id")).alias("candidate_id"),
    )


def status_columns(exact: Column, viable: Column) -> list[Column]:
    """(status, reason) by the order of decisions: not required, for review, matched, mismatch, missing."""
    status = (
        F.when(~F.col("comparison_required") | F.col("review_required"), "manual_review")
        .when(exact, "pass")
        .when(viable, "critical_mismatch")
        .otherwise("critical_missing")
    )
    reason = (
        F.when(~F.col("comparison_required"), "comparison_not_required")
        .when(F.col("review_required"), "review_required")
        .when(exact, "matched")
        .when(viable, "best_candidate_differs")
        .otherwise("no_reliable_candidate_found")
    )
    return [status.alias("status"), reason.alias("reason")]


def overall_status(results: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n_pass, n_review, n_critical, overall): fail if anything is critical, else review, else pass."""
    out = results.groupBy(*by).agg(
        F.count_if(F.col("status") == "pass").alias("n_pass"),
        F.count_if(F.col("status") == "manual_review").alias("n_review"),
        F.count_if(F.col("status").startswith("critical")).alias("n_critical"),
    )
    return out.withColumn(
        "overall", F.when(F.col("n_critical") > 0, "fail").when(F.col("n_review") > 0, "manual_review").otherwise("pass")
    )


def unmatched_lines(lines: DataFrame, line_id: str, candidates: DataFrame) -> DataFrame:
    """Lines that no candidate uses: what stands there besides what was expected."""
    used = candidates.select(F.explode("source_ocr_line_ids").alias(line_id)).distinct()
    return lines.join(used, line_id, "left_anti")


def comparison_index(items: DataFrame) -> DataFrame:
    """(id, comparison_key) of items to compare: six parts, nulls empty."""
    parts = ["semantic_key", "label", "group_id", "table_id", "row_key", "text"]
    first = keep_best(items.where("comparison_required"), ["id"], [F.col("ingested_at"), F.col("text")])
    return first.select("id", F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in parts]).alias("comparison_key"))


def greedy_pairs(scored: DataFrame, by: list[str], left: str, right: str, score: str, least: float = 0.0) -> DataFrame:
    """(by..., left, right, score): one-to-one pairs taken from the best score down, ties by ids.

    Whether a pair is taken depends on all better ones, so the candidates of one group are streamed in score order;
    only the ids taken so far are held.
    """
    fields = {f.name: f.dataType.simpleString() for f in scored.schema.fields}
    schema = ", ".join(f"{c} {fields[c]}" for c in [*by, left, right, score])

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, taken_l, taken_r = None, set(), set()
        for b in batches:
            keep = []
            for key, x, y in zip(zip(*(b[k] for k in by)), b[left], b[right]):
                if key != now:
                    now, taken_l, taken_r = key, set(), set()
                ok = x not in taken_l and y not in taken_r
                keep.append(ok)
                if ok:
                    taken_l.add(x)
                    taken_r.add(y)
            yield b[keep]

    rows = scored.where(F.col(score) >= least).select(*by, left, right, score).withColumn("__down", -F.col(score))
    ordered = rows.repartition(*by).sortWithinPartitions(*by, "__down", left, right).drop("__down")
    return ordered.mapInPandas(take, schema)


def best_by_score(candidates: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best candidates of each target: score, then fewest lines, then id."""
    one = candidate_texts(candidates).where(F.col("target_id").isNotNull())
    return top_k(one, ["target_id"], [F.desc("score"), F.col("n_lines"), F.col("candidate_id")], k).select(
        "target_id", "rank", "candidate_id"
    )
