"""Evaluation: recall, precision, ranges, gates. Ratios keep the convention for zero denominators of their kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.values import rate_or_one


def recall_precision(expected: DataFrame, actual: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """(by..., n_expected, n_actual, n_hit, recall, precision) of distinct keys; ratios of nothing are 1."""
    e = expected.select(*by, *keys).distinct().withColumn("__e", F.lit(1))
    a = actual.select(*by, *keys).distinct().withColumn("__a", F.lit(1))
    n = e.join(a, [*by, *keys], "full_outer").groupBy(*by).agg(
        F.count("__e").alias("n_expected"), F.count("__a").alias("n_actual"), F.count_if(F.col("__e").isNotNull() & F.col("__a").isNotNull()).alias("n_hit")
    )
    return n.withColumn("recall", F.round(rate_or_one(F.col("n_hit"), F.col("n_expected")), 4)).withColumn(
        "precision", F.round(rate_or_one(F.col("n_hit"), F.col("n_actual")), 4)
    )


def range_overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Letters that two half-open ranges share."""
    return F.greatest(F.least(end_a, end_b) - F.greatest(start_a, start_b), F.lit(0))


def conflicting_values(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """(by..., n_values) of groups with more than one value."""
    return df.groupBy(*by).agg(F.count_distinct(value).alias("n_values")).where(F.col("n_values") > 1)


def missing_required(df: DataFrame, by: str, key: str, required: list[str]) -> DataFrame:
    """(by, key): required keys that a group lacks."""
    grid = df.select(by).distinct().select(by, F.explode(F.array(*[F.lit(r) for r in required])).alias(key))
    return grid.join(df.select(by, key).distinct(), [by, key], "left_anti")


def weighted_findings(df: DataFrame, by: list[str], level: str) -> DataFrame:
    """(by..., score): 100 for each high, 10 for each medium, 1 for each low finding."""
    weight = F.when(F.col(level) == "high", 100).when(F.col(level) == "medium", 10).when(F.col(level) == "low", 1).otherwise(0)
    return df.groupBy(*by).agg(F.sum(weight).alias("score"))
