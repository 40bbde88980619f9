"""Set operators and diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_of_each(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Distinct by ``by``, keeping the first row."""
    from labelloom.operators.sequences import keep_best

    return keep_best(df, by, [F.col(c) for c in order])


def except_by(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Rows of ``left`` whose signature does not occur in ``right``."""
    return left.join(right.select(*by).distinct(), by, "left_anti").select(*left.columns)


def union_first_wins(frames: list[DataFrame], by: list[str], order: list[str]) -> DataFrame:
    """Union that keeps, of equal signatures, the row of the earliest frame."""
    out = None
    for n, f in enumerate(frames):
        f = f.withColumn("__source", F.lit(n))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return first_of_each(out, by, ["__source", *order]).drop("__source")


def duplicates(df: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n): keys that occur more than once."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def multiset_overlap(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """(by..., expected, actual, matched, missing, unexpected): counts of each kind on both sides."""
    l = left.groupBy(*by).agg(F.count(F.lit(1)).alias("expected"))
    r = right.groupBy(*by).agg(F.count(F.lit(1)).alias("actual"))
    both = l.join(r, by, "full_outer").na.fill(0, ["expected", "actual"])
    return both.select(
        *by,
        "expected",
        "actual",
        F.least("expected", "actual").alias("matched"),
        F.greatest(F.col("expected") - F.col("actual"), F.lit(0)).alias("missing"),
        F.greatest(F.col("actual") - F.col("expected"), F.lit(0)).alias("unexpected"),
    )


def plan_diff(before: DataFrame, after: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., action): 'remove', 'add' or 'adjust' of every key whose value changed."""
    b = before.select(*by, F.col(value).alias("__b"), F.lit(True).alias("__in_b"))
    a = after.select(*by, F.col(value).alias("__a"), F.lit(True).alias("__in_a"))
    action = (
        F.when(F.col("__in_a").isNull(), "remove")
        .when(F.col("__in_b").isNull(), "add")
        .when(~F.col("__a").eqNullSafe(F.col("__b")), "adjust")
    )
    return b.join(a, by, "full_outer").withColumn("action", action).where(F.col("action").isNotNull()).select(*by, "action")
