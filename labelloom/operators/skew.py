"""Joins that survive a key holding a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than a HOT_KEYS-th of all rows, so there are fewer than HOT_KEYS of them: few enough to
#: broadcast. No part of a hot key is larger than that share, which is less than an even share of a cluster's tasks.
HOT_KEYS = 10_000
#: Keys of fewer rows are never hot, however small the table.
HOT_ROWS = 50_000


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The hot keys, renamed to ``__hot_...``, and into how many parts (``__parts``) the rows of each are spread.

    Counts are combined map-side, so a hot key costs one row per map task.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    least = F.greatest(F.lit(hot_rows), (counts.agg(F.sum("__n")).scalar() / F.lit(HOT_KEYS)).cast("long"))
    return counts.where(F.col("__n") > least).select(
        *[F.col(k).alias(f"__hot_{k}") for k in keys], F.ceil(F.col("__n") / least).cast("int").alias("__parts")
    )


def salted_join(
    left: DataFrame, right: DataFrame, keys: list[str], spread_by: Column, how: str = "left", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``left`` join ``right`` on ``keys`` where ``left`` may hold hot keys and ``right`` has few rows per key.

    Rows of a hot key are spread by ``spread_by`` over as many parts as its rows need; the right rows of just these
    keys are repeated once per part. All other rows keep part 0, so nothing else grows. Both sides are then
    hash-partitioned and sorted on (keys, part) and merged. ``how`` is inner, left, left_semi or left_anti. Null keys
    match nothing. ``left`` is read twice, once for its keys alone.
    """
    hot = F.broadcast(hot_keys(left.where(~_any_null(keys)), keys, hot_rows))

    def on(df: DataFrame):
        return [df[k] == hot[f"__hot_{k}"] for k in keys]

    drop = ["__parts", *[f"__hot_{k}" for k in keys]]
    part = F.pmod(F.xxhash64(spread_by), F.coalesce("__parts", F.lit(1))).cast("int")
    salted = left.join(hot, on(left), "left").withColumn("__salt", part)
    copies = right.join(hot, on(right), "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))
    )
    return (
        salted.drop(*drop).join(copies.drop(*drop).hint("merge"), [*keys, "__salt"], how).drop("__salt")
    )


def _any_null(keys: list[str]) -> Column:
    cond = F.lit(False)
    for k in keys:
        cond = cond | F.col(k).isNull()
    return cond
