"""Spans and events as streams: late deliveries, gap sessions and the running state of a job."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 8) -> DataFrame:
    """Parquet files as they arrive in ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def first_deliveries(stream: DataFrame, key: str, at: str, late: str = "30 days") -> DataFrame:
    """Each key once, however often it is delivered within ``late``; the state forgets older keys."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, by: str, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(starts, by, n): tumbling or sliding counts; a window is final once the watermark has passed it."""
    stamped = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return stamped.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("starts"), by, "n")


def gap_sessions(stream: DataFrame, at: str, by: str, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(by, starts, ends, n): sessions that end after a gap."""
    stamped = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return (
        stamped.groupBy(by, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
        .select(by, F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), "n")
    )


def job_progress(stream: DataFrame, job: str, page: str) -> DataFrame:
    """(job, n_rows, last_page): the running totals of each job, kept in state between batches."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, 0)
        for b in batches:
            n += len(b)
            last = max(last, int(b[page].fillna(0).max()) if len(b) else 0)
        state.update((n, last))
        yield pd.DataFrame({job: [key[0]], "n_rows": [n], "last_page": [last]})

    return stream.where(F.col(job).isNotNull()).groupBy(job).applyInPandasWithState(
        update, f"{job} string, n_rows long, last_page long", "n long, last long", "update", GroupStateTimeout.NoTimeout
    )
