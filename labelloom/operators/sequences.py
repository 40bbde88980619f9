"""Operators on ordered lists. The order is a column, last in every sort key; ties keep the first."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def _with_int(df: DataFrame, name: str) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, T.IntegerType())])


def exploded_lines(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """(keep..., ord, line): the lines of a text that are not blank, numbered from 1 among all lines."""
    lines = df.select(*keep, F.posexplode(F.split(F.replace(F.col(text), F.lit("\r"), F.lit("")), "\n")).alias("pos", "line"))
    return lines.where(F.trim("line") != "").select(*keep, (F.col("pos") + 1).alias("ord"), "line")


def with_ordinal(df: DataFrame, by: list[str], order: list[str], out: str = "instance_index") -> DataFrame:
    """A running number within each group."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def adjacent_edges(df: DataFrame, by: list[str], order: list[str], node: str, edge: str = "reading_order") -> DataFrame:
    """(by..., source, target, edge_type): an edge from every element to the next."""
    w = Window.partitionBy(*by).orderBy(*order)
    return (
        df.withColumn("target", F.lead(node).over(w))
        .where(F.col("target").isNotNull())
        .select(*by, F.col(node).alias("source"), "target", F.lit(edge).alias("edge_type"))
    )


def carried(df: DataFrame, by: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """The last value that was not null, carried on."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def asof_marker(df: DataFrame, by: list[str], order: list[str], is_marker: Column, node: str, out: str = "marker") -> DataFrame:
    """The latest marker strictly before each element (an as-of join without a join)."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.last(F.when(is_marker, F.col(node)), ignorenulls=True).over(w))


def sessions(df: DataFrame, by: list[str], at: str, tie: str, gap_seconds: int, out: str = "session_no") -> DataFrame:
    """Gaps and islands: a new session where the gap to the element before exceeds ``gap_seconds``."""
    w = Window.partitionBy(*by).orderBy(at, tie)
    gap = _seconds(F.col(at)) - F.lag(_seconds(F.col(at))).over(w)
    return df.withColumn("__new", F.when(gap.isNull() | (gap > gap_seconds), 1).otherwise(0)).withColumn(
        out, F.sum("__new").over(w)
    ).drop("__new")


def _seconds(c: Column) -> Column:
    """Seconds since the epoch of a timestamp with or without zone."""
    return c.cast("timestamp").cast("double")


def sliding_frames(df: DataFrame, by: list[str], order: str, text: str, shortest: int = 2, longest: int = 4, glue: str = "") -> DataFrame:
    """(by..., first, n_lines, text): all runs of ``shortest`` to ``longest`` consecutive elements."""
    w = Window.partitionBy(*by).orderBy(order)
    parts = [F.lead(text, k).over(w) if k else F.col(text) for k in range(longest)]
    wide = df.select(*by, F.col(order).alias("first"), *[p.alias(f"__{k}") for k, p in enumerate(parts)])
    frames = F.array(
        *[
            F.when(
                F.col(f"__{n - 1}").isNotNull(),
                F.struct(F.lit(n).alias("n_lines"), F.concat_ws(glue, *[f"__{k}" for k in range(n)]).alias("text")),
            )
            for n in range(shortest, longest + 1)
        ]
    )
    return wide.select(*by, "first", F.explode(F.array_compact(frames)).alias("f")).select(*by, "first", "f.*")


def missing_numbers(df: DataFrame, by: list[str], number: str) -> DataFrame:
    """(by..., missing_from, missing_to): the ranges of integers between the least and the greatest that do not occur.

    A range is one row however wide it is, so a wild number costs nothing. Null numbers are passed over.
    """
    present = df.where(F.col(number).isNotNull()).select(*by, F.col(number).alias("__n")).distinct()
    after = F.lead("__n").over(Window.partitionBy(*by).orderBy("__n"))
    gaps = present.withColumn("__next", after).where(F.col("__next") > F.col("__n") + 1)
    return gaps.select(*by, (F.col("__n") + 1).alias("missing_from"), (F.col("__next") - 1).alias("missing_to"))


def keep_best(df: DataFrame, by: list[str], better_first: list[Column]) -> DataFrame:
    """The best row of each group; the last sort key must make the order total."""
    w = Window.partitionBy(*by).orderBy(*better_first)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") == 1).drop("__rank")


def top_k(df: DataFrame, by: list[str], better_first: list[Column], k: int, out: str = "rank") -> DataFrame:
    """The ``k`` best rows of each group with their rank."""
    w = Window.partitionBy(*by).orderBy(*better_first)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def packed_chunks(df: DataFrame, by: list[str], order: str, size: str, most_items: int, most_size: int) -> DataFrame:
    """``df`` with ``chunk_no``: consecutive elements packed until a chunk holds ``most_items`` or ``most_size``.

    Each element depends on where the chunk before it ended, so a group is streamed in order through Python.
    """
    schema = _with_int(df, "chunk_no")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, chunk, items, held = None, 0, 0, 0
        for b in batches:
            out = []
            keys = list(zip(*(b[k] for k in by)))
            for key, n in zip(keys, b[size]):
                if key != now:
                    now, chunk, items, held = key, 1, 0, 0
                elif items >= most_items or held + n > most_size:
                    chunk, items, held = chunk + 1, 0, 0
                items, held = items + 1, held + n
                out.append(chunk)
            yield b.assign(chunk_no=out).astype({"chunk_no": "int32"})

    return df.repartition(*by).sortWithinPartitions(*by, order).mapInPandas(pack, schema)


def mean_clusters(df: DataFrame, by: list[str], value: str, order: str, tolerance: float, out: str = "cluster_no") -> DataFrame:
    """``df`` with clusters along one axis: an element joins the last cluster if it lies near its running mean."""
    schema = _with_int(df, out)

    def cluster(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, no, total, n = None, 0, 0.0, 0
        for b in batches:
            found = []
            for key, v in zip(zip(*(b[k] for k in by)), b[value]):
                if key != now:
                    now, no, total, n = key, 1, v, 1
                elif abs(v - total / n) <= tolerance:
                    total, n = total + v, n + 1
                else:
                    no, total, n = no + 1, v, 1
                found.append(no)
            yield b.assign(**{out: found}).astype({out: "int32"})

    return df.repartition(*by).sortWithinPartitions(*by, value, order).mapInPandas(cluster, schema)
