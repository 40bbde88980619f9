"""References to records that are missing, deleted or late (problem 2).

References and parent keys are hash-partitioned on (column, key), sorted and merged in one linear pass (a
sort-merge join). Every parent key carries its validity interval: it starts with the first delivery and ends, for
evidence, with ``deleted_at``. Hot parents are spread over salts, see ``skew.salted_join``.

Defined results: null arrays, null and blank elements are no references; ids compare trimmed and in lower case;
repeated deliveries of an item or a parent count once, with their first ``ingested_at``; a null item id gives no row;
a parent or item without any ``ingested_at`` is never late; extra columns are ignored; empty tables give no rows (an
empty parent table makes every reference missing).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.operators.skew import HOT_ROWS, salted_join

#: Characters that ``strip`` takes as white space around an id.
BLANK = "".join(map(chr, (9, 10, 11, 12, 13, 32, 160, 8194, 8195, 8201, 8239, 12288, 65279)))


def ref_key(c: Column) -> Column:
    """An id as it is compared: trimmed, lower case; null if nothing is left."""
    key = F.lower(F.trim(c, F.lit(BLANK)))
    return F.when(F.length(key) > 0, key)


def parent_intervals(evidence: DataFrame, spans: DataFrame, alignments: DataFrame) -> DataFrame:
    """(ref_column, ref_id, first_seen, is_deleted): one row per parent key and column that may name it."""

    def keyed(df: DataFrame, column: str, key: str, deleted: Column) -> DataFrame:
        return df.select(
            F.lit(column).alias("ref_column"),
            ref_key(F.col(key)).alias("ref_id"),
            F.col("ingested_at").alias("seen"),
            deleted.alias("gone"),
        )

    rows = (
        keyed(evidence, "evidence_refs", "evidence_id", F.col("deleted_at").isNotNull())
        .unionAll(keyed(spans, "source_ids", "span_id", F.lit(False)))
        .unionAll(keyed(alignments, "source_ids", "ocr_line_id", F.lit(False)))
    )
    return (
        rows.where(F.col("ref_id").isNotNull())
        .groupBy("ref_column", "ref_id")
        .agg(F.min("seen").alias("first_seen"), F.max("gone").alias("is_deleted"))
    )


def _tagged(column: str) -> Column:
    """The elements of an array column as (ref_column, ref_id)."""
    return F.transform(
        F.coalesce(F.col(column), F.array().cast("array<string>")),
        lambda x: F.struct(F.lit(column).alias("ref_column"), ref_key(x).alias("ref_id")),
    )


def item_references(items: DataFrame) -> DataFrame:
    """(id, item_seen, period, ref_column, ref_id): distinct references of every item."""
    per_item = items.where(F.col("id").isNotNull()).select(
        "id",
        F.col("ingested_at").alias("seen"),
        F.date_format("created_at", "yyyy-MM").alias("month"),
        F.explode(
            F.concat(
                *[_tagged(c) for c in ("evidence_refs", "source_ids")]
            )
        ).alias("r"),
    )
    # An item's first delivery may name other references than a later one, so its time comes from all its rows.
    seen = items.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("ingested_at").alias("item_seen"))
    refs = (
        per_item.where(F.col("r.ref_id").isNotNull())
        .groupBy("id", "r.ref_column", "r.ref_id")
        .agg(F.min("month").alias("period"))
    )
    return refs.join(seen, "id")


def broken_references(
    items: DataFrame, evidence: DataFrame, spans: DataFrame, alignments: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(id, ref_column, ref_id, ref_state, period): every reference that does not hold.

    ``ref_state`` is 'missing' without a parent, else 'deleted', else 'late' if the parent came after the item.
    """
    joined = salted_join(
        item_references(items),
        parent_intervals(evidence, spans, alignments),
        ["ref_column", "ref_id"],
        F.col("id"),
        "left",
        hot_rows,
    )
    state = (
        F.when(F.col("is_deleted").isNull(), "missing")
        .when(F.col("is_deleted"), "deleted")
        .when(F.col("first_seen") > F.col("item_seen"), "late")
    )
    return (
        joined.withColumn("ref_state", state)
        .where(F.col("ref_state").isNotNull())
        .select("id", "ref_column", "ref_id", "ref_state", "period")
    )


def reference_report(broken: DataFrame) -> DataFrame:
    """(ref_column, period, ref_state, n_refs): the broken references counted per column and month."""
    return broken.groupBy("ref_column", "period", "ref_state").agg(F.count(F.lit(1)).alias("n_refs"))
