"""Proposals of a model checked against their sources: nothing is kept that is not written there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions.text import letters_only


def grounded(items: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) of items (item_id, text, source_ids) over sources (source_id, text).

    Rejected with a reason: no source ids, an unknown id, empty text, or text that the sources together do not hold.
    Item and source are compared by their letters; the sources are put together in the order in which they are named.
    """
    known = sources.select(F.col("source_id").alias("sid"), F.col("text").alias("source_text"))
    named = items.select("item_id", "text", F.posexplode_outer("source_ids").alias("n", "sid"))
    met = named.join(known, "sid", "left")
    whole = met.groupBy("item_id", "text").agg(
        F.count("sid").alias("n_named"),
        F.count_if(F.col("sid").isNotNull() & F.col("source_text").isNull()).alias("n_unknown"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "source_text"))), lambda s: s["source_text"]), "").alias("all"),
    )
    reason = (
        F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty_text")
        .when(F.col("n_named") == 0, "no_source")
        .when(F.col("n_unknown") > 0, "unknown_source")
        .when(~F.contains(letters_only(F.col("all")), letters_only(F.col("text"))), "not_in_source")
    )
    judged = whole.withColumn("reason", reason)
    return (
        judged.where(F.col("reason").isNull()).select("item_id", "text"),
        judged.where(F.col("reason").isNotNull()).select("item_id", "text", "reason"),
    )


def alias_keys(df: DataFrame, key: str, aliases: dict[str, str]) -> DataFrame:
    """``df`` with canonical keys: aliases replaced, lower case."""
    c = F.lower(F.trim(key))
    for a, canonical in aliases.items():
        c = F.when(c == a, canonical).otherwise(c)
    return df.withColumn(key, c)


def overlapping_sets(left: DataFrame, right: DataFrame, by: list[str], l_key: str, l_ids: str, r_key: str, r_ids: str, least: float) -> DataFrame:
    """(by..., l_key, r_key, n_common): pairs whose id sets share ``least`` of the smaller set; found by the ids shared."""
    a = left.select(*by, l_key, F.explode(F.array_distinct(l_ids)).alias("__id"), F.size(F.array_distinct(l_ids)).alias("__a"))
    b = right.select(*by, r_key, F.explode(F.array_distinct(r_ids)).alias("__id"), F.size(F.array_distinct(r_ids)).alias("__b"))
    n = a.join(b, [*by, "__id"]).groupBy(*by, l_key, r_key).agg(
        F.count(F.lit(1)).alias("n_common"), F.min(F.least("__a", "__b")).alias("__small")
    )
    return n.where(F.col("n_common") >= F.col("__small") * F.lit(least)).drop("__small")


def last_decisions(candidates: DataFrame, decisions: DataFrame, key: str, order: str) -> DataFrame:
    """Candidates with the last decision on each (accepted, rejected or unresolved); decisions on nothing known are ignored."""
    last = decisions.groupBy(key).agg(F.max_by("decision", order).alias("decision"))
    return candidates.join(last, key, "left").withColumn("decision", F.coalesce("decision", F.lit("unresolved")))


def upserted(base: DataFrame, repairs: DataFrame, by: list[str], text: str) -> DataFrame:
    """``base`` with rows replaced by repairs of the same key that are at least as long; new keys are added."""
    r = repairs.select(*by, F.col(text).alias("__r"))
    joined = base.join(r, by, "full_outer")
    longer = F.col("__r").isNotNull() & (F.col(text).isNull() | (F.length("__r") >= F.length(text)))
    return joined.withColumn(text, F.when(longer, F.col("__r")).otherwise(F.col(text))).drop("__r")
