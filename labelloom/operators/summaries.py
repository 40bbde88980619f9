"""Summaries of a run: measures, admission of items, merged objects, profiles of sources and pages.

Every function is one grouping over columns; nulls count as absent, empty inputs give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rate(part: Column, of: Column | None = None, places: int = 4) -> Column:
    """Share of the rows (of those under ``of``) that meet a condition; null if there are none."""
    n = F.count_if(of) if of is not None else F.count(F.lit(1))
    hit = F.count_if(part & of) if of is not None else F.count_if(part)
    return F.round(F.try_divide(hit.cast("double"), n.cast("double")), places)


def mean(c: Column) -> Column:
    """Average to four places; millionths are summed as whole numbers, so the order of rows does not matter."""
    whole = F.sum(F.round(c * F.lit(1e6)).cast("long"))
    return F.floor(F.try_divide(whole.cast("double"), F.count(c).cast("double")) / F.lit(100.0) + F.lit(0.5)) / F.lit(10000.0)


def measures(df: DataFrame, by: list[str], rates: dict[str, Column], means: dict[str, Column]) -> DataFrame:
    """(by..., n, rates..., means...): shares of rows and averages, rounded to four places."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[rate(c).alias(n) for n, c in rates.items()],
        *[mean(c).alias(n) for n, c in means.items()],
    )


def block_reasons(df: DataFrame, key: str, reasons: dict[str, Column]) -> DataFrame:
    """(key, admitted, reasons): a row is admitted if none of the conditions holds; the reasons in their order."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in reasons.items()]))
    return df.select(key, (F.size(found) == 0).alias("admitted"), F.array_join(found, ",").alias("reasons"))


def first_class(c: Column, classes: dict[str, str], otherwise: str) -> Column:
    """The first class whose pattern a text matches, in the order of ``classes``."""
    out = None
    for name, pattern in classes.items():
        hit = F.coalesce(c.rlike(pattern), F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def is_noise(c: Column, stop: list[str]) -> Column:
    """A stop word, or at most two characters with neither two ideographs nor two digits."""
    t = F.trim(c)
    return F.coalesce(F.lower(t).isin(stop) | (F.length(t) <= 2) & ~t.rlike("[一-鿿]{2}|[0-9]{2}"), F.lit(True))


def merged_objects(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """(by..., columns...): rows of one identity merged, the first value that is not null of each column."""
    ordered = F.struct(*order)
    return df.groupBy(*by).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), ordered)).alias(c) for c in columns])


def provider_set(df: DataFrame, by: list[str], source: str, confidence: str) -> DataFrame:
    """(by..., providers, mode, confidence): the sources of a group, one name for them, mean confidence (missing is 0)."""
    names = F.array_sort(F.collect_set(source))
    out = df.groupBy(*by).agg(names.alias("s"), mean(F.coalesce(confidence, F.lit(0.0))).alias("confidence"))
    mode = F.when(F.size("s") > 1, "fusion").when(F.size("s") == 1, F.element_at("s", 1)).otherwise("unknown")
    return out.select(*by, F.array_join("s", "+").alias("providers"), mode.alias("mode"), "confidence")


def page_shapes(df: DataFrame, by: list[str], width: str, height: str, expected: Column, tolerance: float = 0.08) -> DataFrame:
    """(by..., ratio, agrees): whether the pages' width by height is within ``tolerance`` of what is expected."""
    out = df.groupBy(*by).agg(F.round(F.try_divide(F.max(width), F.max(height)), 4).alias("ratio"))
    return out.withColumn("agrees", F.coalesce(F.abs(F.col("ratio") - expected) <= expected * tolerance, F.lit(False)))


def chunk_types(df: DataFrame, kind: Column, table_id: str, by: list[str]) -> DataFrame:
    """(by..., chunk, n): rows routed to chunks by kind; several tables of a group get a chunk each."""
    one = df.groupBy(*by, table_id, kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    named = one.groupBy(*by).agg(F.count_distinct(table_id).alias("n_tables"))
    return (
        one.join(named, by)
        .select(*by, F.when(F.col(table_id).isNotNull() & (F.col("n_tables") > 1), F.concat_ws(":", F.lit("table"), F.col(table_id))).when(F.col(table_id).isNotNull(), "table").otherwise(F.col("kind")).alias("chunk"), "n")
        .groupBy(*by, "chunk").agg(F.sum("n").alias("n"))
    )


def folded_decisions(decisions: DataFrame, by: list[str], unit: str, status: str, every: DataFrame) -> DataFrame:
    """(by..., unit, state): accepted, rejected or unresolved by the worst decision; units without one are unknown."""
    rank = F.max(F.when(F.col(status) == "accepted", 0).when(F.col(status) == "rejected", 2).otherwise(1))
    worst = decisions.groupBy(*by, unit).agg(rank.alias("r"))
    state = F.when(F.col("r") == 0, "accepted").when(F.col("r") == 1, "unresolved").when(F.col("r") == 2, "rejected").otherwise("unknown")
    return every.select(*by, unit).distinct().join(worst, [*by, unit], "left").select(*by, unit, state.alias("state"))


def routed_risks(checks: DataFrame, routes: dict[str, str], target: str) -> DataFrame:
    """(target, risk, level): failed checks as risks by the type of check; types without a route give none."""
    route = None
    for kind, risk in routes.items():
        route = F.when(F.col("check_type") == kind, risk) if route is None else route.when(F.col("check_type") == kind, risk)
    return checks.where(F.col("result") == "failed").select(target, route.alias("risk"), "level").where(F.col("risk").isNotNull()).distinct()


def kept_in_two_stages(df: DataFrame, first: list[str], second: list[str], better_first: list[Column], key: str) -> DataFrame:
    """(key, stage): what each stage removes and what is kept: first the best by ``first``, of these the best by ``second``."""
    one = df.withColumn("__a", F.row_number().over(Window.partitionBy(*first).orderBy(*better_first)))
    kept = one.where(F.col("__a") == 1).withColumn("__b", F.row_number().over(Window.partitionBy(*second).orderBy(*better_first)))
    return one.where(F.col("__a") > 1).select(key, F.lit("removed_by_source").alias("stage")).unionAll(
        kept.select(key, F.when(F.col("__b") == 1, "kept").otherwise("removed_by_standard"))
    )


def natural_order(c: Column) -> list[Column]:
    """Sort keys that put table 2 before table 10."""
    return [F.regexp_replace(c, "[0-9]+", ""), F.regexp_extract(c, "([0-9]+)", 1).try_cast("long"), c]
